"""Secrets and look-alikes written by hand, not drawn from the generators that train the forest."""

from tests.llm import brute

from cueloom.llm import secrets

SECRETS = [
    ('password = "Tr0ub4dor!x"', "Tr0ub4dor!x"), ("db.passwd: S3cr3t.Pa55 # prod", "S3cr3t.Pa55"), ("the bot uses xoxb-1234567890 for posts", "xoxb-1234567890"), ("cookie eyJhbGciOiJIUz here", "eyJhbGciOiJIUz"[:14]),
    ("postgres://admin:p@ss!w0rd9@db.internal:5432/app", "p@ss!w0rd9"), ("PASSWORD=hunter2!Zq", "hunter2!Zq"), ("pwd='qX7#mm2, b'", "qX7#mm2, b"), ("token=24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ("set api_key: k9Zt-31Qw now", "k9Zt-31Qw"), ("mysql://root:Rt5_oo1x@localhost", "Rt5_oo1x"),
]
SECRETS[3] = ("cookie eyJhbGciOiJIUzI here", "eyJhbGciOiJIUzI")
OTHERS = ["password: required", "password = null", 'token = "string"', "password=${DB_PASSWORD}", "the password was changed in the office", "secret: false", "see http://example.org:8080/path", "auth: optional"]


def test_by_hand(spark):
    forest = secrets.train(spark, secrets.findings() + secrets.assigned())
    docs = brute.table(spark, list(enumerate([t for t, _ in SECRETS] + OTHERS)))
    found = {r.doc_id: r.findings for r in secrets.scan(docs, forest).collect()}
    for i, (t, c) in enumerate(SECRETS):
        assert [f.start for f in found[i] if f.candidate == c] == [t.index(c)], (t, found[i])
    missed = [t for i, (t, c) in enumerate(SECRETS) if not any(f.secret and f.candidate == c for f in found[i])]
    wrong = [t for i, t in enumerate(OTHERS, len(SECRETS)) if any(f.secret for f in found[i])]
    assert not missed and not wrong, (missed, wrong, found)
