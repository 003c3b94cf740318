"""Candidates against a plain search, the forest against its trees in Python, and the share of planted secrets that is found."""

import random
import re

import regex
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_rowwise import corpus

from cueloom.llm import secrets


def plain(text):
    """start, candidate, before and after, with contexts that go no further than two candidates."""
    ms = list(regex.finditer(secrets.CANDIDATE, text, flags=regex.V0))
    out = []
    for i, m in enumerate(ms):
        lead = len(m[0]) - len(re.sub(secrets.LEAD, "", m[0]))
        left = ms[i - 3].end() if i >= 3 else 0
        right = ms[i + 3].start() if i + 3 < len(ms) else len(text)
        at = m.start() + lead
        out.append((at, m[0][lead:], text[max(left, at - secrets.BEFORE) : at], text[m.end() : min(right, m.end() + secrets.AFTER)]))
    return out


def test_candidates(spark, sf):
    r = random.Random(8)
    texts = [t for _, t in brute.rows() + corpus(spark, sf)] + [b + c + a for c, b, a, _ in secrets.findings(200, 3) + secrets.assigned(200, 4)]
    texts += [" ".join(f"k{i}xoxb-{i:012d}" for i in range(700)), "password=" * 300, "xoxb-0123456789 " * 40, "é😀" * 20 + "token = '😀 ab'" + "x" * 40]
    bits = ["token", "password", " = ", ": ", '"', "'", "abc", "A1b2C3d4E5f6G7h8", "=", "://u:", "@", "\n", "xoxb-0123456789", "é", "=="]
    texts += ["".join(r.choices(bits, k=r.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t is not None], "i int, t string")
    for row in df.select("i", secrets.candidates(F.col("t")).alias("x")).collect():
        assert [(x.start, x.c, x.before, x.after) for x in row.x] == plain(texts[row.i]), texts[row.i][:300]


def test_forest_in_python(spark):
    forest = secrets.train(spark, secrets.findings(400) + secrets.assigned(200))
    docs = brute.table(spark, [(k, b + c + a) for k, (c, b, a, _) in enumerate(secrets.findings(150, 9))])
    scores = {(r.doc_id, f.start): f.score for r in secrets.scan(docs, forest).collect() for f in r.findings}
    rows = docs.select("doc_id", F.explode(secrets.candidates(F.col("text"))).alias("x")).select("doc_id", "x.*")
    rows = rows.select("doc_id", "start", *[F.expr(sql).alias(f) for f, sql in secrets.FEATURES.items()]).collect()
    assert len(rows) == len(scores) > 100
    for x in rows:
        assert abs(scores[x.doc_id, x.start] - sum(t.value(x.asDict()) for t in forest) / len(forest)) < 1e-9


def test_planted_in_documents(spark):
    """Secrets planted in the documents are all found; nothing else of their look-alikes is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = re.compile(r"(?:token|secret|password|api_key|key) ?[=:] ?\"?([0-9a-f]{32,64})")
    want = {(r.doc_id, m.start(1), m[1]) for r in docs.collect() for m in planted.finditer(r.text)}
    forest = secrets.train(spark, secrets.findings() + secrets.assigned())
    got = {(r.doc_id, f.start, f.candidate) for r in secrets.scan(docs, forest).collect() for f in r.findings if f.secret}
    assert want and want <= got
    assert len(got - want) <= 0.05 * len(got), got - want
