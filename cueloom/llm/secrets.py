"""Secret scans: candidate strings in a text, and a random forest that tells secrets from look-alikes.

Candidates are maximal runs of 16 or more characters of the alphabets that keys and tokens use, strings with a known
prefix of any length, values assigned to a name like password (4 or more characters, of any kind if quoted), and passwords
in connection strings. A value is a candidate without the name and the sign before it. The forest looks at the candidate's
length, its character transitions, how much of it common words cover, whether it stands in a path or address, and the
words beside it, which are those of the text, other candidates included. It is trained on the driver from labelled texts:
`findings` and `assigned` give fixed, seeded lists of them, of bounded size, and a caller can pass other ones. `train`
cuts candidates and neighbours out of them by the same expressions as `scan`. Each tree becomes nested conditional
expressions, so scanning is one projection without shuffles or Python.

Cases: a null or empty text has no candidates; very long texts and very long runs are taken whole; repeated rows,
repeated ids and null ids each give their row; other columns of docs are not looked at; candidates don't overlap, the
one that begins first counts; a text without candidates has an empty array.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import bind

#: How many characters beside a candidate count as its neighbours.
BEFORE, AFTER = 48, 24
CUE = r"(?i)(?:secret|token|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key|client[_ -]?id|key)\W{0,6}$"
NEAR = r"(?i)secret|token|passw|api.?key|access.?key|bearer|credential|private"
TAME = r"(?i)(?:sha ?1|sha ?256|md5|commit|revision|checksum|digest|uuid|guid|etag|hash|example|sample|placeholder|dummy|your)"
KNOWN = r"^(?:AKIA[0-9A-Z]{12,}|ASIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk[_-](?:live|test)?[_-]?[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{12,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{20,})"
#: A value without quotes, and the name and sign before a value.
BARE = r"""(?![=:>])[^\s"'`,;<>()\[\]{}&|]{3,}[^\s"'`,;<>()\[\]{}&|.:?]"""
NAMES = r"(?i:secret|token|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|secret[_ -]?key|private[_ -]?key|auth|bearer|credentials?)"
SIGN = r"""["']?[ \t]{0,3}(?::=|=>|==?|:)[ \t]{0,3}"""
#: What a match of CANDIDATE begins with that is not of the candidate.
LEAD = rf"""^{SIGN}["']?"""
#: Each way begins with a look at single characters, which rules it out at most places of a text.
CANDIDATE = "|".join([
    rf"""(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_\-"']))?""",
    rf"""(?=["' \t:=])(?=["']?[ \t]{{0,3}}[:=])(?<={NAMES}){SIGN}(?:["'][^"'\r\n]{{4,}}(?=["'])|{BARE})""",
    r""":(?<=://[^\s:/@"']{0,64}:)[^\s/"']{3,}(?=@)""",
    "(?=[AEaegnsx])(?<![A-Za-z0-9])" + KNOWN.removeprefix("^"),
])
WORDS = "the and for that with this from have not are was which their will would there been were more when who time into only other new some could these two may then first any our over such than now its like also after made many most through where much should well people down own just because good each those feel seem how high too place little world very still nation hand old life tell write become here show house both between need mean call develop under last right move thing general school never same another begin while number part turn real leave might want point form off child few small since against ask late home interest large person end open public follow during present without again hold govern around possible head consider word program problem however lead system set order eye plan run keep face fact group play stand increase early course change help line test user name value data file path index config main class string function return object array error debug info server client default example version update install package module import export license copyright"
DICTIONARY = "(?i)" + "|".join(sorted({w for w in WORDS.split() if len(w) > 3}, key=lambda w: (-len(w), w)))

#: Spark SQL over c (candidate), before and after.
FEATURES = {
    "length": "cast(length(c) as double)",
    "digits": "cast(regexp_count(c, '[0-9]') as double) / length(c)",
    "upper": "cast(regexp_count(c, '[A-Z]') as double) / length(c)",
    "lower": "cast(regexp_count(c, '[a-z]') as double) / length(c)",
    "hex": "cast(regexp_count(c, '[0-9a-f]') as double) / length(c)",
    "marks": "cast(regexp_count(c, '[+/_=-]') as double) / length(c)",
    "odd": "cast(regexp_count(c, '[^A-Za-z0-9+/_=-]') as double) / length(c)",
    "calls": r"if(rlike(c, '^[$%{<*]|^[A-Za-z_]+[.][A-Za-z_.]+$| [a-z]+ ') or rlike(after, '^[(\\[{]'), 1D, 0D)",
    "letter_digit": "cast(regexp_count(c, '[A-Za-z](?=[0-9])') + regexp_count(c, '[0-9](?=[A-Za-z])') as double) / length(c)",
    "case_change": "cast(regexp_count(c, '[a-z](?=[A-Z])') + regexp_count(c, '[A-Z](?=[a-z])') as double) / length(c)",
    "repeats": r"cast(regexp_count(c, '(.)(?=\\1)') as double) / length(c)",
    "vowel_pairs": "cast(regexp_count(c, '(?i)[aeiou](?=[^aeiou0-9+/_=-])') as double) / length(c)",
    "words": f"1D - cast(length(regexp_replace(c, '{DICTIONARY}', '')) as double) / length(c)",
    "path": "cast(regexp_count(c, '/') as double)",
    "in_path": r"if(rlike(before, '(?:[:/.\\\\]|www|http)[^ \\t\\n]*$') and not rlike(before, '[:=] *$'), 1D, 0D)",
    "file_ending": r"if(rlike(after, '^\\.(?:[a-z]{2,4})\\b'), 1D, 0D)",
    "assigned": r"""if(rlike(before, '[=:] ?["\']?$'), 1D, 0D)""",
    "cue": f"if(rlike(before, r'{CUE}'), 1D, 0D)",
    "near": f"if(rlike(before, r'{NEAR}'), 1D, 0D)",
    "tame": f"if(rlike(concat(before, ' ', after), r'{TAME}'), 1D, 0D)",
    "known": f"if(rlike(c, r'{KNOWN}'), 1D, 0D)",
    "uuid": "if(rlike(c, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'), 1D, 0D)",
}


def findings(n: int = 1_600, seed: int = 11) -> list[tuple[str, str, str, bool]]:
    """n labelled findings: candidate, what stands before and after it, and whether it is a secret."""
    r = random.Random(seed)
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    pick = lambda letters, k: "".join(r.choices(letters, k=k))
    plain = WORDS.split()
    prose = lambda k: " ".join(r.choices(plain, k=k))

    def secret() -> tuple[str, str, str]:
        c = r.choice([
            lambda: pick(hexes, r.choice([32, 40, 64])), lambda: pick(alnum, r.randint(20, 64)), lambda: pick(alnum + "+/", r.randint(27, 86)) + "=" * r.randint(0, 2), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "sk-" + pick(alnum, 40), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35), lambda: "eyJ" + pick(alnum, 60),
        ])()
        cue = r.choice(["token", "secret", "password", "api_key", "API key", "access_key", "auth", "AWS_SECRET_ACCESS_KEY", "Bearer", "client_secret", "key", "private_key", "passwd"])
        before = r.choice([f"{cue} = ", f"{cue}: ", f'{cue} = "', f'"{cue}": "', f"{cue}=", f"{cue} ", f"export {cue.upper()}="])
        known = re.search(KNOWN, c) is not None
        if known and r.random() < 0.5:
            before = r.choice(["", " ", '"', f"{prose(1)} = "])
        return c, prose(r.randint(0, 4)) + " " + before, r.choice(['"', "'", "\n", " ", ";"]) + prose(2)

    def other() -> tuple[str, str, str]:
        kind = r.randrange(8)
        before, after = prose(4) + " ", " " + prose(2)
        if kind == 0:
            return "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), prose(2) + r.choice([" uuid ", " id: ", " request ", " ", " guid = "]), after
        if kind == 1:
            return pick(hexes, r.choice([32, 40, 64])), prose(2) + r.choice([" commit ", " sha1 ", " sha256: ", " md5 = ", " checksum ", " revision ", " digest "]), after
        if kind == 2:
            return "/".join(r.choices(plain, k=r.randint(4, 8))), prose(2) + r.choice([" /", " http://", " see ", " www."]), r.choice([".py", ".html ", " ", "?"])
        if kind == 3:
            return r.choice("_-").join(r.choices(plain, k=r.randint(4, 7))), before + r.choice(["", "key = ", "def ", "token_"]), after
        if kind == 4:
            return pick(string.digits, r.randint(16, 24)), before + r.choice(["", "card ", "id: ", "number "]), after
        if kind == 5:
            return r.choice("=-_xX0") * r.randint(16, 60), before + r.choice(["", "password = ", "token: "]), after
        if kind == 6:
            return r.choice(["your_api_key_here_please", "EXAMPLE_TOKEN_EXAMPLE_TOKEN", "changeme-changeme-changeme", "insert-your-secret-key-here"]) + pick(string.digits, r.randint(0, 2)), r.choice(["token = ", "api_key: ", "secret = "]), after
        return "".join(pick(r.choice(["aeiou", "bcdfghlmnprst"]), 1) + pick("aeioubcdlmnrst", 2) for _ in range(r.randint(6, 10))), before, after

    return [(*(secret() if i % 2 else other()), bool(i % 2)) for i in range(n)]


def assigned(n: int = 1_200, seed: int = 12) -> list[tuple[str, str, str, bool]]:
    """n labelled values of names and of connection strings, short ones too, in the form of findings."""
    r = random.Random(seed)
    alnum, marks, plain = string.ascii_letters + string.digits, "@!.#$%^*?~-_+", WORDS.split()
    pick = lambda letters, k: "".join(r.choices(letters, k=k))

    def secret() -> str:
        word = r.choice(plain)
        return r.choice([
            lambda: pick(alnum, r.randint(6, 18)), lambda: pick(alnum + marks, r.randint(7, 18)), lambda: word.capitalize() + pick(string.digits, r.randint(2, 5)) + pick(marks, r.randint(0, 2)),
            lambda: "".join(r.choice([c, c.upper(), r.choice("0134@$")]) for c in word + r.choice(plain)) + pick(string.digits + marks, r.randint(1, 3)), lambda: word + pick(marks, 1) + r.choice(plain) + pick(string.digits, r.randint(1, 4)),
            lambda: "xoxb-" + pick(string.digits, r.randint(10, 12)), lambda: "eyJ" + pick(alnum, 12),
        ])()

    def other() -> str:
        word = r.choice(plain)
        return r.choice([
            lambda: word + r.choice(["", "s", "ed"]), lambda: r.choice(["null", "None", "true", "false", "string", "required", "optional", "changeme", "password", "secret", "undefined", "xxxxxxxx", "********", "your_password", "example"]), lambda: f"{word}.{r.choice(plain)}",
            lambda: "${" + word.upper() + "}", lambda: "$" + word.upper() + "_" + r.choice(plain).upper(), lambda: f"{word}_{r.choice(plain)}", lambda: f"<{word}>", lambda: " ".join(r.choices(plain, k=r.randint(2, 6))), lambda: word + r.choice(plain).capitalize(),
        ])()

    out = []
    for i in range(n):
        c = (secret if i % 2 else other)()
        name, prose = r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "DB_PASSWORD", "auth", "passphrase"]), " ".join(r.choices(plain, k=r.randint(0, 4)))
        before, after = r.choice([(f'{name} = "', '"'), (f"{name}: ", "\n"), (f"{name}=", " "), (f'"{name}": "', '",'), (f"{name} = '", "'"), (f"{r.choice(['postgres', 'mysql', 'https', 'amqp'])}://{r.choice(plain)}:", "@" + r.choice(plain))])
        out.append((c, f"{prose} {before}", after + r.choice(["", " " + r.choice(plain)]), bool(i % 2)))
    return out


@dataclass(frozen=True)
class Node:
    """A leaf if feature is empty."""

    feature: str = ""
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None
    share: float = 0.0

    def sql(self) -> str:
        return f"CASE WHEN f.{self.feature} <= {self.threshold!r}D THEN {self.low.sql()} ELSE {self.high.sql()} END" if self.feature else f"{self.share!r}D"

    def value(self, row: dict[str, float]) -> float:
        return (self.low if row[self.feature] <= self.threshold else self.high).value(row) if self.feature else self.share


def grow(rows: list[tuple[dict[str, float], bool]], r: random.Random, depth: int, least: int = 4) -> Node:
    p = sum(y for _, y in rows) / len(rows)
    if not depth or p in (0.0, 1.0) or len(rows) < 2 * least:
        return Node(share=round(p, 4))
    best = (2 * p * (1 - p) - 1e-9, "", 0.0)
    for f in r.sample(sorted(FEATURES), 9):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values[:: max(1, len(values) // 24)], values[max(1, len(values) // 24) :: max(1, len(values) // 24)], strict=False):
            t = (a + b) / 2
            low = [y for x, y in rows if x[f] <= t]
            k, q = len(low), len(rows) - len(low)
            if min(k, q) >= least:
                u, v = sum(low) / k, (p * len(rows) - sum(low)) / q
                best = min(best, ((k * 2 * u * (1 - u) + q * 2 * v * (1 - v)) / len(rows), f, t))
    if not best[1]:
        return Node(share=round(p, 4))
    _, f, t = best
    return Node(f, t, grow([x for x in rows if x[0][f] <= t], r, depth - 1, least), grow([x for x in rows if x[0][f] > t], r, depth - 1, least))


def train(spark, labelled: list[tuple[str, str, str, bool]], n_trees: int = 15, depth: int = 6, seed: int = 5) -> list[Node]:
    """A forest from labelled findings (string, text before and after it, whether it is a secret); the caller bounds their number.

    What is learned from are the candidates that `scan` sees in such a text: one is a secret if it is the string or most of it."""
    df = spark.createDataFrame([(i, c, b + c + a, y) for i, (c, b, a, y) in enumerate(labelled)], "doc_id long, finding string, text string, y boolean")
    found = df.select("doc_id", "finding", "y", F.explode(candidates(F.col("text"))).alias("x")).select("doc_id", "finding", "y", "x.*")
    is_it = F.contains("finding", "c") & (2 * F.length("c") > F.length("finding")) | F.contains("c", "finding")
    rows = found.select("doc_id", "start", (F.col("y") & is_it).alias("secret"), *[F.expr(sql).alias(f) for f, sql in FEATURES.items()]).orderBy("doc_id", "start").collect()
    rows = [({f: x[f] for f in FEATURES}, x["secret"]) for x in rows]
    r = random.Random(seed)
    return [grow(r.choices(rows, k=len(rows)), r, depth) for _ in range(n_trees)]


#: Candidates whose lengths are added up together, so that the places of many take no time that grows with their square.
BLOCK = 256


def candidates(text: Column) -> Column:
    """The candidates of a text: start (in code points, from 0), c, and before and after, its neighbours, no further than the two candidates on that side."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def places(pieces: Column, found: Column, sizes: Column, sums: Column) -> Column:
        tail = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(BEFORE))
        head = lambda x: F.left(F.coalesce(x, F.lit("")), F.lit(AFTER))

        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            at = F.get(sums, block) + total(F.slice(sizes, block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get(pieces, i))
            c = F.regexp_replace(m, F.lit(LEAD), F.lit(""))
            lead = F.length(m) - F.length(c)
            near = F.concat(*[tail(F.get(x, i - k)) for x, k in ((pieces, 2), (found, 2), (pieces, 1), (found, 1), (pieces, 0))], F.left(m, lead))
            behind = F.concat(*[head(F.get(x, i + k)) for x, k in ((pieces, 1), (found, 1), (pieces, 2), (found, 2), (pieces, 3))])
            return F.struct((at + lead).alias("start"), c.alias("c"), tail(near).alias("before"), head(behind).alias("after"))

        return F.transform(found, one)

    def numbered(pieces: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
        blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))
        upto = lambda v: bind(blocks(v), lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b))))
        return bind(sizes, lambda v: bind(upto(v), lambda s: places(pieces, found, v, s)))

    found = bind(F.split(text, CANDIDATE, -1), lambda p: bind(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: numbered(p, m)))
    return F.when(F.rlike(text, F.lit(CANDIDATE)), found).otherwise(F.array().cast("array<struct<start:int,c:string,before:string,after:string>>"))


def scan(docs: DataFrame, forest: list[Node], threshold: float = 0.5) -> DataFrame:
    """For each row of docs: doc_id and findings, an array of candidate, start (in code points, from 0), score and secret."""
    scored = "transform(cands, c0 -> named_struct('start', c0.start, 'candidate', c0.c, 'score', transform(array(" + _features("c0") + f"), f -> ({' + '.join(t.sql() for t in forest)}) / {len(forest)})[0]))"
    out = docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("cands")).select("doc_id", F.expr(scored).alias("s"))
    return out.select("doc_id", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["candidate"].alias("candidate"), x["score"].alias("score"), (x["score"] > threshold).alias("secret"))).alias("findings"))


def _features(row: str) -> str:
    inside = {f: re.sub(r"(?<![\w'\[])(c|before|after)(?=[,)])", rf"{row}.\1", sql) for f, sql in FEATURES.items()}
    return "named_struct(" + ", ".join(f"'{f}', {sql}" for f, sql in inside.items()) + ")"
