"""Quality rules: statistics of each text and a learned decision list over them.

`learn` fits the list by sequential covering: on a grow part of the labelled rows it adds the threshold with
the largest information gain until no wrong row is covered, then on the other part drops the last conditions
while that does not lower (right - wrong) / covered. Rules end when one is not precise enough. Each rule is a
conjunction of thresholds and becomes a branch of a Spark conditional expression, in the order found.

Only built-in expressions run on the executors. The labelled rows that the driver sees are a sample of at most
`LABELLED_ROWS`, the first by a hash of their id, so that reruns agree; that bound is the only one.

Cases: a null text has no words and fails the base rules; rows with a null or repeated id each keep their row;
labels of unknown documents and null labels are not used, and several labels of one document count as the lowest;
with no labels, or labels of one class, there are no rules and the base rules alone decide. Other columns of
`docs` are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import SPACES, bind, named, words

LABELLED_ROWS = 4_000
WINDOW = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(tokens: Column, n: int = WINDOW) -> Column:
    """How many words stand in n-word windows that the same text has twice or more."""

    def hashes(w: Column) -> Column:
        return bind(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])),
        )

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + n).alias("end"), (a["n"] + p + n - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        at = bind(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(at))

    return F.when(F.size(tokens) <= n, F.lit(0)).otherwise(bind(hashes(tokens), repeated))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts and those that only the rules use, one row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    raw = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text")))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            F.size(F.array_distinct(w)).alias("n_kinds"),
            repeated_words(w).alias("n_repeat_words"),
        )

    sparse = lambda pattern: F.regexp_count("text", F.lit(pattern))
    line_counts = bind(lines, lambda s: F.struct(F.size(s).alias("n"), F.size(F.array_distinct(s)).alias("kinds")))
    raw = raw.select(
        "doc_id", bind(F.col("w"), counts).alias("c"), line_counts.alias("l"),
        sparse(r"[#*$%&|<>]").alias("n_symbols"), sparse("[A-Z]").alias("n_upper"), sparse("[0-9]").alias("n_digits"), sparse("!").alias("n_bangs"),
    )
    long = lambda c: F.col(c).cast("long")
    return raw.select(
        "doc_id", long("c.n_words").alias("n_words"), long("c.word_chars").alias("word_chars"), long("n_symbols").alias("n_symbols"),
        (long("l.n") - long("l.kinds")).alias("n_dup_lines"), long("c.n_repeat_words").alias("n_repeat_words"),
        long("c.n_kinds").alias("n_kinds"), long("l.n").alias("n_lines"), long("n_upper").alias("n_upper"), long("n_digits").alias("n_digits"), long("n_bangs").alias("n_bangs"),
    )


def _share(a: str, b: str) -> str:
    return f"({a} / greatest({b}, 1))"


#: What rules may put thresholds on, as SQL over the columns of `statistics`.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": _share("word_chars", "n_words"),
    "symbol_share": _share("n_symbols", "word_chars"),
    "repeat_share": _share("n_repeat_words", "n_words"),
    "dup_line_share": _share("n_dup_lines", "n_lines"),
    "kind_share": _share("n_kinds", "n_words"),
    "upper_share": _share("n_upper", "word_chars"),
    "digit_share": _share("n_digits", "word_chars"),
    "bang_share": _share("n_bangs", "word_chars"),
    "line_words": _share("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """Rows that meet every condition are rejected."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(rows: list[tuple[dict[str, float], bool]], most_rules: int = 12, most_conditions: int = 3, precision: float = 0.97, least: int = 5) -> list[Rule]:
    """The decision list that rejects the rows marked True."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    cuts = {}
    for f in FEATURES:
        values = sorted({r[f] for r, _ in grow})
        step = max(1, len(values) // 64)
        cuts[f] = [(a + b) / 2 for a, b in zip(values[::step], values[step::step], strict=False)]

    def tally(part, conditions):
        hit = [bad for r, bad in part if all(c.holds(r) for c in conditions)]
        return sum(hit), len(hit) - sum(hit)

    found: list[Rule] = []
    while len(found) < most_rules:
        conditions: list[Condition] = []
        inside = grow
        while len(conditions) < most_conditions:
            p0 = sum(bad for _, bad in inside)
            if not p0 or p0 == len(inside):
                break
            best, gain = None, 1e-9
            for f, points in cuts.items():
                for t in points:
                    over = [bad for r, bad in inside if r[f] > t]
                    p, n = sum(over), len(over) - sum(over)
                    for above, a, b in ((True, p, n), (False, p0 - p, len(inside) - p0 - n)):
                        if a and (g := a * (math.log2(a / (a + b)) - math.log2(p0 / len(inside)))) > gain:
                            best, gain = Condition(f, above, t), g
            if best is None:
                break
            conditions.append(best)
            inside = [x for x in inside if best.holds(x[0])]

        def worth(kept):
            p, n = tally(prune, kept)
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        right, wrong = (a + b for a, b in zip(tally(grow, conditions), tally(prune, conditions), strict=True))
        if not conditions or right < least or right < precision * (right + wrong):
            break
        found.append(Rule(tuple(conditions), right, wrong))
        grow, prune = ([x for x in part if not all(c.holds(x[0]) for c in conditions)] for part in (grow, prune))
    return found


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED_ROWS) -> list[Rule]:
    """The rules that a sample of at most most_rows labelled documents teaches; those that fail the base rules teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = known.select("doc_id", "quality", order.alias("o")).orderBy("o", "doc_id", "quality").limit(most_rows)
    picked = sample.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("o").alias("o"))
    ids = F.broadcast(picked)  # most_rows rows at most
    texts = docs.select("doc_id", "text").join(ids.select("doc_id"), "doc_id", "left_semi")
    features = statistics(texts).where(~base_failed()).select("doc_id", *[F.expr(sql).alias(f) for f, sql in FEATURES.items()])
    once = features.groupBy("doc_id").agg(*[F.min(f).alias(f) for f in FEATURES])
    rows = once.join(ids, "doc_id").orderBy("o", "doc_id").collect()  # most_rows rows at most
    return learn_rules([({f: r[f] for f in FEATURES}, r["quality"] == 0) for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that rejects the row; 0 if none does."""
    branches = "".join(f" WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1))
    return F.expr(f"CASE{branches} ELSE 0 END") if rules else F.lit(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics of each row of docs, base_failed, the rule that rejects it (0: none) and kept."""
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, as they are, that neither the base rules nor the learned ones reject."""
    everything = F.struct(*[named(c) for c in docs.columns])
    names = ("doc_id", "text")
    whole = docs.select(everything.alias("whole"), *[F.col(n) for n in names])
    carried = whole.select(F.struct("whole", "doc_id").alias("doc_id"), "text")
    return judge(carried, rules).where("kept").select("doc_id.whole.*")
