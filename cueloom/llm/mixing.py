"""Mixing sources to target weights by a low-discrepancy schedule.

`targets` gives each source its share of the words to take, by weight, stopped at `MOST_TIMES` the source's size;
what that cuts off goes to the other sources by weight until none is above (water filling, in one pass over the
sources in the order in which they stop).

`mix` then lays out the words. Each source gets as many slots as equal blocks of about `BLOCK_WORDS` words fit its
target, one at least. Slot i of the schedule is the i-th point of the van der Corput sequence, mapped through the
cumulative slot counts of the sources, so that every stretch of the schedule has the sources in proportion. The
r-th slot of a source takes block r of that source's shuffled words, read from the start again after their end.
A block may span documents and a document blocks; the pieces are the rows of the result.

Running numbers over a hot source are made in steps, over runs of bins, bins of bounded size, and within each bin, so
no task holds a whole source: document bins come from the shuffle hash, schedule bins are runs of `BIN` slots.
Only the sources themselves, a row each, are ordered as a whole.

Cases: a null text has no words; null is a source of its own, last; rows with equal or null ids are mixed as rows
of their own; a document without words is never taken; sources without words have target 0; an empty table gives
an empty mix. Other columns of docs are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import SPACE, named, row_key, stored, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 64
#: Slots and documents that one task puts in order at least; bins that one task adds up.
BIN, DOCS_BIN, RUN = 4096, 256, 1024
SEED = "cueloom-mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words, with h, by which the documents of a source are shuffled."""
    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), text)
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(text, SPACE)).cast("long").alias("size"), h.alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES) -> DataFrame:
    """A row for each source: source, source_size, weight, target and take, the target in whole words."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Strings compare by their UTF-8 bytes, which is code point order. A window over the sources: a row each.
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most_times).cast("double"))
    stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = stop.rowsBetween(Window.unboundedPreceding, -1), stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # The words that one unit of weight gets if every source before this one has stopped and no later one has.
    unit = ranked.withColumn("unit", left / F.sum("weight").over(after)).withColumn("stops", F.col("unit") * F.col("weight") > F.col("cap"))
    final = F.max(F.when(~F.col("stops"), F.struct(-F.col("cap") / F.col("weight"), F.col("unit")))).over(everything)["unit"]
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * final, F.col("cap")))
    return unit.select("source", "source_size", "weight", target.alias("target")).withColumn("take", F.least(F.round("target").cast("long"), F.col("source_size") * most_times))


def _with(df: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of starts, by keys that may be null."""
    a, b = df.alias("a"), starts.alias("b")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("a.*", *[f"b.{c}" for c in starts.columns if c not in keys])


def running(df: DataFrame, key: list[str], bins: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the same key before this one, by bin and order.

    Bins are small, keys may be not: bins are added up in runs of RUN, and the runs of a key in order."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    whole = df.groupBy(*key, bins).agg(F.sum(value).alias("bin_sum")).withColumn("run", F.expr(f"{bins} div {RUN}"))
    runs = whole.groupBy(*key, "run").agg(F.sum("bin_sum").alias("run_sum"))
    runs = runs.select(*key, "run", so_far("run_sum", Window.partitionBy(*key).orderBy("run")).alias("run_start"))
    starts = _with(whole, runs, [*key, "run"]).select(*key, bins, (F.col("run_start") + so_far("bin_sum", Window.partitionBy(*key, "run").orderBy(bins))).alias("bin_start"))
    joined = _with(df, starts, [*key, bins])
    return joined.withColumn(name, F.col("bin_start") + so_far(value, Window.partitionBy(*key, bins).orderBy(*order))).drop("bin_start")


def _reversed_bits(i: Column, bits: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def _blocks(block_words: int) -> Column:
    """How many blocks a source's take words make."""
    return F.when(F.col("take") > 0, F.greatest(F.lit(1), F.round(F.col("take") / block_words))).otherwise(0).cast("long")


def _begin(rank: str) -> Column:
    """Where a source's block begins: blocks have take div n words, and the first take % n of them one more."""
    return F.expr(f"{rank} * (take div n) + least({rank}, take % n)")


def _rank(word: str) -> Column:
    """The block that a word of a source's endless stream is in."""
    longer = "(take % n) * (take div n + 1)"
    return F.expr(f"if({word} < {longer}, {word} div (take div n + 1), take % n + ({word} - {longer}) div (take div n))")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots: slot, sid, rank among the source's slots from 0, and first and last, the words of its endless stream that it takes.

    sources has sid, source_size and take."""
    spark = sources.sparkSession
    counted = sources.select("sid", "take", _blocks(block_words).alias("n")).where("n > 0")
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source
    spans = counted.withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n"))
    n = spans.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (n - 1).bit_length())
    step = max(1, n // 4096)
    # Points are whole numbers under n, each once; a source owns a run of them. Both sides are cut by the same steps, so this is an equality join.
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), _reversed_bits(F.col("id"), F.lit(bits)).alias("point")).where(F.col("point") < n)
    owners = spans.withColumn("cut", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))))
    held = points.withColumn("cut", F.expr(f"point div {step}")).join(owners, "cut").where("point >= lo and point < hi")
    ranked = running(held.select("slot", "sid", "take", "n", F.lit(1).alias("one"), F.expr(f"slot div {BIN}").alias("bin")), ["sid"], "bin", ["slot"], "one", "rank")
    return ranked.select("slot", "sid", "rank", _begin("rank").alias("first"), _begin("(rank + 1)").alias("last"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, source, doc_id, row (of a document), times (its pass, from 0), begin and end, the words of the document that are taken, plus sizes and targets.

    Documents of which nothing is taken have one row with null slot, times, begin and end."""
    sized = stored(sizes(docs), "mix-sizes")
    # sid stands for the source, null too, in joins.
    sid = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    sources = stored(targets(sized).withColumn("sid", sid), "mix-targets")
    s = sources.alias("s")
    placed = sized.alias("d").join(F.broadcast(s) if sources.count() <= 100_000 else s, F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("d.*", "s.sid", "s.source_size", "s.target", "s.take")
    n_bins = max(1, sized.count() // DOCS_BIN)
    placed = placed.withColumn("bin", F.pmod("h", F.lit(n_bins)))
    placed = stored(running(placed, ["sid"], "bin", ["h", "doc_id"], "size", "start"), "mix-places")
    # A pass of a document covers the words [times * source_size + start, ... + size) of its source's endless stream, and so some ranks of slots.
    passes = placed.where("size > 0").withColumn("times", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1)))).withColumn("from", F.col("times") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).where(F.col("from") < F.col("to"))
    ranks = F.sequence(_rank("`from`"), _rank("(`to` - 1)"))
    pieces = passes.withColumn("n", _blocks(block_words)).withColumn("rank", F.explode(ranks)).withColumn("first", _begin("rank")).withColumn("last", _begin("(rank + 1)"))
    pieces = pieces.withColumn("a", F.greatest("first", "from")).withColumn("b", F.least("last", "to")).where("a < b")
    slots = schedule(sources, block_words).select("sid", "rank", "slot")
    taken = pieces.join(slots, ["sid", "rank"]).select(
        "slot", "source", "doc_id", "h", "size", "source_size", "target", "times", (F.col("a") - F.col("from")).alias("begin"), (F.col("b") - F.col("from")).alias("end"), "sid", "start",
    )
    nothing = F.lit(None).cast("long")
    rest = placed.where("size = 0 or start >= take").select(
        nothing.alias("slot"), "source", "doc_id", "h", "size", "source_size", "target", F.lit(None).cast("int").alias("times"), nothing.alias("begin"), nothing.alias("end"), "sid", "start",
    )
    return taken.unionByName(rest)


def taken_words(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target and taken, the words that the mix takes of it, with
    n_slots, the slots of the schedule that take some, and first_slot, the earliest of these: the mix begins with the rows of small first_slot."""
    # start is a place of its own for each row with words; rows without words count one by one.
    mixed = mix(docs).withColumn("row", F.when(F.col("size") > 0, F.struct("sid", "start")))
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    whole = mixed.where("size > 0").groupBy("row").agg(*same, F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).cast("long").alias("taken"), F.count("slot").alias("n_slots"), F.min("slot").alias("first_slot"))
    nothing = F.lit(0).cast("long")
    empty = mixed.where("size = 0").select("doc_id", "size", "source_size", "target", nothing.alias("taken"), nothing.alias("n_slots"), F.lit(None).cast("long").alias("first_slot"))
    return whole.select(*empty.columns).unionByName(empty)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of docs once for each pass that takes words of it, its text cut to them where a pass takes not all.

    Columns are those of docs; n_chars, if there, follows a cut text. Rows that only other columns tell apart share their passes in the order of a hash."""
    names = docs.columns
    runs = mix(docs).where("slot is not null").groupBy("sid", "start", "source", "doc_id", "h", "size", "times").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    row = runs.groupBy("sid", "start", "source", "doc_id", "h", "size").agg(F.sort_array(F.collect_list(F.struct("times", "begin", "end"))).alias("passes"))  # MOST_TIMES at most
    key = ["source", "doc_id", "h"]
    nth = row.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("start"))).select(*[F.col(k).alias(f"k_{k}") for k in key], "nth", "size", "passes")
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(
        F.struct(*[named(c) for c in names]).alias("whole"), F.col("source").cast("string").alias("source"), "doc_id",
        F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), text).alias("h"), *row_key(docs),
    )
    whole = whole.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("k1", "k2")))
    same = whole["nth"] == nth["nth"]
    for k in key:
        same &= whole[k].eqNullSafe(nth[f"k_{k}"])
    taken = whole.join(nth, same).select("whole", "size", F.explode("passes").alias("p"))
    part = F.col("p.end") - F.col("p.begin") < F.col("size")
    cut = F.array_join(F.slice(words(F.col("whole.text"), SPACE), (F.col("p.begin") + 1).cast("int"), (F.col("p.end") - F.col("p.begin")).cast("int")), " ")
    changed = {"text": F.when(part, cut).otherwise(F.col("whole.text")), "n_chars": F.when(part, F.length(cut)).otherwise(F.col("whole.n_chars")) if "n_chars" in names else None}
    return taken.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col("whole").getField(c).alias(c) for c in names])
