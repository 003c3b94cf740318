"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints are made in Arrow batches. Equal ones are joined into one before anything is compared. Two
fingerprints that differ in at most RADIUS of 64 bits agree on all but RADIUS of any blocks of bits, so each one
is put, for every choice of the other blocks, into the bucket of those bits. A bucket is compared exactly, in
numpy tiles sorted by population count: exclusive-or and bit counts for each pair of tiles, and a pair is
skipped if the counts of its tiles lie further apart than the radius, as no link can cross it. More blocks make
more and smaller buckets; their number follows from the number of fingerprints, and every choice finds every link.

A bucket of more than HOT fingerprints is dealt out as pairs of parts, so no task holds it whole. A bucket gives
a spanning forest of its links, not all pairs, and `components` joins those of all buckets.

`one_of_each` keeps a row of each component. Without `similarity` its links are those above. A radius that reaches a
given similarity of shingle sets is too wide for blocks of bits to find (at 0.8 some 10 of 64 bits differ), so with
one `shingles` finds the candidates, the same tiles rule most of them out, and the rest are verified by their shingles.

Cases: a null or empty text, or one without words, has fingerprint 0 and links like any other; rows with equal ids
each get their row; a null id names a component only if it has no other; an empty table gives no rows; very long
texts are hashed in pieces of bounded size; other columns of docs, of any name and type, are passed through by
`one_of_each`, which tells rows apart by all of them and keeps one of rows that are equal in all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm import shingles
from cueloom.llm.common import named, row_key, stored, with_key_of
from cueloom.llm.components import components
from cueloom.llm.hamming import TO_LOWER, bit_counts, majority, tiles

SHINGLE, SEED, RADIUS = 4, 42, 4
TILE, PART, HOT = 512, 16_384, 32_768
PIECE = 65_536


def fingerprint(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest as h

    tokens = (text or b"").translate(TO_LOWER).split()  # of bytes: at \x20 and \x09 to \x0D only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > n:
        begins, ends = begins[: len(tokens) - n + 1], ends[n - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begins), PIECE):
        pairs = zip(begins[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        hashes = np.array([h(joined[a:b], seed) for a, b in pairs], np.uint64)
        counts += bit_counts(hashes)
    return majority(counts, len(begins))


def fingerprints(docs: DataFrame, keys: Sequence[Column] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the long columns of keys, for each row of docs."""
    asked = docs.select("doc_id", "text", *keys)
    others = [c for c in asked.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(fps)], [*others, "fp"])

    return asked.mapInArrow(run, ", ".join(f"{c} long" for c in [*others, "fp"]))


def _roots(fps: np.ndarray, radius: int, split: int | None = None) -> np.ndarray:
    """For each fingerprint the place of the first one that it is linked with, itself included. split: only links from before to after it."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    label = np.arange(len(fps))
    left = order < split if split is not None else None
    for a, b, near in tiles(fps[order], radius, TILE):
        if left is not None:
            near &= left[a : a + TILE, None] != left[None, b : b + TILE]
        for i in np.flatnonzero(near.sum(axis=1) > (1 if a == b and left is None else 0)):
            mine, other = label[a + i], label[b + np.flatnonzero(near[i])]
            for o in np.unique(other[other != mine]):
                low, high = min(mine, o), max(mine, o)
                label[label == high] = low
                mine = low
    out = np.empty(len(fps), np.int64)
    out[order] = order[label]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal k, bits, p and q; the rows come sorted by these. side tells the two parts of a split bucket apart."""
    rest: np.ndarray | None = None

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        key = rows[:, :4]
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            if hi - lo > 1:
                fps = rows[lo:hi, 5]
                whole = rows[lo, 2] == rows[lo, 3]
                root = _roots(fps.view(np.uint64), radius, None if whole else int((rows[lo:hi, 4] == 0).sum()))
                moved = np.flatnonzero(root != np.arange(hi - lo))
                a.append(fps[moved])
                b.append(fps[root[moved]])
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "bits", "p", "q", "side", "fp")])
        rows = rows if rest is None else np.concatenate([rest, rows])
        if not len(rows):
            continue
        open_from = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1] + 1) if (rows[:, :4] != rows[-1, :4]).any() else 0
        rest = rows[open_from:]
        if open_from:
            yield linked(rows[:open_from])
    if rest is not None and len(rest):
        yield linked(rest)


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of blocks to agree on, so many that n even fingerprints leave small buckets."""
    m = next((m for m in range(radius + 1, radius + 4) if n / 2 ** (64 * (m - radius) // m) <= 1024), radius + 4)
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(distinct: DataFrame, n: int) -> DataFrame:
    """a and b: links between the n fingerprints in fp, enough to tell every component."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks(n))])
    rows = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    hot = rows.groupBy("k", "bits").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("k", "bits", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    hot = stored(hot, "hot-buckets")
    if hot.isEmpty():
        dealt = rows.select("k", "bits", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "fp")
    else:
        # Part i of a hot bucket meets every part: once as p of (i, j), once as q of (j, i).
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).otherwise(0)
        mine = rows.join(hot, ["k", "bits"], "left").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        dealt = mine.select("k", "bits", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
    ordered = dealt.repartition("k", "bits", "p", "q").sortWithinPartitions("k", "bits", "p", "q", "side", "fp")
    return ordered.mapInArrow(_links, "a long, b long")


def grouped(prints: DataFrame) -> DataFrame:
    """fp, root (of its component), component, the smallest id of any document in it, and n, the rows of prints (doc_id, fp) that have fp."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fingerprints")
    n = distinct.count()
    roots = components(linked(distinct.select("fp"), n))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n_root"))
    return with_key_of(rooted, lows, "root", "n_root", n).select("fp", "root", "component", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id in reach, for each row of docs."""
    prints = stored(fingerprints(docs), "prints")
    told = with_key_of(prints, stored(grouped(prints), "print-groups"), "fp", "n", prints.count())
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of docs, as it is, of each component: that of the smallest id (nulls last), then of the smallest hash of all columns.

    Links are fingerprints within RADIUS, or, with similarity (a fraction), sets of five-word shingles that are so alike, verified."""
    if similarity is None:
        prints = stored(fingerprints(docs, row_key(docs)).withColumnRenamed("fp", "node"), "prints")
        nodes = stored(prints.select("node").distinct(), "fingerprints")
        links = linked(nodes.select(F.col("node").alias("fp")), nodes.count())
    else:
        prints = stored(shingles.prints(docs, row_key(docs)), "shingle-prints")
        links = shingles.links(docs, prints, similarity)
    # The best row of each node first, so that copies meet in partial aggregates and never in a join.
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "k1", "k2")
    best = prints.select("node", row.alias("row")).groupBy("node").agg(F.min("row").alias("row"))
    roots = components(links).withColumnRenamed("node", "of")
    best = best.join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("row").alias("row"))
    rows = docs.select(*row_key(docs), F.struct(*[named(c) for c in docs.columns]).alias("whole")).groupBy("k1", "k2").agg(F.first("whole").alias("whole"))
    return rows.join(best.select("row.k1", "row.k2"), ["k1", "k2"], "left_semi").select("whole.*")
