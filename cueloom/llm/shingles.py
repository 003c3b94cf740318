"""Near copies of documents: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

What `simhash.one_of_each` links by when it is given a similarity. Candidates come from MinHash: BANDS keys a text, each
of ROWS minima over its shingles, so two texts at similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS:
0.999993 at 0.8, more above. Of the texts of a bucket, SimHash fingerprints of the sets are compared in tiles: pairs that
differ in more than WIDE of 64 bits are ruled out (at 0.8 some 10 differ, at random 32). Every link is then verified by
the shingles themselves (64-bit hashes of them), so no pair below the similarity is linked. Equal sets become one node
before that.

The texts of a bucket are first compared with one of them, its centre; then buckets whose texts are not all in
one component are compared whole, in groups of at most two parts of PART texts. `components` joins the links.
One document of a component stays, so one may go that is below the similarity to the one that stays, by links over others.

Cases: texts without words are equal; a text of fewer than five words is one shingle; very long texts are hashed in
pieces; a bucket of any size is dealt out; no links give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import stored, with_key_of
from cueloom.llm.components import components
from cueloom.llm.hamming import TO_LOWER, bit_counts, majority, tiles

SHINGLE, BANDS, ROWS, SEED = 5, 30, 5, 42
WIDE, TILE = 26, 512
PART, PIECE = 512, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_XOR, _TIMES = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_TIMES = _TIMES | np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The hashes of the different shingles of a text, in order."""
    from xxhash import xxh64_intdigest as h

    tokens = (text or b"").translate(TO_LOWER).split()  # of bytes: at \x20 and \x09 to \x0D only
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(h, tokens), np.uint64, len(tokens))
    n = min(n, len(w))
    out = np.full(len(w) - n + 1, SEED, np.uint64)
    for j in range(n):
        out = _stir(out + w[j : len(w) - n + 1 + j])
    return np.unique(out)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band; none for a text without shingles."""
    if not len(s):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), PIECE):
        low = np.minimum(low, ((s[at : at + PIECE, None] ^ _XOR) * _TIMES).min(axis=0))
    low = low.reshape(BANDS, ROWS)
    out = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        out = _stir(out + low[:, j])
    return out.view(np.int64)


def prints(docs: DataFrame, keys: Sequence[Column] = ()) -> DataFrame:
    """doc_id, the long columns of keys, h (a hash of the text), node (a hash of its shingles) and bands (its keys), for each row of docs."""
    asked = docs.select("doc_id", "text", *keys, F.xxhash64("text").alias("h"))
    others = [c for c in asked.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as hash_of

        for batch in batches:
            nodes, bands = [], []
            for t in batch.column("text").cast(pa.binary()):
                s = shingles(t.as_py())
                nodes.append(hash_of(s.tobytes(), SEED))
                bands.append(band_keys(s))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], [*others, "node", "bands"])

    return asked.mapInArrow(run, ", ".join([*(f"{c} long" for c in [*others, "node"]), "bands array<long>"]))


def _sketch(s: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), 32 * PIECE):
        counts += bit_counts(s[at : at + 32 * PIECE])
    return majority(counts, len(s))


def _near(sets: list[np.ndarray], label: np.ndarray, similarity: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links that join texts of different labels; with them, label tells the components."""
    sketches = np.array([_sketch(s) for s in sets], np.uint64)
    order = np.argsort(np.bitwise_count(sketches), kind="stable")
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(max(int(x.max()) for x in ids if len(x)) + 1, np.int64)
    part, whole = similarity
    for a, b, near in tiles(sketches[order], WIDE, TILE):
        for i, row in zip(order[a : a + TILE], near, strict=True):
            others = order[b : b + TILE][row]
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            mark[ids[i]] = 1
            for j in others:
                # common / (both - common) >= part / whole, in whole numbers
                if label[i] != label[j] and (part + whole) * int(mark[ids[j]].sum()) >= part * int(sizes[i] + sizes[j]):
                    label[label == label[j]] = label[i]
                    yield int(i), int(j)
            mark[ids[i]] = 0


def _links(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal g, p and q; the rows come sorted by these."""
    key, nodes, roots, sets = None, [], [], []

    def linked() -> pa.RecordBatch:
        pairs = list(_near(sets, np.unique(roots, return_inverse=True)[1], similarity)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for *new, node, root, text in zip(*(batch.column(c).to_pylist() for c in ("g", "p", "q", "node", "root")), batch.column("text").cast(pa.binary()), strict=True):
            if new != key:
                yield linked()
                key, nodes, roots, sets = new, [], [], []
            nodes.append(node)
            roots.append(root)
            sets.append(shingles(text.as_py()))
    yield linked()


def _compared(groups: DataFrame, texts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """groups: g, p, q, node and root."""
    rows = groups.join(texts, "node").select("g", "p", "q", "node", "root", "text")
    return rows.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q").mapInArrow(lambda batches: _links(batches, similarity), "a long, b long")


def links(docs: DataFrame, prints: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a and b: verified links, enough to tell every component of the nodes of prints."""
    nodes = stored(prints.groupBy("node").agg(F.min("h").alias("h"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", "h", F.posexplode("bands").alias("k", "key"))
    shared = stored(rows.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1"), "shared-keys")
    total = shared.agg(F.sum("n")).first()[0] or 0
    joined = with_key_of(rows, shared.withColumn("all", F.col("n")), ["k", "key"], "n", total)
    members = stored(joined.select(F.xxhash64("k", "key").alias("g"), F.col("all").alias("n"), "centre", "node", "h"), "members")
    needed = members.select("node", "h").distinct()
    texts = stored(docs.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).join(needed, "h").select("node", "text"), "texts")

    star = members.where("node <> centre").groupBy("centre", "node").agg(F.max("n").alias("n"))
    star = star.select(F.xxhash64("centre", "n").alias("g"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)).alias("p"), F.lit(0).alias("q"), "centre", "node")
    star = star.drop("centre").unionByName(star.drop("node").withColumnRenamed("centre", "node").distinct()).withColumn("root", F.col("node"))
    first = stored(_compared(star, texts, similarity), "star-links")

    roots = components(first).withColumnRenamed("node", "of")
    members = stored(members.join(roots, F.col("node") == F.col("of"), "left").select("g", "n", "node", F.coalesce("root", "node").alias("root")), "rooted-members")
    # Buckets of the same texts are compared once.
    digest = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("digest")
    open_ = members.groupBy("g").agg(F.min("root").alias("r"), F.max("root").alias("s"), digest, F.count("*").alias("n")).where("r <> s").groupBy("digest", "n").agg(F.min("g").alias("g"))
    mine = with_key_of(members, stored(open_.select("g", F.col("n").alias("m")), "open-buckets"), "g", "m", total).withColumn("parts", F.ceil(F.col("n") / PART)).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    whole = _compared(mine.select("g", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "root"), texts, similarity)
    return first.unionByName(stored(whole, "bucket-links"))
