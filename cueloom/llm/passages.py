"""Substring dedup: removes the words of passages that a document with a smaller id has too.

Method: fixed-block anchors. Every document's words are cut into blocks of BLOCK words that do not overlap; these
reference blocks are the index. Every rolling window of BLOCK words probes it. A passage of WINDOW = 2 * BLOCK - 1
words holds a whole reference block wherever it starts, so a passage that two documents share is hit in both. Hits are
extended to all windows of WINDOW words around them, of which the smallest id decides, and the windows that are
found elsewhere make up the maximal exact repeats.

Blocks are matched by 48 bits and windows by another hash of 64 bits over the words' 64-bit hashes; a word goes
only if both agree. A false agreement of windows is expected below once in 2 ** 64 / (distinct repeated windows)
windows. See `chunks` for how the work is dealt out; pairs of documents are never formed.

Cases: null and empty texts have no words; rows of one id are not smaller than each other and so keep what only they
share; a null id counts as larger than any other; long texts are one row of a chunk; a table without rows gives none;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cueloom.llm import chunks
from cueloom.llm.chunks import Distinct
from cueloom.llm.rolling import packed48, unpacked48, window_hashes, word_hashes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
KEY7, KEY13 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
UPPER48 = np.uint64(0xFFFFFFFFFFFF0000)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept binary"


class Words:
    """The words of a chunk: of which row each is, and hashes of blocks and windows that stay within a row."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
        begins, ends = np.flatnonzero(inside == -1), np.flatnonzero(inside == 1)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.row = np.searchsorted(starts, begins, "right") - 1
        self.hashes = word_hashes(raw, begins, ends)
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all rolling windows of BLOCK words."""
        return self._windows(BLOCK, KEY7)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return self._windows(WINDOW, KEY13)

    def _windows(self, n: int, key: int) -> tuple[np.ndarray, np.ndarray]:
        m = max(0, len(self.row) - n + 1)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 : n - 1 + m])
        return at, window_hashes(self.hashes, n, key)[at]

    def index(self) -> tuple[np.ndarray, Distinct, np.ndarray, np.ndarray]:
        """Places of rolling windows, their distinct hashes, and of these which are reference blocks and which two rows have."""
        at, h = self.blocks()
        d = Distinct(h & UPPER48)
        row = self.row[at]
        return at, d, d.any((at - self.first[row]) % BLOCK == 0), d.least(row) != d.most(row)

    def candidates(self, hit: np.ndarray, at: np.ndarray, d: Distinct) -> tuple[np.ndarray, Distinct]:
        """Places of the windows that hold a hit, and their distinct hashes."""
        hits = np.zeros(len(self.row) + 1, np.int64)
        hits[at + 1] = d.spread(hit)
        hits = np.cumsum(hits)
        places, h = self.windows()
        near = hits[places + WINDOW - BLOCK + 1] > hits[places]
        return places[near], Distinct(h[near])


def _probe(buckets: int):
    def send(key, table):
        _, d, reference, many = Words(chunks.texts_of(table)).index()
        out = [(b, s.stop - s.start, packed48(d.values[s]), chunks.bits(reference[s]), chunks.bits(many[s])) for b, s in chunks.by_bucket(d.values, buckets)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]
        return pa.table([columns[0], pa.array([key[0].as_py()] * len(out), pa.int32()), *columns[1:]], ["bucket", "chunk", "n", "hashes", "reference", "many"])

    return send


def _hits(key, table):
    """Which blocks are a reference block somewhere and stand in two rows."""
    rows = table.to_pydict()
    d = Distinct(np.concatenate([unpacked48(x) for x in rows["hashes"]]))
    flags = lambda name: d.any(np.concatenate([chunks.flags_of(x, n) for x, n in zip(rows[name], rows["n"], strict=True)]))
    hit = flags("reference") & (flags("many") | (d.counts() > 1))
    return chunks.answer_rows(rows["chunk"], 0, key[0].as_py(), rows["n"], d.spread(hit))


def _extend(buckets: int):
    def send(key, table, found):
        words = Words(chunks.texts_of(table))
        at, d, _, _ = words.index()
        places, c = words.candidates(chunks.answers(found, 0, len(d.values)), at, d)
        low = c.least(chunks.ids_of(table)[words.row[places]])
        pack = zstandard.ZstdCompressor(level=1).compress
        out = [(b, s.stop - s.start, c.values[s].astype("<u8").tobytes(), pack(low[s].astype("<i8").tobytes())) for b, s in chunks.by_bucket(c.values, buckets)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
        number = table.column("chunk")[0].as_py() if table.num_rows else 0
        return pa.table([columns[0], pa.array([number] * len(out), pa.int32()), *columns[1:]], ["bucket", "chunk", "n", "hashes", "low"])

    return send


def _smaller(key, table):
    """Which windows a document has whose id is smaller than any of the chunk that asks."""
    rows = table.to_pydict()
    unpack = zstandard.ZstdDecompressor().decompress
    low = np.concatenate([np.frombuffer(unpack(x), "<i8") for x in rows["low"]])
    d = Distinct(np.concatenate([np.frombuffer(x, "<u8") for x in rows["hashes"]]))
    return chunks.answer_rows(rows["chunk"], 1, key[0].as_py(), rows["n"], d.spread(d.least(low)) < low)


def _remove(key, table, found):
    texts = chunks.texts_of(table)
    words = Words(texts)
    ids = chunks.ids_of(table)
    at, d, _, _ = words.index()
    places, c = words.candidates(chunks.answers(found, 0, len(d.values)), at, d)
    owner = ids[words.row[places]]
    gone = c.spread(chunks.answers(found, 1, len(c.values))) | (owner > c.spread(c.least(owner)))
    removed = chunks.covered(places[gone], WINDOW, len(words.row))
    out = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
    for r, text in enumerate(texts):
        mine = removed[words.first[r] : words.first[r + 1]]
        tokens = text.split()
        first, last = chunks.runs(mine)
        out["n_words"].append(len(tokens))
        out["n_removed"].append(int(mine.sum()))
        out["spans"].append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        out["kept"].append(b" ".join([tokens[i] for i in np.flatnonzero(~mine)] if len(first) else tokens))
    long = pa.int64()
    types = {"n_words": long, "n_removed": long, "spans": pa.list_(pa.struct([("first", long), ("last", long)])), "kept": pa.binary()}
    return pa.table({"doc_id": table.column("doc_id")} | {c: pa.array(out[c], t) for c, t in types.items()})


def _digest(key, table, found):
    whole = _remove(key, table, found)
    sums = pa.array([hashlib.sha256(x).hexdigest() for x in whole.column("kept").to_pylist()], pa.string())
    return whole.select(["doc_id", "n_words", "n_removed"]).append_column("kept_sha256", sums)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (of words removed) and kept (the text left, in UTF-8), for each row of docs; with digest, kept_sha256 for the last two."""
    n = chunks.parts(docs)
    rows = chunks.chunked(docs, n)
    probes = rows.groupBy("chunk").applyInArrow(_probe(n), "bucket int, chunk int, n long, hashes binary, reference binary, many binary")
    hits = probes.groupBy("bucket").applyInArrow(_hits, chunks.ANSWER)
    windows = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(n), "bucket int, chunk int, n long, hashes binary, low binary")
    both = hits.unionByName(windows.groupBy("bucket").applyInArrow(_smaller, chunks.ANSWER))
    last, schema = (_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string") if digest else (_remove, RESULT)
    return rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(last, schema)
