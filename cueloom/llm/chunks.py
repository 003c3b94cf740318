"""Chunks of documents and buckets of hashes: what the substring operators share.

A chunk holds the rows whose id (or text, without one) falls into it, a few MB of whole texts. A chunk sends each
bucket one row, with the distinct hashes it has there in ascending order, packed; so what many documents of a chunk
have in common counts once, and a bucket's size is set by distinct hashes, not by copies. A bucket answers with one
bit for each hash, in that order, and the chunk finds the same order again from its texts: nothing depends on the
order in which rows arrive. Texts are shuffled once, as every step groups them by the same key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.rolling import bucket_of

CHUNK_BYTES = 6 << 20
NO_ID = np.iinfo(np.int64).max
ANSWER = "chunk int, kind int, bucket int, n long, bits binary"


def parts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks, and buckets, the texts make."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes))


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """chunk, doc_id and text (as bytes) of each row."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def texts_of(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").to_pylist()]


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids; none counts as the largest."""
    return table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)


class Distinct:
    """Hashes sorted, with the reductions over equal ones that the operators need."""

    def __init__(self, h: np.ndarray):
        self.order = np.argsort(h, kind="stable")
        ordered = h[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(h) else np.empty(0, np.int64)
        self.values = ordered[self.first]

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags[self.order], self.first) if len(self.first) else np.empty(0, bool)

    def least(self, x: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(x[self.order], self.first) if len(self.first) else x[:0]

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x[self.order], self.first) if len(self.first) else x[:0]

    def counts(self) -> np.ndarray:
        return np.diff(np.concatenate((self.first, [len(self.order)])))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """For each hash, as given, the value of x at its distinct one."""
        out = np.empty(len(self.order), x.dtype)
        out[self.order] = np.repeat(x, self.counts())
        return out


def by_bucket(values: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets that sorted hashes fall into, with their run of hashes."""
    b = bucket_of(values, buckets).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.empty(0, np.int64)
    return [(int(b[lo]), slice(int(lo), int(hi))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def answers(table: pa.Table, kind: int, n: int) -> np.ndarray:
    """The n flags of one kind that the buckets sent, in the order of the hashes."""
    rows = sorted((b, k, x) for kd, b, k, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "n", "bits")), strict=True) if kd == kind)
    out = np.concatenate([np.empty(0, bool), *(flags_of(x, k) for _, k, x in rows)])
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} hashes")
    return out


def answer_rows(chunks: list[int], kind: int, bucket: int, counts: list[int], flags: np.ndarray) -> pa.Table:
    """Rows of ANSWER: flags, cut again as the chunks sent their hashes."""
    cuts = np.cumsum([0, *counts])
    data = [bits(flags[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    k = len(chunks)
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "kind": pa.array([kind] * k, pa.int32()), "bucket": pa.array([bucket] * k, pa.int32()), "n": pa.array(counts, pa.int64()), "bits": pa.array(data, pa.binary())})


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of total places a run of length from any of starts covers."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, total), -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each maximal run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]
