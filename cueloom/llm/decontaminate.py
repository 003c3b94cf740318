"""Benchmark decontamination: one Aho-Corasick automaton over the words of the test items.

The symbols of the automaton are words: each distinct word of the benchmark has a character of its own, and any
other word is one that no pattern has. A window of WINDOW words of an item (or a shorter item as a whole) is a
pattern. Each text is scanned once; a match ends at a word, whose place in the original text is known.

The items go to the executors as a broadcast of checked size: at most MOST_WORDS words, which one automaton holds in
the memory that a worker has. Each worker builds it once and keeps it for its later tasks. A benchmark beyond that is
worked through in blocks, each a pass over the table that the one before it wrote. Documents are never shuffled.

`report` tells what the items cover; `clean` takes out documents, by a rule of its own (see there).

Cases: a null or empty text has no words and is clean; a benchmark item without words, or a null one, gives no
window; items without an id still hit words, but are not counted as items; equal items and repeated rows count
for each id once; an item longer than a block is cut into pieces that share no less than a window; an empty benchmark
leaves everything clean; other columns, of any name and type, are passed through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from cueloom.llm.common import named, stored

WINDOW = 13
MOST_WORDS = 200_000
#: Bytes of UTF-8: A-Z to lower case, other ASCII marks and controls to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        patterns: dict[str, set[str]] = {}
        for name, text in items:
            tokens = text.translate(NORMAL).split()
            symbols = "".join([self.codes.setdefault(t, chr(len(self.codes) + 1 + 2048 * (len(self.codes) >= 0xD7FF))) for t in tokens])
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                patterns.setdefault(symbols[i : i + window], set()).update(() if name is None else (name,))
        self.machine = ahocorasick.Automaton()
        for p, names in patterns.items():
            self.machine.add_word(p, (len(p), names))
        self.any = bool(patterns)
        if self.any:
            self.machine.make_automaton()

        self.window = window

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str], bool]:
        """The number of words, the runs of words that matches cover (first, last + 1), the items that match, and whether one matches by a whole window."""
        tokens = text.translate(NORMAL).split()
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        longest = 0
        if self.any:
            for end, (n, found) in self.machine.iter("".join(map(self.codes.get, tokens, repeat("\0")))):
                runs.append((end + 1 - n, end + 1))
                names |= found
                longest = max(longest, n)
        return len(tokens), _merged(runs), names, longest == self.window


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as runs of code points of the original text, from the first word's start to the last one's end."""
    if not runs:
        return []
    raw = np.frombuffer(text.translate(NORMAL), np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[begins[lo]]), int(points[ends[hi - 1]])) for lo, hi in runs]


def _blocks(benchmark: DataFrame, most_words: int, window: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Lists of items, or of overlapping pieces of long ones, of at most most_words words each."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text")).where("text is not null").toLocalIterator():
        tokens = bytes(r["text"]).translate(NORMAL).split()
        step = max(1, most_words - window + 1)
        for at in range(0, max(1, len(tokens) - window + 1), step):
            piece = tokens[at : at + step + window - 1]
            if block and n + len(piece) > most_words:
                yield block
                block, n = [], 0
            block.append((r["id"], b" ".join(piece)))
            n += len(piece)
    if block:
        yield block


def _of(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, LongType()) for n in names]))


FOUND = StructType([StructField("n_words", LongType()), StructField("runs", _of("first", "last")), StructField("spans", _of("start", "end")), StructField("items", ArrayType(StringType())), StructField("whole_window", BooleanType())])


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """For each row of docs: row (a struct of its columns, or of those in keep), n_words, runs (of words, from 0), spans (of code points), items, the sorted ids of the items with matches,
    and whole_window, whether any match is one of window words (not of a shorter item)."""
    blocks = _blocks(benchmark, most_words, window)
    block, following = next(blocks, []), next(blocks, None)
    kept = F.struct(*[named(c) for c in (docs.columns if keep is None else keep)])
    none = [F.array().cast(FOUND[c].dataType).alias(c) for c in ("runs", "items")]
    out = docs.select(kept.alias("row"), F.col("text").cast("binary").alias("text"), *none, F.lit(False).alias("whole_window"))
    while True:
        out = _pass(out, block, window, last=following is None)
        if following is None:
            return out
        out, block, following = stored(out, "decontaminate").select("row", "text", "runs", "items", "whole_window"), following, next(blocks, None)


#: The automaton that this worker has built last, under the key of its list of items.
_BUILT: dict[str, Automaton] = {}


def _pass(df: DataFrame, items: list[tuple[str | None, bytes]], window: int, last: bool) -> DataFrame:
    """One automaton over every text; text stays for a next pass unless this is the last one."""
    kept = ["row"] if last else ["row", "text"]
    schema = StructType([*df.select(*kept).schema.fields, *FOUND.fields])
    shared, key = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    types = [pa.int64(), *(pa.list_(pa.struct([(n, pa.int64()) for n in x])) for x in (("first", "last"), ("start", "end"))), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(shared.value, window)
        machine = _BUILT[key]
        for batch in batches:
            found: list[tuple] = []
            before = zip(*(batch.column(c).to_pylist() for c in ("runs", "items", "whole_window")), strict=True)
            for value, (old, known, whole) in zip(batch.column("text"), before, strict=True):
                text = value.as_py() or b""
                n, runs, who, now = machine.scan(text)
                runs = _merged([*runs, *((r["first"], r["last"]) for r in old)]) if old else runs
                spans = [{"start": a, "end": b} for a, b in offsets(text, runs)]
                found.append((n, [{"first": a, "last": b} for a, b in runs], spans, sorted({*known, *who}), whole or now))
            columns = zip(*found, strict=True) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, map(list, columns), types)], schema.names)

    return df.mapInArrow(run, schema)


def _hit() -> Column:
    """How many words the matches cover."""
    return F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])


def _contaminated() -> Column:
    return (_hit() > 0) & (20 * _hit() >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for each row of docs."""
    found = scan(docs, benchmark, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, as they are, that hold no window of `window` words of an item, whatever their length.

    Items shorter than that can stand in a text by chance; such a hit takes a document out only if hits cover a twentieth of its words."""
    return scan(docs, benchmark, window=window).where(~F.col("whole_window") & ~_contaminated()).select("row.*")
