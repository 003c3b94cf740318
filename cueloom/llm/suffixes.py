"""Substring dedup by bytes: removes what stands in a string of WINDOW bytes that occurs twice anywhere.

Method: merging Burrows-Wheeler transforms. Each shard of texts has the transform of its own suffixes; the transforms
are merged by refining their interleaving symbol by symbol, which also gives, as the depth at which neighbours part,
the common prefixes, and as the unparted intervals the repeats. Suffixes of all shards are never sorted again.

What goes into the shards is found first, without loss. Each window of WINDOW bytes has an anchor, the first of its
ANCHOR-byte strings with the least hash; equal windows have equal anchors in equal places, so windows whose anchor is
that of no other run of windows are unique. The windows of one anchor in a row make up a strip of text. Strips are cut
into cells by how far into its window the anchor lies, the finer the nearer it is to either end; what all windows of a
cell have in common, the anchor and most of what is around it, is the cell's key. Equal windows have equal keys, so a
passage that very many texts share does not gather what stands around it: that is in the keys. Cells that are equal, as
in copies, settle one another by their hash; what is left are cells that share a key but differ. They alone, each once,
go to the bucket of their key, one shard for each chunk that sends some.

A symbol is SYMBOL bytes, and suffixes proceed by as many, so WINDOW bytes are WINDOW / SYMBOL rounds; a strip holds
SYMBOL interleaved strings, one for each phase. Symbols, keys and cells are compared by 64-bit hashes (anchors, where
only work is at stake, by 48).

Cases: a null or empty text has no bytes; a repeat may lie within one text; rows of equal or null ids are texts like any
other; very long texts are one row of a chunk; a table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cueloom.llm import chunks
from cueloom.llm.chunks import Distinct
from cueloom.llm.rolling import byte_windows, mixed, packed48, unpacked48, window_minima

WINDOW, ANCHOR, SYMBOL = 200, 64, 25
UPPER48 = np.uint64(0xFFFFFFFFFFFF0000)
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept binary"
#: Of an anchor: another strip has it. Of a cell: an equal one exists; others of its key differ; this chunk sends it.
REPEATED, SETTLED, MIXED, SENDER = 0, 1, 2, 3



#: Cells of the anchor's place in a window: from the window's start or end 0, 1, 2 to 3, 4 to 7, ... bytes.
REACH = WINDOW - ANCHOR
_NEAR = np.array([0, 1, *(1 << k for k in range(1, (REACH // 2).bit_length() - 1))])
CELLS = np.unique(np.concatenate((_NEAR, [REACH // 2], REACH + 1 - _NEAR)))
LOW32 = np.uint64(0xFFFFFFFF)


class Strips:
    """The runs of windows with one anchor in the texts of a chunk: row, first and last + 1 window, the anchor's place and value."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.raw = [np.frombuffer(t, np.uint8) for t in texts]
        row, first, last, anchor, hashes, at, self.begin = [], [], [], [], [], 0, np.zeros(len(texts), np.int64)
        for r, raw in enumerate(self.raw):
            if len(raw) < WINDOW:
                continue
            h = byte_windows(raw, ANCHOR)
            # Half of the hash, then the place: the least is the first of equals.
            place = (window_minima((h & ~LOW32) | np.arange(len(h), dtype=np.uint64), REACH + 1) & LOW32).astype(np.int64)
            cut = np.flatnonzero(place[1:] != place[:-1]) + 1
            first.append(np.concatenate(([0], cut)))
            last.append(np.concatenate((cut, [len(place)])))
            anchor.append(place[first[-1]])
            row.append(np.full(len(first[-1]), r))
            hashes.append(h)
            self.begin[r], at = at, at + len(h)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.row, self.first, self.last, self.anchor = (join(x, np.int64) for x in (row, first, last, anchor))
        #: Of all strings of ANCHOR bytes; those of a row from its begin.
        self.h = join(hashes, np.uint64)
        # The least of many hashes are small; mixed once more they fill all buckets alike.
        self.value = mixed(self.h[self.begin[self.row] + self.anchor]) & UPPER48
        self.anchors = Distinct(self.value)

    def repeated(self, flags: np.ndarray) -> Cells:
        """The cells of the strips whose anchor has its flag set."""
        return Cells(self, np.flatnonzero(flags[np.searchsorted(self.anchors.values, self.value)]) if len(self.value) else np.empty(0, np.int64))

    def hash(self, row: np.ndarray, start: np.ndarray, length: np.ndarray, parts: int) -> np.ndarray:
        """A hash of length bytes from start, of parts strings of ANCHOR bytes that cover them."""
        out = np.zeros(len(row), np.uint64)
        for k in range(parts):
            out = mixed(out + self.h[self.begin[row] + start + k * (length - ANCHOR) // (parts - 1)])
        return out


class Cells:
    """Parts of strips with the anchor in one cell of the window: row, first and last + 1 window, key, and a hash of the text."""

    def __init__(self, strips: Strips, chosen: np.ndarray):
        self.texts = strips.texts
        row, first, last, anchor = (x[chosen] for x in (strips.row, strips.first, strips.last, strips.anchor))
        # A window's distance to its anchor falls from anchor - first to anchor - last + 1.
        low = np.searchsorted(CELLS, anchor - last + 1, "right") - 1
        many = np.searchsorted(CELLS, anchor - first, "right") - low
        of = np.repeat(np.arange(len(chosen)), many)
        cell = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        self.row, anchor = row[of], anchor[of]
        near, far = CELLS[cell], CELLS[cell + 1] - 1
        self.first, self.last = np.maximum(first[of], anchor - far), np.minimum(last[of], anchor - near + 1)
        key = strips.hash(self.row, anchor - near, WINDOW - far + near, 4)
        self.both = np.empty(len(of), [("anchor", "<u8"), ("text", "<u8")])
        self.both["anchor"] = mixed(key + cell.astype(np.uint64))
        self.both["text"] = strips.hash(self.row, self.first, self.last - self.first + WINDOW - 1, 5)

    def text(self, i: int) -> bytes:
        return self.texts[self.row[i]][self.first[i] : self.last[i] + WINDOW - 1]

    def distinct(self) -> Pairs:
        """Distinct cells: by key first, so that those of one key share a bucket, then by text."""
        return Pairs(self.both)


class Pairs(Distinct):
    """Distinct pairs of key and text hash, in order."""

    def __init__(self, both: np.ndarray):
        self.order = np.lexsort((both["text"], both["anchor"]))
        ordered = both[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(both) else np.empty(0, np.int64)
        self.values = ordered[self.first]


def _rows(out: list[tuple], number: int, kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
    return pa.table(columns, [k for k, _ in kinds]).append_column("chunk", pa.array([number] * len(out), pa.int32()))


def _chunk(table) -> int:
    return table.column("chunk")[0].as_py() if table.num_rows else 0


def _probe(buckets: int):
    kinds = [("bucket", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary())]

    def send(key, table):
        a = Strips(chunks.texts_of(table)).anchors
        many = a.counts() > 1
        return _rows([(b, s.stop - s.start, packed48(a.values[s]), chunks.bits(many[s])) for b, s in chunks.by_bucket(a.values, buckets)], _chunk(table), kinds).select(["bucket", "chunk", "n", "hashes", "many"])

    return send


def _twice(key, table):
    """Which anchors occur twice."""
    rows = table.to_pydict()
    d = Distinct(np.concatenate([unpacked48(x) for x in rows["hashes"]]))
    many = d.any(np.concatenate([chunks.flags_of(x, n) for x, n in zip(rows["many"], rows["n"], strict=True)]))
    return chunks.answer_rows(rows["chunk"], REPEATED, key[0].as_py(), rows["n"], d.spread(many | (d.counts() > 1)))


def _strips(buckets: int):
    kinds = [("bucket", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary())]

    def send(key, table, found):
        s = Strips(chunks.texts_of(table))
        d = s.repeated(chunks.answers(found, REPEATED, len(s.anchors.values))).distinct()
        many = d.counts() > 1
        out = [(b, k.stop - k.start, d.values[k].tobytes(), chunks.bits(many[k])) for b, k in chunks.by_bucket(d.values["anchor"], buckets)]
        return _rows(out, _chunk(table), kinds).select(["bucket", "chunk", "n", "hashes", "many"])

    return send


def _settle(key, table):
    """Which cells have an equal one; whose keys have different cells; and which chunk sends each of those."""
    rows = table.to_pydict()
    both = np.concatenate([np.frombuffer(x, [("anchor", "<u8"), ("text", "<u8")]) for x in rows["hashes"]])
    d = Pairs(both)
    settled = d.any(np.concatenate([chunks.flags_of(x, n) for x, n in zip(rows["many"], rows["n"], strict=True)])) | (d.counts() > 1)
    # Cells that are all settled, or one alone, have nothing to find out: windows of one cell differ.
    groups = Distinct(d.values["anchor"])
    differ = groups.spread(groups.any(~settled) & (groups.counts() > 1))
    chunk = np.repeat(np.array(rows["chunk"], np.int64), rows["n"])
    sender = chunk == d.spread(d.least(chunk))
    tell = lambda kind, flags: chunks.answer_rows(rows["chunk"], kind, key[0].as_py(), rows["n"], flags)
    return pa.concat_tables([tell(SETTLED, d.spread(settled)), tell(MIXED, d.spread(differ)), tell(SENDER, sender)])


def _shards(buckets: int):
    kinds = [("bucket", pa.int32()), ("n", pa.int64()), ("strips", pa.binary())]

    def send(key, table, found):
        s = Strips(chunks.texts_of(table))
        cells = s.repeated(chunks.answers(found, REPEATED, len(s.anchors.values)))
        d = cells.distinct()
        asked, sender = (chunks.answers(found, k, len(d.values)) for k in (MIXED, SENDER))
        one = d.order[d.first]
        out = []
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, k in chunks.by_bucket(d.values["anchor"], buckets):
            sent = k.start + np.flatnonzero((asked & sender)[k])
            if len(sent):
                texts = [cells.text(i) for i in one[sent]]
                lengths = np.array([len(t) for t in texts], "<u4").tobytes()
                out.append((b, len(sent), pack(lengths + b"".join(texts))))
        return _rows(out, _chunk(table), kinds).select(["bucket", "chunk", "n", "strips"])

    return send


class Shard:
    """The Burrows-Wheeler transform of some strips, each followed by its end: bwt holds, suffix by suffix in order, the
    symbol before it (0: none), and place where the suffix starts; left is how much of its strip a place has before it."""

    def __init__(self, strips: list[bytes], rounds: int):
        lengths = np.array([len(t) + 1 for t in strips])
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        place = np.arange(total)
        self.left = np.repeat(ends, lengths) - 1 - place
        behind = place - np.repeat(ends - lengths, lengths)
        # Fewer than SYMBOL bytes are an end, one for each phase of a strip.
        full = np.flatnonzero(self.left >= SYMBOL)
        symbol = np.zeros(total, np.uint64)
        symbol[full] = byte_windows(np.frombuffer(b"\0".join([*strips, b""]), np.uint8), SYMBOL)[full] | np.uint64(1)
        ranks = Distinct(symbol)
        span = 1
        while True:
            rank = ranks.spread(np.arange(len(ranks.values), dtype=np.uint64))
            if span >= rounds:
                break
            step = min(span, rounds - span)
            further = np.zeros(total, np.uint64)
            inside = np.flatnonzero(self.left >= step * SYMBOL)
            further[inside] = rank[inside + step * SYMBOL] + np.uint64(1)
            ranks = Distinct((rank << np.uint64(32)) | further)
            span += step
        self.place = ranks.order
        before = np.zeros(total, np.uint64)
        back = np.flatnonzero(behind >= SYMBOL)
        before[back] = symbol[back - SYMBOL]
        self.bwt = before[self.place]


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleaving of the transforms' suffixes in order of their first symbols, as the shard of each, and which of
    them still agree with the one before them after all rounds.

    Each round deals the suffixes out again, stably, by the symbol before them: who then follows whom is the order by
    one symbol more. A suffix without a symbol before it starts a string; its round trip goes to the bin of ends, whose
    members are as many, so the shards' suffixes stay whole."""
    sizes = [len(t) for t in transforms]
    joined = np.concatenate(transforms)
    symbols = np.unique(joined, return_inverse=True)[1].astype(np.uint32)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.uint32), sizes)
    block = np.zeros(len(joined), np.int64)
    for _ in range(rounds):
        here = np.empty(len(joined), np.uint32)
        here[np.argsort(shard, kind="stable")] = symbols
        dealt = np.argsort(here, kind="stable")
        shard, here, block = shard[dealt], here[dealt], block[dealt]
        parted = np.concatenate(([True], (here[1:] != here[:-1]) | (block[1:] != block[:-1]))) if len(here) else np.empty(0, bool)
        block = np.cumsum(parted)
    return shard, np.concatenate(([False], block[1:] == block[:-1])) if len(block) else np.empty(0, bool)


def repeats(shards: list[list[bytes]]) -> list[np.ndarray]:
    """For each shard's joined text the places where WINDOW bytes start that some strip of any shard has elsewhere."""
    rounds = WINDOW // SYMBOL
    made = [Shard(s, rounds) for s in shards]
    order, agrees = merge([m.bwt for m in made], rounds)
    inside = agrees | np.concatenate((agrees[1:], [False]))
    out = []
    for k, m in enumerate(made):
        flags = np.zeros(len(m.place), bool)
        flags[m.place[inside[order == k]]] = True
        out.append((flags & (m.left >= WINDOW))[m.left > 0])
    return out


def _merge(key, table):
    """For each chunk, with a bit for each window of the strips that it sent, which windows occur twice."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "n", "strips")), strict=True))
    unpack = zstandard.ZstdDecompressor().decompress
    shards = []
    for _, n, data in rows:
        data = unpack(data)
        cuts = np.cumsum([4 * n, *np.frombuffer(data, "<u4", n)])
        shards.append([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    k = len(rows)
    sent = [chunks.bits(f) for f in repeats(shards)]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([4] * k, pa.int32()), "bucket": pa.array([key[0].as_py()] * k, pa.int32()), "n": pa.array([sum(map(len, s)) for s in shards], pa.int64()), "bits": pa.array(sent, pa.binary())})


def _remove(key, table, found):
    texts = chunks.texts_of(table)
    s = Strips(texts)
    cells = s.repeated(chunks.answers(found, REPEATED, len(s.anchors.values)))
    d = cells.distinct()
    settled, asked, sender = (chunks.answers(found, k, len(d.values)) for k in (SETTLED, MIXED, SENDER))
    one = d.order[d.first]
    sent = np.flatnonzero(asked & sender)
    lengths = cells.last[one[sent]] - cells.first[one[sent]] + WINDOW - 1
    flags = chunks.answers(found, 4, int(lengths.sum()))
    cuts = np.cumsum([0, *lengths])
    # Bytes of all texts in a row: how many more repeated windows cover each than the one before it.
    base = np.cumsum([0, *map(len, texts)])
    change = np.zeros(base[-1] + 1, np.int32)
    same = np.flatnonzero(d.spread(settled))
    np.add.at(change, base[cells.row[same]] + cells.first[same], 1)
    np.add.at(change, base[cells.row[same]] + cells.last[same] + WINDOW - 1, -1)
    # The others occur once each, and that place is here.
    of = np.repeat(np.arange(len(sent)), lengths)
    hit = np.flatnonzero(flags & ~settled[sent][of])
    i = one[sent[of[hit]]]
    at = base[cells.row[i]] + cells.first[i] + hit - cuts[of[hit]]
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    removed = np.cumsum(change[:-1]) > 0
    out = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
    for r, text in enumerate(texts):
        gone = removed[base[r] : base[r + 1]]
        first, last = chunks.runs(gone)
        out["n_bytes"].append(len(text))
        out["n_removed"].append(int(gone.sum()))
        out["spans"].append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        out["kept"].append(s.raw[r][~gone].tobytes() if len(first) else text)
    long = pa.int64()
    types = {"n_bytes": long, "n_removed": long, "spans": pa.list_(pa.struct([("first", long), ("last", long)])), "kept": pa.binary()}
    return pa.table({"doc_id": table.column("doc_id")} | {c: pa.array(out[c], t) for c, t in types.items()})


def _digest(key, table, found):
    whole = _remove(key, table, found)
    spans = pa.array([len(x) for x in whole.column("spans").to_pylist()], pa.int64())
    sums = pa.array([hashlib.sha256(x).hexdigest() for x in whole.column("kept").to_pylist()], pa.string())
    return whole.select(["doc_id", "n_bytes", "n_removed"]).append_column("n_spans", spans).append_column("kept_sha256", sums)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of bytes removed) and kept (the bytes left), for each row of docs; with digest, n_spans and kept_sha256 for the last two."""
    n = chunks.parts(docs)
    rows = chunks.chunked(docs, n)
    by_chunk = lambda df: df.groupBy("chunk")
    sent = "bucket int, chunk int, n long, hashes binary, many binary"
    anchors = by_chunk(rows).applyInArrow(_probe(n), sent).groupBy("bucket").applyInArrow(_twice, chunks.ANSWER)
    strips = by_chunk(rows).cogroup(by_chunk(anchors)).applyInArrow(_strips(n), sent)
    told = anchors.unionByName(strips.groupBy("bucket").applyInArrow(_settle, chunks.ANSWER))
    shards = by_chunk(rows).cogroup(by_chunk(told)).applyInArrow(_shards(n), "bucket int, chunk int, n long, strips binary")
    told = told.unionByName(shards.groupBy("bucket").applyInArrow(_merge, chunks.ANSWER))
    last, schema = (_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string") if digest else (_remove, RESULT)
    return by_chunk(rows).cogroup(by_chunk(told)).applyInArrow(last, schema)
