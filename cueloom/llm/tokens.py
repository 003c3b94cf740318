"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is one shard of the documents in ascending id order:

    frame, frame, ...     FRAME_IDS ids each but the last one, little-endian, 2 bytes an id or 4 for large vocabularies
    skippable frame       the document index: a JSON header, then ids, null marks and token counts, compressed
    skippable frame       the seek table: for each frame its compressed and decompressed size and a checksum (the low
                          32 bits of XXH64 of the ids), then the number of frames, a descriptor and the magic number

which is the public seekable layout of zstandard, so its tools read the ids too. Documents are found by their place
among the shard's ids; `read_documents` decompresses only the frames that hold those asked for and verifies them.

Writing: documents are range-partitioned by id (and a hash of the text, which parts rows of a repeated id), sorted
within each partition and encoded in Arrow batches; each partition gives one value, which Spark's text writer puts
in a file of its own. So files are committed by Spark, once, wherever Hadoop's file systems reach, and a lost
executor only repeats its shard. The writer ends a value with a line separator, here the table's magic number.

Encoding: a tokenizer that drops white space encodes what stands between it piece by piece, so each piece is encoded by
the library once and remembered, up to MOST_PIECES; with any other tokenizer whole texts are encoded. Pieces of ASCII and
Latin-1 letters alone, which normalization only lowers, are split here and their words go straight to the library's
model; all others go through the library as a whole. A Python worker keeps its encoder from task to task.

Cases: a null or empty text has no ids but the end id; null ids of documents come first, rows with equal ids in the
order of a hash of their texts; an empty table gives no files and no rows; other columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.llm.common import shared_path, stored

END_ID = 2
FRAME_IDS = 65_536
SHARD_BYTES = 16 << 20
MOST_PIECES = 400_000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The magic number as the text writer's line separator, of one byte a character.
MAGIC = struct.pack("<I", SEEKABLE).decode("latin-1")


#: How a tokenizer has to normalize and split for white space to be dropped and plain pieces to be split here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LETTERS = re.compile("[A-Za-z]*[.,;:!?]?")
MARKS = (b".", b",", b";", b":", b"!", b"?")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Words(dict):
    """The ids of each word that the model was asked for."""

    def __init__(self, tokenizer, pack: Callable[[list[int]], bytes]):
        from tokenizers.pre_tokenizers import ByteLevel

        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))]
        self.tokenize, self.pack, self.table = tokenizer.model.tokenize, pack, {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.pack([t.id for t in self.tokenize(word if word.isascii() else word.translate(self.table))])
        return ids


class Pieces(dict):
    """The ids of each piece between white space."""

    def __init__(self, encode: Callable[[str], bytes], words: Words, added: list[str]):
        self.encode, self.words = encode, words
        # Within letters and a mark behind them no added token can stand, if each has another sign.
        self.letters = all(not LETTERS.fullmatch(t) for t in added)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def __missing__(self, piece: bytes) -> bytes:
        if self.letters and piece.isalpha():  # of bytes: ASCII letters
            ids = self.words[piece.decode("ascii").lower()]
        elif self.letters and piece[-1:] in MARKS and piece[:-1].isalpha():
            ids = self.words[piece[:-1].decode("ascii").lower()] + self.words[chr(piece[-1])]
        else:
            s = piece.decode("utf-8", "replace")
            if PLAIN.fullmatch(s) and not self.added.search(s):
                ids = b"".join([self.words[w] for w in PLAIN_WORDS.findall(s.lower())])
            else:
                ids = self.encode(s)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts, as bytes of dtype."""

    def __init__(self, tokenizer_file: str, most_pieces: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        part = lambda x, name: json.loads(x.__getstate__()).get(name) if x is not None else None
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.by_piece = part(t.normalizer, "normalizers") == NORMALIZERS and part(t.pre_tokenizer, "pretokenizers") == SPLITTERS and not any(SPACED.search(x) for x in added)
        self.words = Words(t, self.pack)
        self.known = Pieces(self.encode, self.words, added)
        self.most = most_pieces

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if self.dtype.itemsize > 2 else struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        end = self.pack([END_ID])
        for text in texts:
            if not self.by_piece:
                yield self.encode(text.decode("utf-8", "replace")) + end
                continue
            for cache in (self.known, self.words):
                if len(cache) > self.most:
                    cache.clear()
            yield b"".join([*map(self.known.__getitem__, text.split()), end])


#: White space within an added token would be lost with the pieces.
SPACED = re.compile(r"\s")


@lru_cache(maxsize=1)
def encoder_of(tokenizer_file: str) -> Encoder:
    """This worker's encoder."""
    return Encoder(tokenizer_file)


class ShardWriter:
    """Frames of ids as they come; finish() gives the file's bytes."""

    def __init__(self, shard: int, dtype: np.dtype, level: int = 3):
        import zstandard

        self.shard, self.dtype, self.out, self.open, self.table = shard, dtype, [], bytearray(), []
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.ids, self.nulls, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.open += ids
        size = FRAME_IDS * self.dtype.itemsize
        while len(self.open) >= size:
            self._frame(bytes(self.open[:size]))
            del self.open[:size]

    def _frame(self, raw: bytes) -> None:
        from xxhash import xxh64_intdigest

        packed = self.compressor.compress(raw)
        self.out.append(packed)
        self.table.append((len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def finish(self) -> bytes:
        if self.open:
            self._frame(bytes(self.open))
        head = json.dumps({"shard": self.shard, "dtype": self.dtype.str, "frame_ids": FRAME_IDS, "documents": len(self.ids)}).encode()
        body = np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        index = self.compressor.compress(struct.pack("<I", len(head)) + head + body)
        self.out.append(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        self.out.append(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IB", len(self.table), 0x80) + struct.pack("<I", SEEKABLE))
        return b"".join(self.out)


class ShardReader:
    """One file; what is read of it are its last bytes, the tables at its end, and those frames that are asked for.

    content is the whole file, or a function that reads so many bytes from a place of a file of size bytes."""

    def __init__(self, content: bytes | Callable[[int, int], bytes], size: int | None = None):
        import zstandard

        if not callable(content):
            view, size = memoryview(content), len(content)
            content = lambda at, n: view[at : at + n]
        self.bytes_at = content
        n, descriptor, magic = struct.unpack("<IBI", self.bytes_at(size - 9, 9))
        if magic != SEEKABLE or descriptor & 0x80 == 0:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = list(struct.iter_unpack("<III", self.bytes_at(size - 9 - 12 * n, 12 * n)))
        self.starts = np.concatenate(([0], np.cumsum([t[0] for t in self.table]))).astype(int)
        self.decompressor = zstandard.ZstdDecompressor()
        kind, length = struct.unpack("<II", self.bytes_at(int(self.starts[-1]), 8))
        if kind != SKIPPABLE:
            raise ValueError("no document index after the frames")
        index = self.decompressor.decompress(self.bytes_at(int(self.starts[-1]) + 8, length))
        (k,) = struct.unpack("<I", index[:4])
        self.head = json.loads(index[4 : 4 + k])
        m, body = self.head["documents"], index[4 + k :]
        self.dtype = np.dtype(self.head["dtype"])
        self.nulls = np.frombuffer(body, "u1", m, 8 * m).astype(bool)
        self.doc_ids = np.frombuffer(body, "<i8", m)
        self.counts = np.frombuffer(body, "<u8", m, 9 * m).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def frame(self, i: int) -> np.ndarray:
        from xxhash import xxh64_intdigest

        packed, size, checksum = self.table[i]
        raw = self.decompressor.decompress(self.bytes_at(int(self.starts[i]), packed), max_output_size=size)
        if len(raw) != size or xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return np.frombuffer(raw, self.dtype)

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Place and ids of the documents at places, ascending, or of all; each frame is decompressed once at most."""
        per, held = self.head["frame_ids"], {}
        for d in range(len(self.counts)) if places is None else places:
            lo, hi = self.offsets[d], self.offsets[d + 1]
            needed = range(lo // per, (hi - 1) // per + 1) if hi > lo else range(0)
            held = {i: held[i] if i in held else self.frame(i) for i in needed}
            parts = [held[i][max(lo - i * per, 0) : hi - i * per] for i in needed]
            yield d, parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, self.dtype), *parts])


def write(docs: DataFrame, path: str, tokenizer_file: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every text of docs and writes the files to path."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(max(1, -(-size // shard_bytes)), F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer_file)
        shard = ShardWriter(TaskContext.get().partitionId(), encoder.dtype)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(t.as_py() or b"" for t in batch.column("text")), strict=True):
                shard.add(doc_id, ids)
        if shard.ids:
            yield pa.RecordBatch.from_arrays([pa.array([shard.finish()[: -len(MAGIC)]], pa.binary())], ["value"])

    files = ordered.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, place, doc_id, first (ids of the shard before the document), n_tokens and ids_crc32, for each document in the files at path."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_of.cache_clear()  # the files are written: a worker that lives on needs no encoder any more
        for batch in batches:
            for content in batch.column("content"):
                reader = ShardReader(content.as_py())
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()]
                n = len(reader.counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, reader.head["shard"])), pa.array(np.arange(n)), pa.array(reader.doc_ids, mask=reader.nulls), pa.array(reader.offsets[:-1]), pa.array(reader.counts), pa.array(np.array(sums, np.int64))],
                    ["shard", "place", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(decode, "shard long, place long, doc_id long, first long, n_tokens long, ids_crc32 long")


def _ranges(uri: str) -> Callable[[int, int], bytes] | None:
    """A function that reads bytes of the file at uri; none if only Spark's own readers know such files."""
    import pyarrow.fs

    try:
        system, path = pyarrow.fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:  # a scheme that is not known here
        return None
    file = system.open_input_file(path)
    return lambda at, n: file.read_at(n, at)


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """doc_id and ids of the documents in wanted, a list of the caller. Of each file are read the tables at its end, and of the frames only those
    that hold one of them; files on a file system that only Spark's readers know are read whole, and other frames stay compressed."""

    def found(reader: ShardReader) -> pa.RecordBatch:
        places = np.flatnonzero(np.isin(reader.doc_ids, wanted) & ~reader.nulls).tolist()
        ids = [x.tolist() for _, x in reader.documents(places)]
        return pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[places]), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                yield found(ShardReader(_ranges(uri), size))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield found(ShardReader(content.as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    first = files.select("path").first()
    if first is not None and _ranges(first["path"]) is not None:
        return files.select("path", "length").mapInArrow(in_ranges, "doc_id long, ids array<bigint>")
    return files.select("content").mapInArrow(whole, "doc_id long, ids array<bigint>")


def numbered(documents: DataFrame) -> DataFrame:
    """start, the ids of all documents before each one, in place of its place within a shard. The sum over shards is over a row for each file."""
    documents = stored(documents, "token-index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = documents.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return documents.join(shards, "shard").select("doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 for each row of docs, from files written to the shared folder."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_file)
    return numbered(read(docs.sparkSession, path))
