"""Decks, events and measurements from the tables of the test data, so that every operator can run on them.

A conversation is a deck and a turn a slide; system turns are silent. Each voiced character of the notes is spoken for
160 ms, every 200 ms. In every fifth deck the characters 40 to 79 are not spoken and what follows comes 8 s sooner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators.align import LISTS, Told

KEY = ["deck_id", "slide_num"]
CHAR_MS, VOICED_MS = 200, 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.when(F.col("role") != "system", F.col("text"))
    override = F.when(F.col("conv_id") % 7 == 0, F.lit("")).when((F.col("conv_id") % 7 == 1) & (F.col("turn") == 0), F.concat(F.lit("Shown: "), "role"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("deck_id"), (F.col("turn") + 1).cast("int").alias("slide_num"), F.col("role").alias("title"), notes.alias("notes"),
        override.alias("subtitle_text"), (F.length(notes) * CHAR_MS).cast("bigint").alias("audio_ms"),
    )


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced characters of the notes that are heard, numbered, with their place and time.

    They are numbered while a slide is one row, which is also dealt out as one: what follows by slide sends no characters.
    The number of parts is told, as they grow a lot and shouldn't be put together by what they have as texts."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = lambda t: F.transform(F.split(t, ""), lambda c, i: F.struct(i.alias("pos"), c.alias("text")))
    spoken = slides(spark, sf_dir).where("notes is not null").repartition(n, *KEY).groupBy(*KEY).agg(F.collect_list("notes").alias("notes"))
    # A slide that is there more than once has its characters by place.
    whole = F.when(F.size("notes") == 1, each(F.col("notes")[0])).otherwise(F.array_sort(F.flatten(F.transform("notes", each))))
    fifth = F.col("deck_id") % 5 == 0
    voiced = F.filter(whole, lambda c: ~c["text"].isin("", " ", "\n", ".", ",", "!", "?") & ~(fifth & c["pos"].between(40, 79)))
    at = F.col("c.pos") * CHAR_MS - F.when(fifth & (F.col("c.pos") >= 80), 40 * CHAR_MS).otherwise(0)
    return spoken.select(*KEY, F.posexplode(voiced).alias("ev_idx", "c")).select(*KEY, "ev_idx", F.col("c.pos").alias("pos"), F.col("c.text").alias("text"), at.cast("bigint").alias("offset_ms"), F.lit(VOICED_MS).cast("bigint").alias("duration_ms"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heard(spark, sf_dir).select(*KEY, "text", "offset_ms", "duration_ms", "ev_idx")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the places that they were made from."""
    return heard(spark, sf_dir).select(*KEY, "ev_idx", F.col("pos").alias("source_start_offset"), (F.col("pos") + 1).alias("source_end_offset"), "offset_ms", "duration_ms")


#: Bytes that begin a voiced character: not those that go on with one, and none of these.
_VOICED = ((np.arange(256) & 0xC0) != 0x80) & ~np.isin(np.arange(256), list(b" \n.,!?"))


def _places(slides: pa.ListArray) -> pa.StructArray:
    """Lists of the voiced characters of slides (deck_id, notes)."""
    decks, notes = slides.flatten().flatten()
    notes, n = notes.cast(pa.large_binary()), len(notes)
    edges = np.frombuffer(notes.buffers()[1], np.int64)[notes.offset : notes.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(notes.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before each byte
    at = np.flatnonzero(_VOICED[data])
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(at, edges)))
    pos = count[at] - count[edges[:-1]][row]
    fifth = (decks.to_numpy() % 5 == 0)[row]
    said = ~(fifth & (pos >= 40) & (pos < 80))
    pos, fifth, row = pos[said], fifth[said], row[said]
    # A slide that is there more than once has the characters of each.
    some = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
    cuts = pa.array(some[np.concatenate(([0], np.cumsum(pc.list_value_length(slides).to_numpy())))], pa.int32())
    lists = (pa.array(pos, pa.int32()), pa.array(pos + 1, pa.int32()), pa.array(pos * CHAR_MS - np.where(fifth & (pos >= 80), 40 * CHAR_MS, 0)), pa.array(np.full(len(pos), VOICED_MS)))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, x) for x in lists], LISTS)


def told(spark: SparkSession, sf_dir: str) -> Told:
    """What `matched` has, told from notes that are dealt out by slide: no character is a row, or leaves Python."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spoken = slides(spark, sf_dir).where("notes is not null").repartition(n, *KEY)
    return Told(spoken.select(*KEY, F.struct("deck_id", "notes").alias("told")), _places)


def bounds(starts: DataFrame) -> DataFrame:
    """Measured bounds: predictions 0.1 % slower, 300 ms of a gap before each slide; every fourth slide is not measured, and of every third one the end."""
    begin = F.floor(F.col("predicted_ms") * 1001 / 1000).cast("bigint") + 300 * F.col("slide_num")
    end = F.floor((F.col("predicted_ms") + F.col("duration_ms")) * 1001 / 1000).cast("bigint") + 300 * F.col("slide_num")
    return starts.where("slide_num % 4 <> 0").select(*KEY, begin.alias("start_ms"), F.when(F.col("slide_num") % 3 != 0, end).alias("end_ms"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries of narrated slides; the second slide has two, and every eleventh deck's entries lack audio."""
    s = slides(spark, sf_dir).where("notes is not null").select(*KEY, "title", F.explode(F.expr("if(slide_num = 2, array(0, 1), array(0))")).alias("entry_idx"))
    name = F.format_string("slide_%03d_%d.mp3", F.col("slide_num"), F.col("entry_idx"))
    return s.withColumn("audio_file", F.when(F.col("deck_id") % 11 != 0, name))


def line_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large timeline: an order is a deck, its line numbers are slides, quantities their milliseconds."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("slide_num")).agg(F.sum("l_quantity").cast("bigint").alias("audio_ms"))
