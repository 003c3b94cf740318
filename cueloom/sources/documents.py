"""JSON documents of decks as tables: manifests, slide lists, event sidecars, observations. Types are declared, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.errors import InvalidInput
from cueloom.schemas import EVENT, MANIFEST, SLIDE_DOCUMENT

KEY = ["deck_id", "slide_num"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and value, the whole text of each file; a path without files is an error of Spark's."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def whole_texts(spark: SparkSession, path: str | None = None, text: str | None = None, default: str = "") -> DataFrame:
    """path and value: the files at path as whole texts, else the text that is given, else a default one (with a null path)."""
    if path is not None:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return spark.createDataFrame([(None, default if text is None else text)], "path string, value string")


def manifest_entries(documents: DataFrame) -> DataFrame:
    """deck_id, entry_idx and the fields of each entry; documents has deck_id and value."""
    m = documents.select("deck_id", F.from_json("value", MANIFEST).alias("m"))
    return m.select("deck_id", F.posexplode("m.slides").alias("entry_idx", "e")).select("deck_id", "entry_idx", "e.*")


def slides(documents: DataFrame) -> DataFrame:
    """deck_id and the fields of each slide, from a bare list or an object with slides."""
    as_object = F.from_json("value", f"slides array<{SLIDE_DOCUMENT}>")["slides"]
    as_list = F.from_json("value", f"array<{SLIDE_DOCUMENT}>")
    found = F.when(F.startswith(F.trim("value"), F.lit("[")), as_list).otherwise(as_object)
    return documents.select("deck_id", F.explode(found).alias("s")).select("deck_id", "s.*")


def events(sidecars: DataFrame) -> DataFrame:
    """Events of the sidecars that can be read: deck_id, slide_num, ev_idx, text, offset_ms, duration_ms."""
    ms = lambda c: F.rint(F.coalesce(F.col(c), F.lit(0.0)) * 1000).cast("bigint")
    parsed = sidecars.select(*KEY, F.posexplode(F.from_json("value", f"array<{EVENT}>")).alias("ev_idx", "e"))
    return parsed.select(*KEY, "ev_idx", "e.text", ms("e.offset_seconds").alias("offset_ms"), ms("e.duration_seconds").alias("duration_ms"))


def event_warnings(sidecars: DataFrame) -> DataFrame:
    """A warning for each sidecar that is missing or is no list of events."""
    bad = F.from_json("value", f"array<{EVENT}>").isNull()
    return sidecars.where(bad).select(*KEY, F.lit("unreadable_events").alias("code"), F.lit("the slide's events can't be read; it has no captions").alias("message"))


def observations(documents: DataFrame) -> DataFrame:
    """slide_num and observed seconds from a map of slide to seconds."""
    each = documents.select("deck_id", F.explode(F.from_json("value", "map<string,double>")).alias("k", "observed"))
    return each.select("deck_id", F.col("k").try_cast("int").alias("slide_num"), "observed").where("slide_num is not null")


def require_observations(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise InvalidInput("there are no observations")
    return rows


def ticks_to_ms(ticks):
    """Ticks of 100 ns as milliseconds."""
    return F.rint(ticks / 10_000).cast("bigint")
