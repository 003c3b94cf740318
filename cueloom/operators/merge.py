"""Keyed lookups, upserts and selections over slides and manifest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.errors import InvalidInput
from cueloom.functions.text import strip

KEY = ["deck_id", "slide_num"]


def one_per_slide(entries: DataFrame, order: str, last: bool) -> DataFrame:
    """The first or last entry of each slide; lookups by dictionary take the last one, scans with a break the first."""
    by = F.col(order).desc() if last else F.col(order).asc()
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(by))).where("_n = 1").drop("_n")


def enrich(slides: DataFrame, entries: DataFrame, order: str = "entry_idx") -> DataFrame:
    """slides with has_notes and audio_file, that of their first entry."""
    first = one_per_slide(entries, order, last=False).select(*KEY, "audio_file")
    return slides.join(first, KEY, "left").withColumn("has_notes", narratable())


def audio_map(entries: DataFrame, order: str = "entry_idx") -> DataFrame:
    """The last entry with audio of each slide."""
    return one_per_slide(entries.where("coalesce(audio_file, '') <> ''"), order, last=True).select(*KEY, "audio_file")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """new entries, and the old ones of other slides."""
    return old.join(new, KEY, "left_anti").unionByName(new)


def resolve_manifest(this_run: DataFrame, stored: DataFrame) -> DataFrame:
    """Each deck's entries of this run, if it has any, else the stored ones; decks without either have none."""
    return this_run.unionByName(stored.join(this_run.select("deck_id").distinct(), "deck_id", "left_anti"))


def selected(slides: DataFrame, wanted: DataFrame) -> DataFrame:
    return slides.join(wanted, KEY, "left_semi")


def require_selected(slides: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted slides, once it is sure that all are there."""
    if not absent(slides, wanted).isEmpty():
        raise InvalidInput("a slide that is asked for isn't in the deck")
    return selected(slides, wanted)


def absent(slides: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(slides, KEY, "left_anti")


def apply_subtitle_text(slides: DataFrame, changes: DataFrame) -> DataFrame:
    """slides with the subtitle_text that changes (deck_id, slide_num, new_text) give."""
    found = F.col("c.slide_num").isNotNull()
    joined = slides.alias("s").join(changes.alias("c"), (F.col("s.deck_id") == F.col("c.deck_id")) & (F.col("s.slide_num") == F.col("c.slide_num")), "left")
    return joined.select(*[F.when(found, F.col("c.new_text")).otherwise(F.col("s.subtitle_text")).alias(c) if c == "subtitle_text" else F.col(f"s.{c}") for c in slides.columns])


def narratable():
    """Notes that are there and not blank, by Unicode's white space."""
    return F.coalesce(strip(F.col("notes")) != "", F.lit(False))


def require_notes(slides: DataFrame) -> DataFrame:
    """Strict mode: notes may be blank, but not missing."""
    if not slides.where("notes is null").isEmpty():
        raise InvalidInput("a slide has no notes")
    return slides


def spoken_text():
    """What captions show: the override unless it is empty, else the notes."""
    return F.coalesce(F.nullif(F.col("subtitle_text"), F.lit("")), F.col("notes"))
