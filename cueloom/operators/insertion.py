"""Which audio goes into which slide of a deck, and why some does not. The insertion itself is an outside program's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["deck_id", "slide_num"]


def plan(audio: DataFrame, files: DataFrame, slides: DataFrame) -> DataFrame:
    """audio (deck_id, slide_num, audio_file) with reason: null if it can be inserted, else the first thing that is missing.

    files has deck_id and audio_file of the files that are there. A problem of one slide does not stop the others."""
    there = files.select("deck_id", "audio_file").distinct().withColumn("has_file", F.lit(True))
    shown = slides.select(*KEY).distinct().withColumn("has_slide", F.lit(True))
    joined = audio.join(there, ["deck_id", "audio_file"], "left").join(shown, KEY, "left")
    reason = F.when(F.col("has_file").isNull(), "audio file not found").when(F.col("has_slide").isNull(), "slide not found")
    return joined.select(*KEY, "audio_file", reason.alias("reason"))


def results(planned: DataFrame) -> DataFrame:
    """inserted_slides and skipped_slides of each deck, ascending."""
    skipped = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("slide_num", "reason")))
    return planned.groupBy("deck_id").agg(F.sort_array(F.collect_list(F.when(F.col("reason").isNull(), F.col("slide_num")))).alias("inserted_slides"), F.sort_array(skipped).alias("skipped_slides"))
