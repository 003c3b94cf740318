"""Gaps and disorder in sequences of events. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["deck_id", "slide_num"]
LEAST_CHARS, PACE_RATIO = 15, 0.3


def dropped_narration(slides: DataFrame, matched: DataFrame, least_chars: int = LEAST_CHARS, ratio: float = PACE_RATIO) -> DataFrame:
    """Stretches of notes that the slide's pace says were not spoken: source offsets, skipped_text, gap_ms, expected_ms and audio_position_ms."""
    order = Window.partitionBy(*KEY).orderBy("ev_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = F.col("offset_ms") + F.col("duration_ms")
    m = matched.withColumn("chars", F.last("source_end_offset").over(whole) - F.first("source_start_offset").over(whole)).withColumn("ms", F.last(stop).over(whole) - F.first("offset_ms").over(whole))
    pairs = m.select(*KEY, "chars", "ms", F.col("source_end_offset").alias("a"), F.lead("source_start_offset").over(order).alias("b"), stop.alias("audio_position_ms"), F.lead("offset_ms").over(order).alias("next_ms"))
    gap = F.col("next_ms") - F.col("audio_position_ms")
    expected = (F.col("b") - F.col("a")) * F.col("ms") / F.col("chars")
    found = pairs.where((F.col("chars") > 0) & (F.col("ms") > 0) & (F.col("b") - F.col("a") >= least_chars)).where(gap < expected * ratio)
    flagged = found.select(*KEY, F.col("a").alias("source_start_offset"), F.col("b").alias("source_end_offset"), F.greatest(gap, F.lit(0)).alias("gap_ms"), expected.alias("expected_ms"), "audio_position_ms")
    text = slides.select(*KEY, "notes")
    return flagged.join(text, KEY).withColumn("skipped_text", F.substr("notes", F.col("source_start_offset") + 1, F.col("source_end_offset") - F.col("source_start_offset"))).drop("notes")


def recheck(slides: DataFrame, entries: DataFrame, matched: DataFrame) -> DataFrame:
    """For each deck: slides looked at, skipped for want of an entry, of notes or of events, and suspects found."""
    seen = matched.select(*KEY).distinct().withColumn("has_events", F.lit(True))
    suspects = dropped_narration(slides, matched).groupBy(*KEY).agg(F.count("*").alias("n"))
    all_slides = slides.join(entries.select(*KEY).distinct().withColumn("has_entry", F.lit(True)), KEY, "left").join(seen, KEY, "left").join(suspects, KEY, "left")
    entry, notes, events = F.col("has_entry").isNotNull(), F.col("notes").isNotNull(), F.col("has_events").isNotNull()
    return all_slides.groupBy("deck_id").agg(
        F.count_if(entry & notes & events).alias("checked"), F.count_if(~entry).alias("no_entry"), F.count_if(entry & ~notes).alias("no_notes"),
        F.count_if(entry & notes & ~events).alias("no_events"), F.coalesce(F.sum("n"), F.lit(0)).alias("suspects"),
    )


def self_consistency(events: DataFrame, durations: DataFrame, key: list[str], tolerance_ms: int = 10, most_gap_ms: int = 300) -> DataFrame:
    """For each slide: gap_ms between the audio's end and the last event's, events out of order, and whether it is flagged.

    An event is out of order if it begins more than tolerance_ms before the latest end of those before it."""
    stop = F.col("offset_ms") + F.col("duration_ms")
    before = Window.partitionBy(*key).orderBy("ev_idx").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("offset_ms") < F.coalesce(F.max(stop).over(before), F.lit(0)) - tolerance_ms
    per = events.withColumn("late", late).groupBy(*key).agg(F.count_if("late").alias("out_of_order"), F.max_by(stop, "ev_idx").alias("last_ms"))
    gap = F.col("audio_ms") - F.col("last_ms")
    return per.join(durations, key).select(*key, gap.alias("gap_ms"), "out_of_order", ((F.abs(gap) > most_gap_ms) | (F.col("out_of_order") > 0)).alias("flagged"))


def worst_slide(report: DataFrame) -> DataFrame:
    """The slide of each deck with the largest gap; of equals the later one."""
    return report.groupBy("deck_id").agg(F.max_by("slide_num", F.struct(F.abs("gap_ms"), F.col("slide_num"))).alias("worst_slide"), F.max(F.abs("gap_ms")).alias("worst_gap_ms"))


def drift(slides: DataFrame, bounds: DataFrame, default_ms: int = 5000, most_ms: int = 500) -> DataFrame:
    """Predicted and measured start of each measured slide, and their difference. Slides with audio that were not measured don't move the prediction here."""
    before = Window.partitionBy("deck_id").orderBy("slide_num").rowsBetween(Window.unboundedPreceding, -1)
    joined = slides.join(bounds.select(*KEY, "start_ms"), KEY, "left")
    step = F.when(F.col("audio_ms").isNull(), default_ms).when(F.col("start_ms").isNotNull(), F.col("audio_ms")).otherwise(0)
    predicted = joined.withColumn("predicted_ms", F.coalesce(F.sum(step).over(before), F.lit(0)))
    delta = F.col("start_ms") - F.col("predicted_ms")
    return predicted.where("start_ms is not null and audio_ms is not null").select(*KEY, "predicted_ms", "start_ms", delta.alias("delta_ms"), (F.abs(delta) > most_ms).alias("flagged"))
