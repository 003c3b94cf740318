"""Where slides and captions stand in time: predicted by running sums, or measured and rescaled. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["deck_id", "slide_num"]
DEFAULT_MS = 5000


def predicted_starts(slides: DataFrame, default_ms: int = DEFAULT_MS) -> DataFrame:
    """slides (with audio_ms, null for silent ones) with duration_ms and predicted_ms, the sum of the durations before."""
    before = Window.partitionBy("deck_id").orderBy("slide_num").rowsBetween(Window.unboundedPreceding, -1)
    timed = slides.withColumn("duration_ms", F.coalesce("audio_ms", F.lit(default_ms)))
    return timed.withColumn("predicted_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)))


def place(captions: DataFrame, starts: DataFrame) -> DataFrame:
    """Captions of slides moved to their slide's predicted start."""
    return moved(captions.join(starts.select(*KEY, "predicted_ms"), KEY))


def moved(captions: DataFrame) -> DataFrame:
    """Captions (with predicted_ms) moved to their slide's predicted start."""
    return captions.withColumn("start_ms", F.col("start_ms") + F.col("predicted_ms")).withColumn("end_ms", F.col("end_ms") + F.col("predicted_ms")).drop("predicted_ms")


def direct_scales(starts: DataFrame, bounds: DataFrame) -> DataFrame:
    """direct: measured length by audio length, where both ends are measured."""
    scale = F.when(F.col("duration_ms") > 0, (F.col("end_ms") - F.col("start_ms")) / F.col("duration_ms"))
    return starts.join(bounds, KEY, "left").withColumn("direct", scale)


def inferred_scales(starts: DataFrame, bounds: DataFrame) -> DataFrame:
    """inferred: between consecutive measured slides, how much longer the measured distance of their starts is than the predicted one."""
    order = Window.partitionBy("deck_id").orderBy("slide_num")
    measured = starts.join(bounds.select(*KEY, "start_ms"), KEY).where("start_ms is not null")
    ahead = lambda c: F.lead(c).over(order) - F.col(c)
    steps = measured.withColumn("predicted_step", ahead("predicted_ms")).withColumn("measured_step", ahead("start_ms"))
    return steps.select(*KEY, F.when(F.col("predicted_step") > 0, F.col("measured_step") / F.col("predicted_step")).alias("inferred"))


def scales(starts: DataFrame, bounds: DataFrame) -> DataFrame:
    """start_ms and scale of each slide: direct, else inferred, else the plain mean of its deck's scales, else 1; unmeasured slides stay at their predicted start with scale 1."""
    both = direct_scales(starts, bounds).join(inferred_scales(starts, bounds), KEY, "left").withColumn("own", F.coalesce("direct", "inferred"))
    fallback = F.coalesce(F.avg("own").over(Window.partitionBy("deck_id")), F.lit(1.0))
    measured = F.col("start_ms").isNotNull()
    return both.select(
        *KEY, F.coalesce("start_ms", "predicted_ms").alias("start_ms"), F.when(measured, F.coalesce("own", fallback)).otherwise(1.0).alias("scale"),
        F.when(~measured, "unmeasured").when(F.col("own").isNull() & (fallback != 1.0), "average_scale").alias("code"),
    )


def place_measured(captions: DataFrame, placed: DataFrame) -> DataFrame:
    """Captions stretched by their slide's scale and moved to its start."""
    at = lambda c: (F.col("s.start_ms") + F.rint(F.col(f"c.{c}") * F.col("s.scale"))).cast("long").alias(c)
    joined = captions.alias("c").join(placed.alias("s"), KEY)
    return joined.select(*KEY, "c.seg_idx", "c.text", at("start_ms"), at("end_ms"))


def scale_warnings(captions: DataFrame, placed: DataFrame) -> DataFrame:
    """Warnings of slides that have captions."""
    text = F.when(F.col("code") == "unmeasured", "no measured start; the predicted one is used").otherwise("no scale of its own; the deck's mean is used")
    return placed.where("code is not null").join(captions.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "code", text.alias("message"))
