"""Least squares through the origin between measured and observed times, and how well it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.errors import InvalidInput

MOST_RMS, MOST_RESIDUAL = 1.0, 2.0


def fit_scale(points: DataFrame, key: list[str]) -> DataFrame:
    """k, the factor from measured to observed, and n; k is null where all measured times are 0."""
    return points.groupBy(*key).agg((F.sum(F.col("measured") * F.col("observed")) / F.nullif(F.sum(F.col("measured") * F.col("measured")), F.lit(0.0))).alias("k"), F.count("*").alias("n"))


def require_scale(fitted: DataFrame) -> DataFrame:
    """fitted, once it is sure that each key has two rows and a scale."""
    if not fitted.where("k is null or n < 2").isEmpty():
        raise InvalidInput("a scale needs two usable rows, not all measured at 0")
    return fitted


def residuals(points: DataFrame, key: list[str]) -> DataFrame:
    """points with k, corrected and residual."""
    corrected = F.col("measured") * F.col("k")
    return points.join(fit_scale(points, key).where("n >= 2").drop("n"), key).withColumn("corrected", corrected).withColumn("residual", corrected - F.col("observed"))


def report(points: DataFrame, key: list[str]) -> DataFrame:
    """k, n, rms and max_residual of each key, and whether they are beyond what is trusted."""
    r = residuals(points, key).groupBy(*key).agg(F.first("k").alias("k"), F.count("*").alias("n"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"), F.max(F.abs("residual")).alias("max_residual"))
    return r.withColumn("doubtful", (F.col("rms") > MOST_RMS) | (F.col("max_residual") > MOST_RESIDUAL))


def suggest(words: DataFrame, key: list[str]) -> DataFrame:
    """k, n, rms and max_residual of each key from words whose place was both predicted (predicted_s) and measured (measured_s)."""
    return report(words.select(*key, F.col("predicted_s").alias("measured"), F.col("measured_s").alias("observed")), key)


def missing(observations: DataFrame, bounds: DataFrame, key: list[str]) -> DataFrame:
    """Observations of slides that were not measured."""
    return observations.join(bounds, key, "left_anti")


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and largest value of each column."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
