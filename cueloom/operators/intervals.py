"""Intervals: clipping to windows, choosing cuts, and auditing cues. Times are milliseconds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.errors import InvalidInput


def windows(cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """part_idx, w0 and w1 of each deck's windows: from 0 by its cuts (deck_id, at_ms) to total_ms."""
    edges = cuts.select("deck_id", "at_ms").unionByName(totals.select("deck_id", F.lit(0).cast("long").alias("at_ms"))).unionByName(totals.select("deck_id", F.col("total_ms").alias("at_ms")))
    order = Window.partitionBy("deck_id").orderBy("at_ms")
    numbered = edges.select("deck_id", (F.row_number().over(order) - 1).alias("part_idx"), F.col("at_ms").alias("w0"), F.lead("at_ms").over(order).alias("w1"))
    return numbered.where("w1 is not null")


def clip(cues: DataFrame, parts: DataFrame) -> DataFrame:
    """Cues cut to each window that they reach into, with times from its start; what is left empty is dropped."""
    a, b = F.greatest("start_ms", "w0"), F.least("end_ms", "w1")
    hit = cues.join(parts, "deck_id").where((F.col("start_ms") < F.col("w1")) & (F.col("end_ms") > F.col("w0")) & (b > a))
    return hit.select("deck_id", "part_idx", "cue_idx", (a - F.col("w0")).alias("start_ms"), (b - F.col("w0")).alias("end_ms"), "text")


def equal_cuts(starts: DataFrame, totals: DataFrame, parts: int) -> DataFrame:
    """Slide starts (slide_num, at_ms) nearest to equal shares of each deck, each used once: of equals the earliest; fewer if there are too few."""
    if parts < 1:
        raise InvalidInput("a deck has one part or more")

    def run(key, mine: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        left = sorted((int(t), int(s)) for s, t in zip(mine["slide_num"], mine["at_ms"], strict=True) if t > 0)
        chosen = []
        for i in range(1, parts) if len(total) else ():
            if not left:
                break
            goal = int(total["total_ms"].iloc[0]) * i
            best = min(left, key=lambda c: (abs(c[0] * parts - goal), c))
            left.remove(best)
            chosen.append(best)
        return pd.DataFrame([(*key, s, t) for t, s in sorted(chosen)], columns=["deck_id", "slide_num", "at_ms"])

    return starts.select("deck_id", "slide_num", "at_ms").groupBy("deck_id").cogroup(totals.select("deck_id", "total_ms").groupBy("deck_id")).applyInPandas(run, "deck_id bigint, slide_num int, at_ms bigint")


def cuts_after(starts: DataFrame, after: DataFrame) -> DataFrame:
    """The starts of the slides that follow those in after (deck_id, slide_num)."""
    following = after.select("deck_id", (F.col("slide_num") + 1).alias("slide_num"))
    return following.join(starts, ["deck_id", "slide_num"]).select("deck_id", "slide_num", "at_ms")


def require_cuts(starts: DataFrame, after: DataFrame) -> DataFrame:
    following = after.select("deck_id", (F.col("slide_num") + 1).alias("slide_num"))
    if not following.join(starts, ["deck_id", "slide_num"], "left_anti").isEmpty():
        raise InvalidInput("a slide to cut after has no measured slide behind it")
    return cuts_after(starts, after)


def overlapping(cues: DataFrame, key: list[str]) -> DataFrame:
    """Cues that begin before the one before them ends, and by how much."""
    before = F.lag("end_ms").over(Window.partitionBy(*key).orderBy("cue_idx"))
    return cues.withColumn("overlap_ms", before - F.col("start_ms")).where("overlap_ms > 0").select(*key, "cue_idx", "overlap_ms")
