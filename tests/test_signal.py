"""The search for lags against its rule, on tracks with gaps, and how much it sends."""

import random

from pyspark.sql import functions as F

from cueloom.operators import signal

TRACK, CLIPS = "pos long, v double", "clip_id long, predicted long, i int, v double"


def plain_lags(track, clips, shift):
    out = {}
    for clip, (predicted, samples) in clips.items():
        mean, best = sum(v for _, v in samples) / len(samples), None
        for lag in range(max(predicted - shift, 0), predicted + shift + 1):
            if all(lag + i in track for i, _ in samples):
                score = round(sum(track[lag + i] * (v - mean) for i, v in samples), 6)
                best = max(best or (score, -lag), (score, -lag))
        if best:
            out[clip] = -best[1]
    return out


def test_best_lags_on_tracks_with_gaps(spark):
    r = random.Random(3)
    track = {p: float(r.randint(-3, 3)) for p in range(1500) if p % 400 > 5}
    clips = {c: (r.randint(-40, 1500), [(i, float(r.randint(-2, 2))) for i in range(r.choice([1, 7, 300])) if i % 9 != 4]) for c in range(40)}
    t = spark.createDataFrame(list(track.items()), TRACK)
    c = spark.createDataFrame([(k, p, i, v) for k, (p, s) in clips.items() for i, v in s], CLIPS)
    assert {x.clip_id: x.lag for x in signal.best_lags(t, c, 30).collect()} == plain_lags(track, clips, 30)


def test_a_clip_meets_blocks_and_no_lags(spark):
    """No row for each lag of each sample is made: the plan has no more rows than clips times blocks."""
    v = spark.range(64 * 50).select(F.col("id").alias("pos"), F.sin(F.col("id") * 0.7).alias("v"))
    clips = v.select(F.floor(F.col("pos") / 64).alias("clip_id"), (F.col("pos") % 64).alias("i"), "v", (F.floor(F.col("pos") / 64) * 64).alias("predicted"))
    plan = signal.best_lags(v, clips, 96)._jdf.queryExecution().optimizedPlan().toString()
    assert "(pos#" not in plan.split("Join")[1].split("\n")[0]
