"""Where a clip of sound stands in a track: by cross-correlation, of the samples of a few blocks or with numpy's FFT."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cueloom.errors import InvalidInput

KEY = ["deck_id", "slide_num"]
SAMPLE_RATE, ANCHOR_S, SEARCH_S = 8000, 8.0, 20.0


def standardized(samples: DataFrame, key: list[str], value: str = "v") -> DataFrame:
    """value with the mean of its key taken off and divided by the deviation, where that is over 1e-6."""
    w = Window.partitionBy(*key)
    sd = F.stddev_pop(value).over(w)
    return samples.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 1e-6, sd).otherwise(1.0))


#: Samples of a track that go to a clip together.
BLOCK = 256


def best_lags(track: DataFrame, clips: DataFrame, most_shift: int) -> DataFrame:
    """clip_id and the position at which each clip fits best, within most_shift samples of its predicted one; of equals the first.

    track: pos, v. clips: clip_id, predicted, i, v. Standardizing the clip alone decides: with its mean at zero, the track's scale and level don't move the maximum.
    A clip meets the blocks of the track that it can stand in, as arrays: what is sent grows with samples, not with samples times lags."""
    block = lambda at: F.floor(at / BLOCK)
    blocks = track.groupBy(block(F.col("pos")).alias("block")).agg(F.collect_list(F.struct(F.col("pos").cast("bigint"), F.col("v").cast("double"))).alias("heard"))
    first, last = F.greatest(F.col("predicted") - most_shift, F.lit(0)), F.col("predicted") + most_shift
    own = clips.groupBy("clip_id").agg(F.min("predicted").cast("bigint").alias("predicted"), F.collect_list(F.struct(F.col("i").cast("bigint"), F.col("v").cast("double"))).alias("own"), F.min("i").alias("low"), F.max("i").alias("high"))
    asked = own.where(last >= first).select("clip_id", "predicted", "own", F.explode(F.sequence(block(first + F.col("low")), block(last + F.col("high")))).alias("block"))
    met = asked.join(blocks, "block").groupBy("clip_id").agg(F.any_value("predicted").alias("predicted"), F.any_value("own").alias("own"), F.flatten(F.collect_list("heard")).alias("heard"))
    schema = StructType([clips.schema["clip_id"], *StructType.fromDDL("lag bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lags = [_best_lag(*c, most_shift) for c in zip(batch.column(1).to_pylist(), _pairs(batch.column(2)), _pairs(batch.column(3)), strict=True)]
            found = pa.array(lags, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], schema.names).filter(found.is_valid())

    return met.mapInArrow(run, schema)


def _pairs(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and value of each pair, a row at a time; a value that is null adds nothing."""
    at, values = column.flatten().flatten()
    at, values = at.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    yield from ((at[a:b], values[a:b]) for a, b in pairwise(ends))


def _solid(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _best_lag(predicted: int, clip: tuple[np.ndarray, np.ndarray], heard: tuple[np.ndarray, np.ndarray], most_shift: int) -> int | None:
    (i, v), (pos, s) = clip, heard
    first, n_lags = max(predicted - most_shift, 0), predicted + most_shift + 1 - max(predicted - most_shift, 0)
    low, span = i.min(), int(i.max() - i.min()) + 1
    own = np.bincount(i - low, _solid(v - np.mean(v[~np.isnan(v)])) if not np.isnan(v).all() else np.zeros(len(v)), span)
    within = (pos >= first + low) & (pos < first + low + span + n_lags - 1)
    at, s = pos[within] - first - low, s[within]
    size = span + n_lags - 1
    # Only places where the whole clip has a track count.
    whole = np.flatnonzero(np.rint(np.correlate(np.bincount(at, minlength=size).astype(float), np.bincount(i - low, minlength=span).astype(float))) == len(i))
    if not len(whole):
        return None
    # Sums in another order differ in their last digits.
    score = np.round(np.correlate(np.bincount(at, _solid(s), size), own), 6)
    return first + int(whole[score[whole].argmax()])


def _standard(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64) - np.mean(x)
    return x / sd if (sd := x.std()) > 1e-6 else x


def find_offset(track: np.ndarray, clip: np.ndarray, predicted_s: float, rate: int = SAMPLE_RATE, search_s: float = SEARCH_S, base: int = 0) -> float:
    """Seconds at which clip fits track best, near predicted_s; that itself if the track is too short there. base: how many samples stand before what track has."""
    centre, reach = int(predicted_s * rate), int(search_s * rate)
    first = max(0, centre - reach)
    heard = np.asarray(track[max(0, first - base) : max(0, centre + reach + len(clip) - base)], np.float64)
    if not 0 < len(clip) <= len(heard):
        return predicted_s
    # One transform each way; the clip alone needs its level taken off (see best_lags).
    own, size = _standard(clip), 1 << (len(heard) + len(clip) - 1).bit_length()
    fit = np.fft.irfft(np.fft.rfft(_standard(heard), size) * np.fft.rfft(own, size).conj(), size)
    return (first + int(fit[: len(heard) - len(own) + 1].argmax())) / rate


def measured_bounds(track: np.ndarray, clip: np.ndarray, predicted_s: float, rate: int = SAMPLE_RATE, anchor_s: float = ANCHOR_S, search_s: float = SEARCH_S, base: int = 0) -> tuple[float, float]:
    """Start by the clip's first anchor_s seconds, end by its last, if it is twice as long; else by its length."""
    n, length = int(anchor_s * rate), len(clip) / rate
    start = find_offset(track, clip[:n], predicted_s, rate, search_s, base)
    if n and len(clip) > n and len(clip) >= 2 * n:
        return start, find_offset(track, clip[-n:], start + length - anchor_s, rate, search_s, base) + anchor_s
    return start, start + length


def _cut_from_track(rows: DataFrame, tracks: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows with base and heard: the samples of their deck's track between two places. What goes to Python is as long as a search, not as a track."""
    whole = tracks.select(F.col("deck_id").alias("of"), F.col("samples").alias("track"))
    placed = rows.withColumn("base", F.greatest(first.cast("int"), F.lit(0))).withColumn("last", last.cast("int"))
    return placed.join(whole, F.col("deck_id") == F.col("of")).withColumn("heard", F.slice("track", F.col("base") + 1, F.greatest(F.col("last") - F.col("base"), F.lit(0)))).drop("of", "track", "last")


def locate(clips: DataFrame, tracks: DataFrame, rate: int = SAMPLE_RATE, anchor_s: float = ANCHOR_S, search_s: float = SEARCH_S, scale: float = 1.0, ends: bool = True) -> DataFrame:
    """deck_id, slide_num, start_s and end_s of each slide whose clip can be decoded.

    clips: deck_id, slide_num, predicted_s, samples. tracks: deck_id, samples. Predictions don't depend on what is measured,
    so each slide is a row of its own, with the part of the track that it can stand in."""
    # The start is within one search of the prediction, the end within another one of it.
    at, reach = F.col("predicted_s") * rate, 2 * search_s * rate + 1
    sound = clips.where("size(samples) > 0").select(*KEY, "predicted_s", "samples")
    cut = _cut_from_track(sound, tracks, at - reach, at + F.size("samples") + reach)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c in batch.itertuples(index=False):
                clip, heard = np.asarray(c.samples, np.float32), np.asarray(c.heard, np.float32)
                a, b = measured_bounds(heard, clip, c.predicted_s, rate, anchor_s, search_s, c.base) if ends else (find_offset(heard, clip[: int(anchor_s * rate)], c.predicted_s, rate, search_s, c.base), np.nan)
                rows.append((c.deck_id, c.slide_num, a * scale, b * scale))
            yield pd.DataFrame(rows, columns=["deck_id", "slide_num", "start_s", "end_s"])

    return cut.mapInPandas(run, "deck_id bigint, slide_num int, start_s double, end_s double")


def locate_warnings(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """A warning for each slide with an entry whose sound is missing or can't be decoded; it stays where it was predicted."""
    heard = clips.where("samples is not null and size(samples) > 0").select(*KEY)
    lost = entries.select(*KEY).distinct().join(heard, KEY, "left_anti")
    return lost.select(*KEY, F.lit("not_located").alias("code"), F.lit("no sound that can be decoded; the predicted position is used").alias("message"))


LEAD_IN_S, LEAST_CLIP_S, LEAST_SOUND_S = 0.2, 1.5, 0.5


def check_words(words: DataFrame, clips: DataFrame, tracks: DataFrame, rate: int = SAMPLE_RATE, search_s: float = 2.0) -> DataFrame:
    """Where sampled words really are in the track, against their place by the slide's start and scale.

    words: deck_id, slide_num, ev_idx, text, offset_s, duration_s, start_s, scale. Words at the very start of a slide and
    those with too little sound around them are left out. Each word goes to Python with the part of the track around it."""
    sound = clips.select(*KEY, "samples")
    joined = words.where("offset_s >= 0.05").join(sound, KEY)
    begin = F.greatest(F.lit(0.0), F.col("offset_s") - LEAD_IN_S)
    stop = F.least(F.size("samples") / rate, F.greatest(begin + LEAST_CLIP_S, F.col("offset_s") + F.col("duration_s") + LEAD_IN_S))
    at, end = (begin * rate).cast("int"), (stop * rate).cast("int")
    cut = joined.withColumn("begin_s", begin).withColumn("own_s", F.size("samples") / rate).withColumn("part", F.slice("samples", at + 1, F.greatest(end - at, F.lit(0))))
    cut = cut.where(F.size("part") >= int(LEAST_SOUND_S * rate)).drop("samples")

    place = (F.col("start_s") + F.col("begin_s")) * rate
    reach = search_s * rate + 1
    heard = _cut_from_track(cut, tracks, place - reach, place + reach + F.size("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch.itertuples(index=False):
                begins = find_offset(np.asarray(w.heard, np.float32), np.asarray(w.part, np.float32), w.start_s + w.begin_s, rate, search_s, w.base)
                measured = begins + w.offset_s - w.begin_s
                delta, predicted = measured - (w.start_s + w.offset_s), w.start_s + w.offset_s * w.scale
                rows.append((w.deck_id, w.slide_num, w.ev_idx, w.text, w.offset_s, w.offset_s / w.own_s if w.own_s > 1e-6 else 0.0, delta, 1 + delta / w.offset_s, measured - predicted, predicted, measured))
            yield pd.DataFrame(rows, columns=["deck_id", *WORD_COLUMNS])

    schema = "deck_id bigint, slide_num int, ev_idx int, text string, " + ", ".join(f"{c} double" for c in WORD_COLUMNS[3:])
    return heard.mapInPandas(run, schema)


def word_report(checked: DataFrame) -> DataFrame:
    """What `check_words` found, with the nine columns of its report."""
    return checked.select(*[F.col("deck_id"), *(F.col(a).alias(b) for a, b in WORD_REPORT.items())])


#: Columns of the report and what they are called there; fixed values.
WORD_REPORT = {
    "slide_num": "slide_num", "text": "text", "offset_s": "word_offset_seconds", "fraction": "fraction_within_slide", "naive_delta": "naive_delta_seconds", "implied_scale": "implied_local_scale",
    "corrected_delta": "corrected_delta_seconds", "predicted_s": "corrected_predicted_word_position_seconds", "measured_s": "measured_word_position_seconds",
}
WORD_COLUMNS = ["slide_num", "ev_idx", "text", "offset_s", "fraction", "naive_delta", "implied_scale", "corrected_delta", "predicted_s", "measured_s"]


def sample_evenly(df: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """k rows of each key at even distances, the first and last included; all rows if there are no more than k."""
    if k < 2:
        raise InvalidInput("sampling evenly needs two samples or more")
    n = F.count("*").over(Window.partitionBy(*key))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    numbered = df.withColumn("place", place).withColumn("n", n)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("n") - 1) / (k - 1)).cast("int"))
    return numbered.where((F.col("n") <= k) | F.array_contains(wanted, F.col("place"))).drop("place", "n")
