"""From notes and timed events to captions and subtitle files, for all decks of a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.operators import align, gaps, segment, signal, srt, timeline
from cueloom.operators.merge import spoken_text

KEY = ["deck_id", "slide_num"]
#: Events with a place, as rows or told late.
Matched = DataFrame | align.Told


def slide_captions(slides: DataFrame, matched: Matched, beside: DataFrame | None = None) -> DataFrame:
    """Captions within each slide, one for each sentence unit of its notes, with what beside has of their slides."""
    return align.align(segment.sentence_segments(slides, KEY), matched, beside=beside)


def predictive(slides: DataFrame, matched: Matched) -> DataFrame:
    """Captions on the deck's predicted timeline. Starts come to whole slides, so no caption is sent to them."""
    starts = timeline.predicted_starts(slides.select(*KEY, "audio_ms")).select(*KEY, "predicted_ms")
    return timeline.moved(slide_captions(slides, matched, starts))


def measured(slides: DataFrame, matched: Matched, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captions on the measured timeline, and the warnings that go with them."""
    placed = timeline.scales(timeline.predicted_starts(slides.select(*KEY, "audio_ms")), bounds)
    captions = slide_captions(slides, matched)
    return timeline.place_measured(captions, placed), timeline.scale_warnings(captions, placed)


def captions(slides: DataFrame, matched: Matched, bounds: DataFrame | None = None) -> DataFrame:
    """The measured timeline where bounds are given and have rows, else the predicted one."""
    if bounds is not None and not bounds.isEmpty():
        return measured(slides, matched, bounds)[0]
    return predictive(slides, matched).select(*KEY, "seg_idx", "text", "start_ms", "end_ms")


def subtitle_files(timed: DataFrame) -> DataFrame:
    """deck_id and srt."""
    return srt.format_srt(timed, ["deck_id"], ["slide_num", "seg_idx"])


def balanced_captions(slides: DataFrame, matched: Matched, width: int = segment.DEFAULT_WIDTH) -> DataFrame:
    """As slide_captions, with lines balanced within a width."""
    lines = segment.segments(slides.where("notes is not null"), KEY, "notes", width)
    return align.align(_dealt(lines), matched)


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines as segments, dealt out by slide; events that are so, too, needn't be sent to them."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.withColumnsRenamed({"source_start_offset": "start", "source_end_offset": "end"}).repartition(n, *KEY)


def subtitle_file_for_each(timed: DataFrame, decks: DataFrame) -> DataFrame:
    """deck_id and srt of every deck; one without captions has an empty file."""
    return decks.select("deck_id").distinct().join(subtitle_files(timed), "deck_id", "left").select("deck_id", F.coalesce("srt", F.lit("")).alias("srt"))


def caption_warnings(slides: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """For slides with a manifest entry: no_duration where the audio's length is not known and the default is used, and
    no_events where no timed words can be read, so that the slide has no captions. Slides without an entry are silent."""
    narrated = slides.join(entries.select(*KEY).distinct(), KEY, "left_semi")
    no_duration = narrated.where("audio_ms is null").select(*KEY, F.lit("no_duration").alias("code"), F.lit("the audio's length is not known; the default is used").alias("message"))
    no_events = narrated.join(events.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit("no_events").alias("code"), F.lit("no timed words; the slide has no captions").alias("message"))
    return no_duration.unionByName(no_events)


def subtitles(slides: DataFrame, entries: DataFrame, events: DataFrame, bounds: DataFrame | None = None, width: int = segment.DEFAULT_WIDTH, gap_ms: int = align.DEFAULT_GAP_MS) -> tuple[DataFrame, DataFrame]:
    """From slides, manifest entries and timed words to captions on the deck's timeline, and the warnings of all steps.

    Captions show the override of a slide, if it has one, else its notes. They are lines balanced within width."""
    shown = slides.withColumn("notes", spoken_text())
    matched = align.match(shown, events)
    # Slides without timed words have no captions.
    lines = align.match_lines(shown, events, segment.Segmenter(width))
    timed = align.clamp(align.filled(lines), gap_ms).select(*KEY, "seg_idx", "text", "start_ms", "end_ms")
    starts = timeline.predicted_starts(slides.select(*KEY, "audio_ms"))
    warnings = caption_warnings(slides, entries, events).unionByName(align.unmatched(events, matched))
    if bounds is None or bounds.isEmpty():
        return timeline.place(timed, starts), warnings
    placed = timeline.scales(starts, bounds)
    return timeline.place_measured(timed, placed), warnings.unionByName(timeline.scale_warnings(timed, placed))


def located(slides: DataFrame, entries: DataFrame, clips: DataFrame, tracks: DataFrame, anchor_s: float = signal.ANCHOR_S, search_s: float = signal.SEARCH_S, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """bounds (start_ms, end_ms) of the slides whose sound (clips: samples) is found in their deck's track, and warnings.

    Where a slide is looked for follows from the lengths before it, silent slides taking their default, so slides don't wait for one another."""
    starts = timeline.predicted_starts(slides.select(*KEY, "audio_ms")).select(*KEY, (F.col("predicted_ms") / 1000).alias("predicted_s"))
    asked = clips.join(entries.select(*KEY).distinct(), KEY, "left_semi").join(starts, KEY).select(*KEY, "predicted_s", "samples")
    found = signal.locate(asked, tracks, anchor_s=anchor_s, search_s=search_s, scale=scale)
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    silent = entries.select("deck_id").distinct().join(tracks.where("size(samples) > 0").select("deck_id"), "deck_id", "left_anti")
    no_track = silent.select("deck_id", F.lit(0).alias("slide_num"), F.lit("no_track").alias("code"), F.lit("the video's sound can't be read; the predicted timeline is used").alias("message"))
    told = signal.locate_warnings(entries, clips).unionByName(no_track)
    return found.select(*KEY, ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms")), told.withColumn("message", F.concat(F.lit("(true-start locate) "), "message"))


def subtitles_from_sound(slides: DataFrame, entries: DataFrame, events: DataFrame, clips: DataFrame, tracks: DataFrame, width: int = segment.DEFAULT_WIDTH, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Captions where the slides' sound stands in their deck's track, and all warnings. Decks that nothing is found of keep the predicted timeline."""
    bounds, told = located(slides, entries, clips, tracks, scale=scale)
    timed, warnings = subtitles(slides, entries, events, bounds, width)
    return timed, told.unionByName(warnings)


def suspects(slides: DataFrame, events: DataFrame) -> DataFrame:
    """Stretches of notes that were likely not spoken."""
    return gaps.dropped_narration(slides, align.match(slides, events))
