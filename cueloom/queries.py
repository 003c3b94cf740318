"""One query for each operator, over the tables of the test data. Whole numbers come out as bigint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions.timecode import milliseconds, parse, timestamp
from cueloom.operators import align, calibrate, fidelity, gaps, insertion, intervals, merge, segment, signal, srt, timeline
from cueloom.plans import captions
from cueloom.sinks import documents as sink
from cueloom.sources import bindings as b
from cueloom.sources import documents as source

KEY = ["deck_id", "slide_num"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])

    QUERIES[f.__name__] = run
    return run


def _docs(spark, d):
    return b.table(spark, d, "documents")


def _starts(spark, d):
    return timeline.predicted_starts(b.slides(spark, d).select(*KEY, "audio_ms"))


def _bounds(spark, d):
    return b.bounds(_starts(spark, d))


def _segments(spark, d):
    return segment.sentence_segments(b.slides(spark, d), KEY)


def _spans(spark, d):
    return _segments(spark, d).drop("text")


def _cues(spark, d):
    order = Window.partitionBy("deck_id").orderBy("slide_num", "seg_idx")
    timed = captions.predictive(b.slides(spark, d), b.told(spark, d))
    return timed.select("deck_id", (F.row_number().over(order) - 1).alias("cue_idx"), "start_ms", "end_ms", "text")


def _totals(spark, d):
    return _starts(spark, d).groupBy("deck_id").agg(F.sum("duration_ms").alias("total_ms"))


def _windows(spark, d):
    cut = _starts(spark, d).where("slide_num = 3").select("deck_id", F.col("predicted_ms").alias("at_ms"))
    return intervals.windows(cut, _totals(spark, d))


def _pairs(spark, d):
    """Rewrites that put marks at line ends, and cut the first word of every third text."""
    base = F.replace("text", F.lit("\n"), F.lit(".\n"))
    at = F.regexp_instr(base, F.lit("[a-z][a-z]"))
    cut = F.when(at > 0, F.concat(F.left(base, at), F.lit("\n"), F.substr(base, at + 1, F.length(base)))).otherwise(base)
    return _docs(spark, d).select("doc_id", F.col("text").alias("original"), F.when(F.col("doc_id") % 3 == 0, cut).otherwise(F.replace("text", F.lit("\n"), F.lit("!\n"))).alias("processed"))


@query
def predictive_captions(spark, d):
    timed = captions.predictive(b.slides(spark, d), b.told(spark, d))
    return timed.select(*KEY, "seg_idx", "text", timestamp(F.col("start_ms")).alias("start_at"), timestamp(F.col("end_ms")).alias("end_at"))


@query
def txt1_char_width(spark, d):
    c = _docs(spark, d).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()
    return c.select("ch", tx.display_width(F.col("ch")).alias("width"), tx.is_wide(F.col("ch")).alias("wide"), tx.is_cjk(F.col("ch")).alias("cjk"))


@query
def txt2_display_width(spark, d):
    return _docs(spark, d).select("doc_id", tx.display_width(F.col("text")).alias("width"))


@query
def txt4_strip_trailing(spark, d):
    return _docs(spark, d).select("doc_id", tx.strip_trailing_punctuation(F.col("text")).alias("stripped"))


@query
def txt5_normalize_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", tx.display_text(F.col("text")).alias("shown"))


@query
def txt7_fits(spark, d):
    units = segment.units(segment.paragraphs(b.slides(spark, d), KEY), KEY)
    return units.groupBy(*KEY).agg(F.count("*").alias("units"), F.count_if(tx.fits(F.col("piece"), 36)).alias("fitting"))


@query
def txt8_numeric_punctuation(spark, d):
    return _docs(spark, d).select("doc_id", tx.numeric_punctuation(F.col("text")).alias("n"))


@query
def txt11_content(spark, d):
    return _docs(spark, d).select("doc_id", tx.content(F.col("text")).alias("content"))


@query
def txt12_timestamp(spark, d):
    lines = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", milliseconds((F.col("l_extendedprice") - 1000) / 8).alias("ms"))
    return lines.groupBy("l_orderkey", "l_linenumber", "ms").agg(F.count("*").alias("n")).select("l_orderkey", "l_linenumber", timestamp(F.col("ms")).alias("at"), "n")


@query
def txt13_parse_timestamp(spark, d):
    ms = (b.table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint") * 71777).distinct()).toDF("ms")
    return ms.select(parse(timestamp(F.col("ms"))).alias("ms"))


@query
def txt14_selector(spark, d):
    p = b.table(spark, d, "part").select((F.col("p_partkey") % 40 + 1).alias("a"), (F.col("p_size") % 10).alias("d")).distinct()
    written = F.when(F.col("d") == 0, F.col("a").cast("string")).otherwise(F.concat(F.col("a"), F.lit(", "), F.col("a") + 2, F.lit("-"), F.col("a") + 1 + F.col("d")))
    return p.select("a", "d", F.explode(tx.slide_selector(written)).alias("slide"))


@query
def txt16_audio_name(spark, d):
    return b.slides(spark, d).select("slide_num").distinct().select("slide_num", tx.audio_name(F.col("slide_num")).alias("name"))


@query
def txt17_preview(spark, d):
    return _docs(spark, d).select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query
def txt19_burn_filter(spark, d):
    return b.table(spark, d, "pages").select("page_id", tx.burn_filter(F.col("url")).alias("filter"))


def _pieces(df):
    return df.select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "piece")


@query
def seg1_paragraphs(spark, d):
    p = segment.paragraphs(_docs(spark, d), ["doc_id"], "text")
    return p.select("doc_id", "par_idx", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "piece")


@query
def seg2_primary_units(spark, d):
    return _pieces(segment.units(segment.paragraphs(_docs(spark, d), ["doc_id"], "text"), ["doc_id"]))


@query
def seg2_secondary_units(spark, d):
    return _pieces(segment.units(segment.paragraphs(_docs(spark, d), ["doc_id"], "text"), ["doc_id"], tx.SECONDARY_BREAKS))


@query
def seg10_balanced_lines(spark, d):
    return segment.segments(_docs(spark, d), ["doc_id"], "text")


@query
def seg10_slide_lines(spark, d):
    """Balanced lines of the notes of slides."""
    lines = segment.segments(b.slides(spark, d).where("notes is not null"), KEY)
    return lines.withColumnsRenamed({"source_start_offset": "source_start", "source_end_offset": "source_end"})


@query
def aln1_occurrences(spark, d):
    docs = _docs(spark, d)
    found = align.occurrences(F.col("text"), F.left("text", F.lit(2)))
    return docs.select("doc_id", F.explode(found).alias("at"))


def _matches(m):
    return m.select(*KEY, "ev_idx", F.col("source_start_offset").alias("source_start"), "offset_ms")


@query
def aln4_match_events(spark, d):
    return _matches(align.match(b.slides(spark, d), b.events(spark, d)))


@query
def aln5_overlaps(spark, d):
    return align.overlaps(_segments(spark, d), b.told(spark, d)).select(*KEY, "seg_idx", "raw_start", "raw_end")


@query
def aln6_interpolate(spark, d):
    return align.timed(_spans(spark, d), b.told(spark, d)).select(*KEY, "seg_idx", "start_ms", "end_ms", "interpolated")


@query
def aln7_clamp(spark, d):
    return align.timed(_spans(spark, d), b.told(spark, d), align.DEFAULT_GAP_MS).select(*KEY, "seg_idx", "start_ms", "end_ms")


@query
def aln8_captions(spark, d):
    return captions.slide_captions(b.slides(spark, d), b.told(spark, d)).select(*KEY, "seg_idx", "text", "start_ms", "end_ms", "interpolated")


@query
def aln8_balanced_captions(spark, d):
    return captions.balanced_captions(b.slides(spark, d), b.told(spark, d)).select(*KEY, "seg_idx", "text", "start_ms", "end_ms", "interpolated")


@query
def gap1_dropped_narration(spark, d):
    found = gaps.dropped_narration(b.slides(spark, d), b.matched(spark, d))
    return found.select(*KEY, F.col("source_start_offset").alias("source_start"), F.col("source_end_offset").alias("source_end"), "skipped_text", "gap_ms", F.round("expected_ms", 4).alias("expected_ms"), "audio_position_ms")


@query
def gap2_recheck(spark, d):
    slides = b.slides(spark, d)
    return gaps.recheck(slides, slides.where("notes is not null and slide_num % 5 <> 0"), b.matched(spark, d))


@query
def gap3_self_consistency(spark, d):
    late = F.col("offset_ms") - F.when(F.col("ev_idx") % 50 == 49, 700).otherwise(0)
    return gaps.self_consistency(b.events(spark, d).withColumn("offset_ms", late), b.slides(spark, d).select(*KEY, "audio_ms"), KEY)


@query
def gap3_worst_slide(spark, d):
    return gaps.worst_slide(gaps.self_consistency(b.events(spark, d), b.slides(spark, d).select(*KEY, "audio_ms"), KEY))


@query
def gap3_event_disorder(spark, d):
    # From days and the clock, so that the session's time zone doesn't matter.
    clock = (F.hour("ts") * 60 + F.minute("ts")) * 60_000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000)
    at = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("bigint") * 86_400_000 + clock
    events = b.table(spark, d, "events").select("user_id", F.col("event_id").alias("ev_idx"), at.alias("offset_ms"), F.lit(160).alias("duration_ms"))
    ends = events.groupBy("user_id").agg(F.max("offset_ms").alias("audio_ms"))
    return gaps.self_consistency(events, ends, ["user_id"]).select("user_id", "out_of_order")


@query
def gap4_drift(spark, d):
    return gaps.drift(b.slides(spark, d), _bounds(spark, d))


@query
def tl1_spoken_text(spark, d):
    return b.slides(spark, d).select(*KEY, merge.spoken_text().alias("spoken"), F.coalesce("audio_ms", F.lit(5000)).alias("duration_ms"), F.when(F.col("notes").isNull(), "silent").alias("code"))


@query
def tl1_warnings(spark, d):
    """Every fourth slide lacks its sidecar, and every eleventh deck its audio."""
    slides = b.slides(spark, d).withColumn("audio_ms", F.when(F.col("deck_id") % 11 != 0, F.col("audio_ms")))
    heard = b.matched(spark, d).where("slide_num % 4 <> 0")
    return captions.caption_warnings(slides, b.entries(spark, d), heard).select(*KEY, "code")


@query
def tl2_predicted_starts(spark, d):
    return _starts(spark, d).select(*KEY, "duration_ms", "predicted_ms")


@query
def tl2_large_timeline(spark, d):
    return timeline.predicted_starts(b.line_slides(spark, d)).select(*KEY, "duration_ms", "predicted_ms")


@query
def tl3a_direct_scale(spark, d):
    return timeline.direct_scales(_starts(spark, d), _bounds(spark, d)).select(*KEY, F.round("direct", 9).alias("direct"))


@query
def tl3b_inferred_scale(spark, d):
    return timeline.inferred_scales(_starts(spark, d), _bounds(spark, d)).select(*KEY, F.round("inferred", 9).alias("inferred"))


@query
def tl3c_scales(spark, d):
    return timeline.scales(_starts(spark, d), _bounds(spark, d)).select(*KEY, "start_ms", F.round("scale", 9).alias("scale"), "code")


@query
def tl3_measured_captions(spark, d):
    return captions.measured(b.slides(spark, d), b.told(spark, d), _bounds(spark, d))[0]


@query
def tl3_subtitles(spark, d):
    """The whole way from notes and timed words to balanced captions on the measured timeline."""
    return captions.subtitles(b.slides(spark, d), b.entries(spark, d), b.events(spark, d), _bounds(spark, d))[0]


@query
def tl3_warnings(spark, d):
    return captions.measured(b.slides(spark, d), b.told(spark, d), _bounds(spark, d))[1].select(*KEY, "code")


def _vectors(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query
def aud1_standardize(spark, d):
    return signal.standardized(_vectors(spark, d), ["vec_id"]).select("vec_id", "i", F.round("v", 5).alias("z"))


@query
def aud2_best_lags(spark, d):
    v = _vectors(spark, d)
    track = v.select((F.col("vec_id") * 64 + F.col("i")).alias("pos"), "v")
    clips = v.select(F.col("vec_id").alias("clip_id"), "i", "v", (F.col("vec_id") * 64 + F.col("vec_id") % 7).alias("predicted"))
    return signal.best_lags(track, clips, 96)


@query
def aud4_locate(spark, d):
    """Vectors in runs of ten as decks: where each stands in its deck, by FFT, at 64 samples a second."""
    v = b.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("deck_id"), (F.col("vec_id") % 10 + 1).cast("int").alias("slide_num"), F.col("embedding").alias("samples"))
    tracks = v.groupBy("deck_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slide_num", "samples"))), lambda x: x["samples"])).alias("samples"))
    clips = v.withColumn("predicted_s", (F.col("slide_num") - 1) * 1.05)
    found = signal.locate(clips, tracks, rate=64, anchor_s=0.25, search_s=2.0)
    return found.select(*KEY, F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query
def aud5_sampling(spark, d):
    return signal.sample_evenly(b.matched(spark, d), KEY, "ev_idx", 7).where("offset_ms >= 50").select(*KEY, "ev_idx")


@query
def aud5_word_check(spark, d):
    """Every eighth sample of a vector as a word: where it is found in its deck's track, at 64 samples a second."""
    v = b.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("deck_id"), (F.col("vec_id") % 10 + 1).cast("int").alias("slide_num"), F.col("embedding").alias("samples"))
    tracks = v.groupBy("deck_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slide_num", "samples"))), lambda x: x["samples"])).alias("samples"))
    each = v.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ev_idx"))
    words = each.select(*KEY, "ev_idx", F.concat(F.lit("w"), "ev_idx").alias("text"), (F.col("ev_idx") / 8).alias("offset_s"), F.lit(0.1).alias("duration_s"), ((F.col("slide_num") - 1) * 1.01).alias("start_s"), F.lit(1.01).alias("scale"))
    found = signal.check_words(words, v, tracks, rate=64)
    return found.select(*KEY, "ev_idx", F.round("naive_delta", 6).alias("naive_delta"), F.round("implied_scale", 6).alias("implied_scale"), F.round("measured_s", 6).alias("measured_s"))


@query
def aud4_warnings(spark, d):
    sound = b.entries(spark, d).where("audio_file is not null").select(*KEY, F.array(F.lit(0.0)).alias("samples"))
    return signal.locate_warnings(b.entries(spark, d), sound).select(*KEY, "code")


def _points(spark, d, noise):
    q = F.col("l_quantity")
    return b.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("deck_id"), q.alias("measured"), (q * 1.00121 + noise).alias("observed"))


@query
def cal1_fit_scale(spark, d):
    return calibrate.fit_scale(_points(spark, d, F.lit(0.0)), ["deck_id"]).select("deck_id", F.round("k", 8).alias("k"), "n")


@query
def cal2_report(spark, d):
    noise = (F.col("l_partkey") % 5 - 2) * F.when(F.col("l_orderkey") % 50 < 10, 1.5).otherwise(0.1)
    r = calibrate.report(_points(spark, d, noise), ["deck_id"])
    return r.select("deck_id", F.round("k", 8).alias("k"), "n", F.round("rms", 6).alias("rms"), F.round("max_residual", 6).alias("max_residual"), "doubtful")


@query
def cal3_suggest(spark, d):
    starts = _starts(spark, d).where("predicted_ms > 0").select("deck_id", (F.col("predicted_ms") / 1000).alias("predicted_s"), (F.col("predicted_ms") * 1.0012 / 1000).alias("measured_s"))
    return calibrate.suggest(starts, ["deck_id"]).select("deck_id", F.round("k", 6).alias("k"), "n", F.round("rms", 6).alias("rms"), "doubtful")


@query
def cal2_missing(spark, d):
    return calibrate.missing(_starts(spark, d), _bounds(spark, d), KEY).select(*KEY)


@query
def cal4_ranges(spark, d):
    joined = _bounds(spark, d).join(_starts(spark, d), KEY)
    return calibrate.ranges(joined.select((F.col("start_ms") - F.col("predicted_ms")).alias("delta"), F.col("start_ms").alias("start")), ["delta", "start"])


@query
def ivl1_clip(spark, d):
    return intervals.clip(_cues(spark, d), _windows(spark, d))


@query
def ivl2_windows(spark, d):
    return _windows(spark, d)


@query
def ivl3_equal_cuts(spark, d):
    return intervals.equal_cuts(_starts(spark, d).withColumn("at_ms", F.col("predicted_ms")), _totals(spark, d), 2)


@query
def ivl4_cuts_after(spark, d):
    starts = _starts(spark, d).select(*KEY, F.col("predicted_ms").alias("at_ms"))
    return intervals.cuts_after(starts, starts.where("slide_num % 2 = 0").select(*KEY))


@query
def ivl5_overlapping(spark, d):
    raw = align.overlaps(_segments(spark, d), b.told(spark, d)).where("raw_start is not null")
    late = F.col("raw_end") + F.when(F.col("seg_idx") % 3 == 0, 500).otherwise(0)
    return intervals.overlapping(raw.select(*KEY, F.col("seg_idx").alias("cue_idx"), F.col("raw_start").alias("start_ms"), late.alias("end_ms")), KEY)


@query
def srt2_format(spark, d):
    return srt.format_srt(_cues(spark, d), ["deck_id"], ["cue_idx"])


@query
def srt3_round_trip(spark, d):
    return srt.parse_srt(srt.format_srt(_cues(spark, d), ["deck_id"], ["cue_idx"]), ["deck_id"])


@query
def snk10_part_files(spark, d):
    return srt.format_srt(intervals.clip(_cues(spark, d), _windows(spark, d)), ["deck_id", "part_idx"], ["cue_idx"])


@query
def mrg1_upsert(spark, d):
    old = merge.one_per_slide(b.entries(spark, d), "entry_idx", last=False).select(*KEY, "audio_file")
    return merge.upsert(old, b.slides(spark, d).where("slide_num % 3 = 1").select(*KEY, F.lit("new.mp3").alias("audio_file")))


@query
def mrg3_manifest(spark, d):
    """Every third deck has entries of this run, the others have stored ones; some have neither."""
    known = b.entries(spark, d).where("entry_idx = 0").select(*KEY, "audio_file")
    return merge.resolve_manifest(known.where("deck_id % 3 = 0").withColumn("audio_file", F.lit("now.mp3")), known.where("deck_id % 5 <> 0"))


def _wanted(spark, d):
    return b.slides(spark, d).select("deck_id").distinct().select("deck_id", F.explode(tx.slide_selector(F.lit("1,3-4"))).alias("slide_num"))


@query
def mrg2_selected(spark, d):
    return merge.selected(b.slides(spark, d), _wanted(spark, d)).select(*KEY, "title")


@query
def mrg2_absent(spark, d):
    return merge.absent(b.slides(spark, d), _wanted(spark, d))


@query
def mrg4_subtitle_text(spark, d):
    slides = b.slides(spark, d)
    return merge.apply_subtitle_text(slides, slides.where("slide_num = 2").select(*KEY, F.lit("replaced").alias("new_text"))).select(*KEY, "subtitle_text")


@query
def join1_enrich(spark, d):
    return merge.enrich(b.slides(spark, d), b.entries(spark, d)).select(*KEY, "audio_file", "has_notes")


@query
def join2_audio_map(spark, d):
    return merge.audio_map(b.entries(spark, d))


@query
def flt1_narratable(spark, d):
    return b.slides(spark, d).where(merge.narratable()).select(*KEY)


@query
def flt2_missing_notes(spark, d):
    return b.slides(spark, d).where("notes is null").select(*KEY)


@query
def src2_titles(spark, d):
    """The first line of a text that is not blank and not a prompt, as the first shape of a slide."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s")).withColumn("s", tx.strip(F.col("s")))
    return lines.where("s <> '' and lower(s) <> 'click to add title'").groupBy("doc_id").agg(F.min_by("s", "i").alias("title"))


@query
def src3_notes(spark, d):
    joined = F.array_join(F.transform(F.split("text", "\n", -1), tx.strip), "\n")
    return _docs(spark, d).select("doc_id", F.nullif(tx.strip(joined), F.lit("")).alias("notes"))


@query
def ext9_insertion(spark, d):
    """Audio for slides and one slide more in each deck; files of every third slide are not there."""
    audio = merge.audio_map(b.entries(spark, d))
    extra = audio.groupBy("deck_id").agg((F.max("slide_num") + 100).alias("slide_num")).withColumn("audio_file", F.lit("extra.mp3"))
    files = audio.where("slide_num % 3 <> 0").select("deck_id", "audio_file").unionByName(extra.select("deck_id", "audio_file")).distinct()
    return insertion.plan(audio.unionByName(extra), files, b.slides(spark, d))


@query
def snk4_subtitle_files(spark, d):
    """Decks without manifest entries have an empty file."""
    decks = b.table(spark, d, "customer").select(F.col("c_custkey").alias("deck_id"))
    timed = captions.predictive(b.slides(spark, d), b.told(spark, d))
    return captions.subtitle_file_for_each(timed, decks)


@query
def src4_manifest(spark, d):
    return source.manifest_entries(sink.manifests(b.entries(spark, d))).select(*KEY, "title", "audio_file", F.when(F.col("slide_num") == 2, F.row_number().over(Window.partitionBy(*KEY).orderBy("entry_idx")) - 1).otherwise(0).alias("entry_idx"))


@query
def src5_slide_documents(spark, d):
    """Even decks as objects, odd ones as bare lists."""
    rows = b.slides(spark, d).groupBy("deck_id").agg(F.sort_array(F.collect_list(F.struct("slide_num", "title", "notes"))).alias("slides"))
    written = F.when(F.col("deck_id") % 2 == 0, F.to_json(F.struct("slides"))).otherwise(F.to_json("slides"))
    return source.slides(rows.select("deck_id", written.alias("value"))).select(*KEY, "title", "notes")


def _sidecars(spark, d):
    whole = sink.sidecars(b.events(spark, d))
    return whole.withColumn("value", F.when(F.col("deck_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("value")))


@query
def src6_sidecars(spark, d):
    return source.events(_sidecars(spark, d)).select(*KEY, "ev_idx", "text", "offset_ms")


@query
def src6_sidecar_warnings(spark, d):
    return source.event_warnings(_sidecars(spark, d)).select(*KEY, "code")


@query
def src12_observations(spark, d):
    entry = F.struct(F.col("slide_num").cast("string").alias("key"), (F.col("predicted_ms") / 1000).alias("value"))
    maps = _starts(spark, d).groupBy("deck_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return source.observations(maps).select(*KEY, F.round("observed", 3).alias("observed"))


@query
def snk1_payload(spark, d):
    """Payloads, read again and counted."""
    kind = "slide_count int, slides array<struct<slide_num:int,has_notes:boolean,audio_file:string>>"
    p = sink.payloads(b.slides(spark, d), b.entries(spark, d)).select("deck_id", F.from_json("payload", kind).alias("p"))
    return p.select("deck_id", "p.slide_count", F.size(F.filter("p.slides", lambda s: s["has_notes"])).alias("narrated"), F.size(F.filter("p.slides", lambda s: s["audio_file"].isNotNull())).alias("with_audio"))


@query
def snk7_bounds(spark, d):
    return sink.bounds(_bounds(spark, d))


@query
def snk7_bounds_dump(spark, d):
    """Dumps with parameters and warnings, read again."""
    warnings = b.slides(spark, d).where("slide_num % 4 = 0").select(*KEY, F.lit("x").alias("code"), F.concat(F.lit("slide "), F.col("slide_num").cast("string")).alias("message"))
    dumps = sink.bound_dumps(_bounds(spark, d), warnings, {"anchor_seconds": 8.0, "scale": 1.0})
    kind = "params struct<anchor_seconds:double,scale:double>, warnings array<string>, bounds map<string,struct<start:double,end:double>>"
    r = dumps.select("deck_id", F.from_json("dump", kind).alias("r"))
    return r.select("deck_id", F.col("r.params.anchor_seconds").alias("anchor"), F.array_join("r.warnings", ";").alias("warnings"), F.explode_outer("r.bounds").alias("slide", "at")).select(
        "deck_id", "anchor", "warnings", "slide", F.round(F.col("at.start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("at.end") * 1000).cast("bigint").alias("end_ms")
    )


@query
def snk8_csv_documents(spark, d):
    """The first events of each slide as CSV text."""
    rows = b.matched(spark, d).where("ev_idx < 3").withColumn("name", F.when(F.col("ev_idx") == 1, 'a "quoted", one').otherwise(F.lit("plain")))
    return sink.csv_documents(rows, ["deck_id"], ["slide_num", "ev_idx", "name", "offset_ms"], ["slide_num", "ev_idx"])


@query
def snk9_calibration_report(spark, d):
    """Reports, read again."""
    m = F.col("start_ms").cast("double")
    points = _bounds(spark, d).select(*KEY, m.alias("measured"), (m * 1.00121).alias("observed"))
    reports = sink.calibration_reports(calibrate.report(points, ["deck_id"]), calibrate.residuals(points, ["deck_id"]))
    read = reports.select("deck_id", F.from_json("report", "suggested_scale double, n bigint").alias("r"))
    return read.select("deck_id", F.round("r.suggested_scale", 8).alias("k"), "r.n")


@query
def fid1_content_changed(spark, d):
    return fidelity.content_changed(_pairs(spark, d))


@query
def fid1_content_changes(spark, d):
    pairs = _docs(spark, d).select("doc_id", F.col("text").alias("original"), F.replace("text", F.lit(" the "), F.lit(" a ")).alias("processed"))
    return fidelity.content_changes(pairs)


@query
def fid2_wide_lines(spark, d):
    return fidelity.wide_lines(_pairs(spark, d).select("doc_id", "processed"))


@query
def fid3_split_words(spark, d):
    return fidelity.split_words(_pairs(spark, d))


@query
def fid4_block_counts(spark, d):
    pairs = _pairs(spark, d).withColumn("original", F.replace("original", F.lit("\n"), F.lit("\n\n")))
    return fidelity.block_counts(pairs)


@query
def fid4_merged_blocks(spark, d):
    pairs = _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("original"), F.regexp_replace("text", r"^([^\n]*\n[^\n]*)\n", "$1\n\n").alias("processed"))
    return fidelity.merged_blocks(pairs)


@query
def fid5_summary(spark, d):
    return fidelity.summary(fidelity.content_changed(_pairs(spark, d)).where("changed"))
