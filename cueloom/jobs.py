"""Jobs over the files of one deck, as run from the command line. Each returns an exit code: 0, or 1 if there is something to look at."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import logs
from cueloom.errors import CueError, InvalidInput
from cueloom.functions.text import slide_selector
from cueloom.operators import calibrate, fidelity, intervals, merge, segment, signal, srt, timeline
from cueloom.plans import captions
from cueloom.sinks import documents as sink
from cueloom.sources import audio, documents, pptx

KEY = ["deck_id", "slide_num"]
log = logging.getLogger(logs.NAME)


def whole_number(s: str) -> int:
    n = int(s)
    if n < 0:
        raise argparse.ArgumentTypeError("a number of 0 or more is asked for")
    return n


def _file(spark: SparkSession, path: str) -> DataFrame:
    if not Path(path).exists():
        raise InvalidInput(f"there is no file {path}")
    return spark.createDataFrame([(0, Path(path).read_text(encoding="utf-8-sig"))], "deck_id bigint, value string")


def read_slides(spark: SparkSession, path: str, selector: str | None = None) -> DataFrame:
    if pptx.is_deck(path):
        slides = pptx.read(spark, path).select(F.lit(0).cast("bigint").alias("deck_id"), "slide_num", "title", "notes", F.lit(None).cast("string").alias("subtitle_text"))
    else:
        slides = documents.slides(_file(spark, path))
    if selector is None:
        return slides
    numbers = spark.range(1).select(slide_selector(F.lit(selector)).alias("n")).first()["n"]
    if not numbers:
        raise InvalidInput(f"not a selection of slides: {selector}")
    return merge.require_selected(slides, spark.createDataFrame([(0, n) for n in numbers], "deck_id bigint, slide_num int"))


SAMPLES = "deck_id bigint, slide_num int, samples array<float>"


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """The sound of a video, taken out of it as a WAV file."""
    if not Path(path).is_file():
        raise InvalidInput(f"there is no file {path}")
    samples = audio.decode_wav(Path(path).read_bytes())
    if samples is None:
        raise InvalidInput(f"not a WAV file: {path}")
    return spark.createDataFrame([(0, samples.tolist())], "deck_id bigint, samples array<float>")


def read_clips(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The sound of each slide with an entry; null where it can't be read."""
    entries = merge.one_per_slide(documents.manifest_entries(_file(spark, args.manifest)), "entry_idx", last=True).collect()
    folder = Path(args.audio_dir or Path(args.manifest).parent)
    read = lambda name: audio.decode_wav((folder / name).read_bytes()) if name and (folder / name).is_file() else None
    sound = [(0, e.slide_num, None if (x := read(e.audio_file)) is None else x.tolist()) for e in entries]
    return spark.createDataFrame(sound, SAMPLES)


def read_deck(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """slides with the length of their audio, manifest entries, and events. Files of a deck are few; tables of decks need no such job."""
    slides = read_slides(spark, args.slides_json, getattr(args, "slides", None))
    entries = documents.manifest_entries(_file(spark, args.manifest))
    last = merge.one_per_slide(entries, "entry_idx", last=True).collect()
    folder = Path(args.audio_dir or Path(args.manifest).parent)
    sidecars, lengths = [], []
    for e in last:
        side, sound = folder / (e.word_boundaries_file or ""), folder / (e.audio_file or "")
        sidecars.append((0, e.slide_num, side.read_text(encoding="utf-8") if e.word_boundaries_file and side.is_file() else None))
        samples = audio.decode_wav(sound.read_bytes()) if e.audio_file and sound.is_file() else None
        lengths.append((0, e.slide_num, None if samples is None else len(samples) * 1000 // audio.RATE))
    events = documents.events(spark.createDataFrame(sidecars, "deck_id bigint, slide_num int, value string"))
    known = spark.createDataFrame(lengths, "deck_id bigint, slide_num int, audio_ms bigint")
    return slides.join(known, KEY, "left"), entries, events


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Bounds of slides, {slide: [start_ms, end_ms]}, as `sinks.documents.bounds` writes them, or a dump as `bound_dumps` does."""
    whole = _file(spark, path).select("deck_id", F.from_json("value", "bounds map<string,struct<start:double,end:double>>").alias("d")).where("d.bounds is not null")
    if not whole.isEmpty():
        ms = lambda c: F.round(F.col(f"at.{c}") * 1000).cast("bigint").alias(f"{c}_ms")
        return whole.select("deck_id", F.explode("d.bounds").alias("k", "at")).select("deck_id", F.col("k").cast("int").alias("slide_num"), ms("start"), ms("end"))
    each = _file(spark, path).select("deck_id", F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("k", "v"))
    return each.select("deck_id", F.col("k").cast("int").alias("slide_num"), F.get("v", F.lit(0)).alias("start_ms"), F.get("v", F.lit(1)).alias("end_ms"))


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    log.info("wrote %s", path)


def subtitles(spark: SparkSession, args: argparse.Namespace) -> int:
    """An empty file where there is no manifest."""
    text = ""
    if Path(args.manifest).exists():
        slides, entries, events = read_deck(spark, args)
        if args.strict:
            merge.require_notes(slides)
        bounds, told = read_bounds(spark, args.bounds) if args.bounds else None, None
        if args.track and bounds is None:
            try:
                bounds, told = captions.located(slides, entries, read_clips(spark, args), read_track(spark, args.track), scale=args.scale)
            except CueError as e:
                log.warning("(true-start locate) %s; the predicted timeline is used", e)
        timed, warnings = captions.subtitles(slides, entries, events, bounds, args.width)
        warnings = warnings if told is None else told.unionByName(warnings)
        for w in warnings.orderBy("slide_num", "code").collect():
            log.warning("slide %s: %s", w.slide_num, w.message)
        text = "".join(r.srt for r in captions.subtitle_files(timed).collect())
    _write(Path(args.output), text)
    return 0


def locate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Measures where slides stand in a track and writes parameters, warnings and bounds."""
    slides, entries, _ = read_deck(spark, args)
    bounds, told = captions.located(slides, entries, read_clips(spark, args), read_track(spark, args.track), args.anchor_seconds, args.search_seconds, args.scale)
    params = {"default_slide_duration": timeline.DEFAULT_MS / 1000, "search_window_seconds": args.search_seconds, "anchor_seconds": args.anchor_seconds, "global_scale_correction": args.scale}
    dump = sink.bound_dumps(bounds, told, params).first()
    if dump is None:
        raise InvalidInput("the manifest has no slides")
    whole = json.loads(dump.dump)
    for message in whole["warnings"]:
        log.warning("%s", message)
    _write(Path(args.output), json.dumps(whole, ensure_ascii=False, indent=2))
    return 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Looks sampled words of each slide up in a track and writes how far off they are; 1 if none can be measured."""
    slides, entries, events = read_deck(spark, args)
    clips, track = read_clips(spark, args), read_track(spark, args.track)
    bounds, _ = captions.located(slides, entries, clips, track)
    placed = timeline.scales(timeline.predicted_starts(slides.select(*KEY, "audio_ms")), bounds).where("code is null or code <> 'unmeasured'")
    sampled = signal.sample_evenly(events, KEY, "ev_idx", args.samples).join(placed, KEY)
    words = sampled.select(*KEY, "ev_idx", "text", (F.col("offset_ms") / 1000).alias("offset_s"), (F.col("duration_ms") / 1000).alias("duration_s"), (F.col("start_ms") / 1000).alias("start_s"), "scale")
    found = signal.word_report(signal.check_words(words, clips, track))
    texts = sink.csv_documents(found, ["deck_id"], list(signal.WORD_REPORT.values()), ["slide_num", "word_offset_seconds"]).collect()
    for t in texts:
        path = Path(args.csv)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(t.value.encode("utf-8"))
        log.info("wrote %s", path)
    return int(not texts)


def lines(spark: SparkSession, args: argparse.Namespace) -> int:
    """Prints the caption lines of a file, of a text, or of a sample."""
    texts = documents.whole_texts(spark, args.file, args.text, "One line after another. Each of them fits the width that is asked for.")
    for r in segment.segments(texts, ["path"], "value", args.width).orderBy("path", "seg_idx").collect():
        print(r.text)
    return 0


def gaps(spark: SparkSession, args: argparse.Namespace) -> int:
    slides, _, events = read_deck(spark, args)
    found = captions.suspects(slides, events).orderBy("slide_num", "source_start_offset").collect()
    for r in found:
        print(f"slide {r.slide_num}: {r.source_start_offset}-{r.source_end_offset} not spoken? {r.skipped_text[:120]!r}")
    return int(bool(found))


def calibration(spark: SparkSession, args: argparse.Namespace) -> int:
    observed = documents.require_observations(documents.observations(_file(spark, args.observations)))
    bounds = read_bounds(spark, args.bounds)
    points = observed.join(bounds, KEY).select(*KEY, (F.col("start_ms") / 1000).alias("measured"), "observed")
    calibrate.require_scale(calibrate.fit_scale(points, ["deck_id"]))
    r = calibrate.report(points, ["deck_id"]).first()
    if r is None:
        raise InvalidInput("no observed slide was measured")
    missing = [x.slide_num for x in calibrate.missing(observed, bounds, KEY).orderBy("slide_num").collect()]
    rows = [{k: x[k] for k in ("slide_num", "measured", "observed", "corrected", "residual")} for x in calibrate.residuals(points, ["deck_id"]).orderBy("slide_num").collect()]
    print(json.dumps({"suggested_scale": r.k, "rms": r.rms, "max_residual": r.max_residual, "doubtful": r.doubtful, "missing_slides": missing, "rows": rows}))
    return 0


def split(spark: SparkSession, args: argparse.Namespace) -> int:
    starts = read_bounds(spark, args.bounds).select(*KEY, F.col("start_ms").alias("at_ms"))
    length = args.total_ms if args.total_ms is not None else read_track(spark, args.track).select((F.size("samples") * 1000 / audio.RATE).cast("bigint").alias("n")).first().n if args.track else None
    if length is None:
        raise InvalidInput("the whole length is asked for, or a track that has it")
    total = spark.createDataFrame([(0, length)], "deck_id bigint, total_ms bigint")
    if args.after:
        numbers = spark.range(1).select(slide_selector(F.lit(args.after)).alias("n")).first()["n"]
        cuts = intervals.require_cuts(starts, spark.createDataFrame([(0, n) for n in numbers or []], "deck_id bigint, slide_num int"))
    else:
        cuts = intervals.equal_cuts(starts, total, args.parts)
    cues = srt.parse_srt(_file(spark, args.srt).withColumnRenamed("value", "srt"), ["deck_id"])
    parts = srt.format_srt(intervals.clip(cues, intervals.windows(cuts.select("deck_id", "at_ms"), total)), ["deck_id", "part_idx"], ["cue_idx"])
    for p in parts.orderBy("part_idx").collect():
        _write(Path(args.output) / f"part_{p.part_idx + 1:02d}.srt", p.srt)
    return 0


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    texts = [(0, *(Path(p).read_text(encoding="utf-8") for p in (args.original, args.processed)))]
    pairs = spark.createDataFrame(texts, "doc_id bigint, original string, processed string")
    found = [fidelity.content_changes(pairs), fidelity.wide_lines(pairs, args.width), fidelity.split_words(pairs), fidelity.block_counts(pairs).where("differs")]
    for f in found:
        for r in f.drop("doc_id").collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    return fidelity.summary(*found).first().exit_code


def set_text(spark: SparkSession, args: argparse.Namespace) -> int:
    """Rewrites one field of the slides file and leaves everything else as it is."""
    path = Path(args.slides_json)
    whole = json.loads(path.read_text(encoding="utf-8"))
    slides = whole["slides"] if isinstance(whole, dict) else whole
    hit = [s for s in slides if s.get("slide_num") == args.slide]
    if not hit:
        log.error("there is no slide %s; there are %s", args.slide, sorted(s.get("slide_num") for s in slides))
        return 1
    for s in hit:
        s["subtitle_text"] = args.text
    _write(path, json.dumps(whole, ensure_ascii=False, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cueloom", description="Captions of narrated decks.")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--log-file")
    jobs = p.add_subparsers(required=True)

    def job(name: str, run, *options: tuple) -> None:
        q = jobs.add_parser(name, description=run.__doc__)
        q.set_defaults(run=run)
        for flag, rest in options:
            q.add_argument(flag, **rest)

    need, text = {"required": True}, {"default": None}
    deck = [("--slides-json", need), ("--manifest", need), ("--audio-dir", text), ("--slides", text)]
    wide = ("--width", {"type": whole_number, "default": 36})
    scale, seconds = ("--scale", {"type": float, "default": 1.0}), lambda x: {"type": float, "default": x}
    job("subtitles", subtitles, *deck, ("--bounds", text), ("--track", text), scale, ("--output", need), ("--strict", {"action": "store_true"}), wide)
    job("locate", locate, *deck, ("--track", need), scale, ("--anchor-seconds", seconds(signal.ANCHOR_S)), ("--search-seconds", seconds(signal.SEARCH_S)), ("--output", need))
    job("verify", verify, *deck, ("--track", need), ("--samples", {"type": whole_number, "default": 3}), ("--csv", need))
    job("lines", lines, ("--file", text), ("--text", text), wide)
    job("gaps", gaps, *deck)
    job("calibrate", calibration, ("--observations", need), ("--bounds", need))
    job("split", split, ("--srt", need), ("--bounds", need), ("--total-ms", {"type": whole_number, "default": None}), ("--track", text), ("--parts", {"type": whole_number, "default": 2}), ("--after", text), ("--output", need))
    job("compare", compare, ("--original", need), ("--processed", need), wide)
    job("set-text", set_text, ("--slides-json", need), ("--slide", {"type": int, "required": True}), ("--text", need))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logs.utf8_console()
    logs.start(args.verbose, args.log_file)
    try:
        return args.run(spark or SparkSession.builder.appName("cueloom").getOrCreate(), args)
    except CueError as e:
        log.error("%s", e)
        return 1
    finally:
        logs.stop()
