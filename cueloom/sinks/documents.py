"""Payloads, sidecars, reports and subtitle files as text, one document for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.operators.merge import enrich

KEY = ["deck_id", "slide_num"]


def _rows(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def payloads(slides: DataFrame, entries: DataFrame) -> DataFrame:
    """payload: each deck's slides with their notes and audio as one JSON document."""
    rows = enrich(slides, entries).groupBy("deck_id").agg(_rows("slide_num", "title", "notes", "subtitle_text", "has_notes", "audio_file").alias("slides"))
    return rows.select("deck_id", F.to_json(F.struct(F.size("slides").alias("slide_count"), "slides", F.struct(F.lit("cueloom").alias("generated_by")).alias("metadata")), {"ignoreNullFields": "false"}).alias("payload"))


def manifests(entries: DataFrame) -> DataFrame:
    rows = entries.groupBy("deck_id").agg(F.transform(_rows("slide_num", "entry_idx", "title", "audio_file"), lambda e: F.struct(e["slide_num"].alias("slide_num"), e["title"].alias("title"), e["audio_file"].alias("audio_file"))).alias("slides"))
    return rows.select("deck_id", F.to_json(F.struct(F.lit("neutral").alias("voice"), F.lit("+0%").alias("rate"), F.lit("+0Hz").alias("pitch"), F.lit("audio").alias("output_dir"), "slides"), {"ignoreNullFields": "false"}).alias("value"))


def sidecars(events: DataFrame) -> DataFrame:
    """value: the events of each slide as a JSON list."""
    rows = events.groupBy(*KEY).agg(_rows("ev_idx", "text", "offset_ms", "duration_ms").alias("e"))
    seconds = lambda e: F.struct(e["text"].alias("text"), (e["offset_ms"] / 1000).alias("offset_seconds"), (e["duration_ms"] / 1000).alias("duration_seconds"))
    return rows.select(*KEY, F.to_json(F.transform("e", seconds)).alias("value"))


def bounds(measured: DataFrame) -> DataFrame:
    """bounds: slide number, as text, to start and end, by slide."""
    entry = F.concat(F.lit('"'), F.col("slide_num").cast("string"), F.lit('":['), F.col("start_ms").cast("string"), F.lit(","), F.coalesce(F.col("end_ms").cast("string"), F.lit("null")), F.lit("]"))
    rows = measured.select("deck_id", "slide_num", entry.alias("entry")).groupBy("deck_id").agg(_rows("slide_num", "entry").alias("r"))
    return rows.select("deck_id", F.concat(F.lit("{"), F.array_join(F.transform("r", lambda r: r["entry"]), ","), F.lit("}")).alias("bounds"))


def bound_dumps(measured: DataFrame, warnings: DataFrame, params: dict[str, float]) -> DataFrame:
    """dump: the parameters of a measurement, its warnings, and the bounds in seconds by slide number, as JSON."""
    seconds = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    rows = measured.select("deck_id", "slide_num", seconds.alias("at")).groupBy("deck_id").agg(_rows("slide_num", "at").alias("r"))
    told = warnings.groupBy("deck_id").agg(F.transform(_rows("slide_num", "code", "message"), lambda w: w["message"]).alias("w"))
    by_slide = F.map_from_entries(F.transform("r", lambda r: F.struct(r["slide_num"].cast("string").alias("key"), r["at"].alias("value"))))
    whole = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"), F.coalesce("w", F.array().cast("array<string>")).alias("warnings"),
        F.coalesce(by_slide, F.create_map().cast("map<string,struct<start:double,end:double>>")).alias("bounds"),
    )
    return rows.join(told, "deck_id", "full").select("deck_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("dump"))


def csv_documents(rows: DataFrame, key: list[str], columns: list[str], order: list[str], bom: bool = True) -> DataFrame:
    """value: the rows of each key as one CSV text with a header, lines ended by CR and LF, and a byte order mark before it, so that spreadsheets read it as UTF-8."""
    head = ("\ufeff" if bom else "") + ",".join(columns)
    line = F.to_csv(F.struct(*columns), {"quoteEscape": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    lines = rows.select(*key, F.struct(*order, line.alias("line")).alias("r")).groupBy(*key).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return lines.select(*key, F.concat(F.lit(head + "\r\n"), F.array_join(F.transform("r", lambda r: r["line"]), "\r\n"), F.lit("\r\n")).alias("value"))


def calibration_reports(fitted: DataFrame, points: DataFrame) -> DataFrame:
    """report: scale and statistics of each deck with its points, as JSON."""
    rows = points.groupBy("deck_id").agg(_rows("slide_num", "measured", "observed", "corrected", "residual").alias("rows"))
    return fitted.join(rows, "deck_id").select("deck_id", F.to_json(F.struct(F.col("k").alias("suggested_scale"), "n", "rms", "max_residual", "rows")).alias("report"))


def write_one_file_each(documents: DataFrame, key: list[str], value: str, path: str) -> None:
    """Each document in a folder named by its key, whatever the number of decks."""
    named = [F.col(k).alias(f"by_{k}") for k in key]
    documents.select(*named, F.col(value).alias("value")).repartition(*[f"by_{k}" for k in key]).write.partitionBy(*[f"by_{k}" for k in key]).option("lineSep", "\n").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, in as many files as rows has partitions; Spark writes no byte order mark (see `csv_documents`)."""
    rows.write.option("header", True).csv(path)
