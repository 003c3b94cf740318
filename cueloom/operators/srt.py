"""Subtitle files as tables of cues, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import ARROW, timestamp


def format_srt(cues: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """srt, one text for each key: cues numbered from 1, each with its times and text."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(timestamp(F.col("start_ms")), F.lit(" --> "), timestamp(F.col("end_ms"))), F.col("text"))
    blocks = cues.withColumn("n", n).select(*key, F.struct("n", block.alias("block")).alias("b"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n")
    return blocks.groupBy(*key).agg(F.concat(joined, F.lit("\n")).alias("srt"))


#: The times of a cue, all in one line. They begin and end with a time of WIDTH characters.
_TIMES, _WIDTH, _SPACES = ARROW.replace(r"\s", r"[\s&&[^\n]]"), 12, " \t\n\x0b\f\r"


def _milliseconds(time: Column) -> Column:
    digits = lambda at, n: F.substr(time, F.lit(at), F.lit(n)).cast("long")
    return digits(1, 2) * 3_600_000 + digits(4, 2) * 60_000 + digits(7, 2) * 1000 + digits(10, 3)


def parse_srt(files: DataFrame, key: list[str], text: str = "srt") -> DataFrame:
    """cue_idx, start_ms, end_ms and text of each block with times and a line of text; other blocks are passed over.

    A key has one text, whose blocks are numbered before they are rows. The times of each are looked for once."""
    whole = F.btrim(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(_SPACES))
    # No line of a block is blank.
    found = F.transform(F.split(whole, r"\n\s*\n", -1), lambda b: F.struct(b.alias("block"), F.regexp_extract(b, _TIMES, 0).alias("times")))
    timed = F.filter(found, lambda c: (c["times"] != "") & F.contains(c["block"], F.lit("\n")))
    cues = files.select(*key, F.posexplode(timed).alias("cue_idx", "c")).select(*key, "cue_idx", "c.times", F.substr("c.block", F.instr("c.block", F.col("c.times")) + F.length("c.times")).alias("rest"))
    end = F.instr("rest", "\n")
    body = F.when(end > 0, F.substr("rest", end + 1)).otherwise("")
    return cues.select(*key, "cue_idx", _milliseconds(F.left("times", F.lit(_WIDTH))).alias("start_ms"), _milliseconds(F.right("times", F.lit(_WIDTH))).alias("end_ms"), body.alias("text"))
