"""Event sidecars as they arrive: each file is a whole slide, so a micro-batch is audited by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueloom.operators import gaps
from cueloom.sources import documents

KEY = ["deck_id", "slide_num"]
#: Where a sidecar lies: deck_id=7/slide_003.wordboundaries.json.
DECK, SLIDE = r"deck_id=([0-9]+)/", r"slide_([0-9]+)\.wordboundaries\.json$"


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """deck_id, slide_num and value of each new sidecar under path."""
    files = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).text(path)
    place = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(place, DECK, 1).try_cast("bigint").alias("deck_id"), F.regexp_extract(place, SLIDE, 1).try_cast("int").alias("slide_num"), "value").where("deck_id is not null and slide_num is not null")


def audit(sidecars: DataFrame, durations: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes, for each micro-batch, the self-consistency of its slides and the warnings of those that can't be read.

    A batch's folders carry its number and are written over, so a batch that is run again leaves the same rows."""

    def each(batch: DataFrame, number: int) -> None:
        gaps.self_consistency(documents.events(batch), durations, KEY).write.mode("overwrite").parquet(f"{out}/slides/batch={number}")
        documents.event_warnings(batch).write.mode("overwrite").parquet(f"{out}/warnings/batch={number}")

    return sidecars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
