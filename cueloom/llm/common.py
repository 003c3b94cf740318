"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: White space as the contracts define it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of lower-cased text, and of text as it is.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name, whatever marks the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def hashed(column: str, kind: DataType, seed: int = 0) -> Column:
    """A hash of a column of any type; maps, which Spark doesn't hash, count by their entries in the order of keys' text."""
    return F.xxhash64(F.lit(seed), _without_maps(named(column), kind))


def _without_maps(value: Column, kind: DataType) -> Column:
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(F.to_json(F.struct(e["key"])).alias("o"), _without_maps(e["key"], kind.keyType).alias("k"), _without_maps(e["value"], kind.valueType).alias("v"))
        return F.array_sort(F.transform(F.map_entries(value), entry), lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: _without_maps(v, kind.elementType)) if _has_map(kind) else value
    if isinstance(kind, StructType) and _has_map(kind):
        return F.struct(*[_without_maps(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind)], value.isNull().alias("none"))
    if isinstance(kind, VariantType):
        return F.to_json(value)
    return value


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return any(_has_map(f.dataType) for f in kind) if isinstance(kind, StructType) else isinstance(kind, MapType | VariantType)


def row_key(df: DataFrame) -> list[Column]:
    """k1 and k2: two hashes of all columns of a row, of any type; rows that agree in both are taken to be equal."""
    return [F.xxhash64(*[hashed(f.name, f.dataType, seed) for f in df.schema], F.lit(seed)).alias(f"k{seed}") for seed in (1, 2)]


#: No more than so many keys can each hold over so many parts of all rows.
HOT_KEYS = 1000


def with_key_of(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with keyed by key; keyed has a row for each key, with n, how many of the total rows have it.

    Keys that hold more than a thousandth of the rows go by a broadcast, which has HOT_KEYS rows at most; the others are shuffled."""
    key = [key] if isinstance(key, str) else key
    is_hot = F.col(n) * HOT_KEYS > F.lit(total)
    hot, seldom = keyed.where(is_hot), keyed.where(~is_hot)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(seldom, key)).drop(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Where none is set, a new one, if all run on this machine; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cueloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a short lineage that lost executors can't break."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row however often body names it, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, space: str = SPACE) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), space, -1), lambda w: w != "")
