"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The six ASCII blanks: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word as a Java regex: a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a list of ids or keys that are broadcast at most: 8 to 16 bytes each, some 16 MB.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one (a test) gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="textweave-")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the session's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def listed(ids: DataFrame) -> DataFrame:
    """``ids``, materialised, for one side of a join: a list of checked length is broadcast, a longer one is shuffled."""
    ids = materialise(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other than ASCII take a faster way to the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunk_count(rows: int, rows_per_chunk: int) -> int:
    return max(1, -(-rows // rows_per_chunk))


def running_total(df: DataFrame, by: list[str], key: Column, order: list[Column], value: Column, chunks: int, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group before this one.

    A group may hold most rows, so it is dealt over ``chunks`` parts by a hash of ``key``: each part is
    summed by itself, and the parts' sums, at most ``chunks`` a group, are summed in turn. No task needs
    a whole group. Group columns must not be null.
    """
    parts = df.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(17), key), F.lit(chunks)).cast("int")).withColumn("_value", value)
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by, "_chunk").agg(F.sum("_value").alias("_sum"))
    bases = sums.select(*by, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = parts.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return told.join(bases, [*by, "_chunk"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_chunk", "_value", "_base", "_within")
