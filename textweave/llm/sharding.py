"""Weighted rendezvous sharding by a stable record key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import chunk_count, running_total


def rendezvous(key: Column, weights: Sequence[float], seed: int = 20) -> Column:
    """The shard with the highest score for ``key``: weight / -ln(u), u a hash of key and shard in (0, 1).

    A shard's scores don't depend on the others, so a new shard takes rows only into itself and a lost one
    gives up only its own; each gets rows in proportion to its weight. Ties go to the higher shard number.
    A null key counts as one key of its own.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        # chained: one well-mixed hash of (seed, shard, key), its upper 52 bits taken as a fraction
        drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), F.xxhash64(key), key), 12)
        u = (drawn.cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key_col: str = "doc_id", seed: int = 20) -> DataFrame:
    """Add ``shard`` alone, in the place of a column of that name: rows stay where they are, nothing is shuffled."""
    return docs.withColumn("shard", rendezvous(F.col(key_col), weights, seed))


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key_col: str = "doc_id", seed: int = 20, rows_per_chunk: int = 50_000) -> DataFrame:
    """Add ``shard`` int, and ``slot`` long, the row's gapless place in its shard, in the place of columns of these names.

    Places follow a hash of the key and then the key; rows with the same key are in one shard, side by
    side, in no fixed order among equal rows. Nulls in other columns don't matter. Numbering deals each
    shard over chunks of about ``rows_per_chunk`` rows, so no task holds a whole shard.
    """
    dealt = docs.select(F.struct("*").alias("row"), F.col(key_col).alias("key"))
    chunks = chunk_count(docs.count(), rows_per_chunk * len(weights))
    told = running_total(assign(dealt, weights, "key", seed), ["shard"], F.col("key"), [F.col("key")], F.lit(1), chunks, "slot")
    return told.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder ``shard=N`` a shard, written in parallel by every task."""
    assign(docs, **options).write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Each document's size, checksum and shard of 8 by the law ``key``, its slot, and its shard of 9; as ``shard``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), (1.0,) * 9).alias("grown_shard")
    )
