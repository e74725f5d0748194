"""The document catalog: append-only version rows, of which a key's latest holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRINGS = ("org_id", "doc_id", "external_id", "source_path", "source_name", "stored_path", "preview", "created_at_utc", "deleted_at_utc", "last_segment")
COLUMNS = (*STRINGS, "deleted", "version")
SCHEMA = ", ".join(f"{c} string" for c in STRINGS) + ", deleted int, version long"


def rows(df: DataFrame) -> DataFrame:
    """``df`` with all catalog columns; missing ones are empty, not deleted, version 0."""
    zero = {"deleted": F.lit(0), "version": F.lit(0).cast("long")}
    return df.select(*[F.col(c) if c in df.columns else zero.get(c, F.lit("")).alias(c) for c in COLUMNS])


def latest(versions: DataFrame) -> DataFrame:
    newest = Window.partitionBy("org_id", "doc_id").orderBy(F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r")


def upsert(versions: DataFrame, changed: DataFrame, version: int) -> DataFrame:
    """Every column of a key is replaced by that of ``changed``."""
    return versions.unionByName(rows(changed).withColumn("version", F.lit(version).cast("long")))


def mark_deleted(current: DataFrame, org: str, key: str, at: str) -> DataFrame:
    """The rows whose document or external id is ``key``, as deleted."""
    named = current.filter((F.col("org_id") == org) & ((F.col("doc_id") == key) | (F.col("external_id") == key)))
    return named.withColumns({"deleted": F.lit(1), "deleted_at_utc": F.lit(at)})


def update_last_segment(current: DataFrame, org: str, ids: DataFrame, segment: str) -> DataFrame:
    return current.filter(F.col("org_id") == org).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("last_segment", F.lit(segment))


def list_docs(current: DataFrame, org: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, newest first, deleted rows included; limit 1 to 1000."""
    return current.filter(F.col("org_id") == org).orderBy(F.desc("created_at_utc"), "doc_id").offset(max(0, offset)).limit(min(1000, max(1, limit)))


def lookup(current: DataFrame, org: str, key: str) -> DataFrame:
    return current.filter((F.col("org_id") == org) & ((F.col("doc_id") == key) | (F.col("external_id") == key))).orderBy("doc_id").limit(1)
