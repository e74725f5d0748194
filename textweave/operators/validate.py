"""Integrity checks of one segment or of a whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.text import SHINGLE, unsigned_order

MESSAGES = {
    "did_out_of_range": "posting with a document number out of range",
    "tok_len_too_small": "document with fewer than nine tokens",
    "pos_out_of_range": "posting at a position out of range",
}


def violation_counts(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(violation, n). Shingles of a document share its row, so postings meet documents in one join."""
    known = docs.select("segment", "did", "tok_len")
    joined = postings.select("segment", "did", "pos").join(known, ["segment", "did"], "left")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    of_postings = joined.agg(one(F.col("tok_len").isNull()).alias("did_out_of_range"), one(F.col("pos") > F.col("tok_len") - SHINGLE).alias("pos_out_of_range"))
    of_docs = known.agg(one(F.col("tok_len") < SHINGLE).alias("tok_len_too_small"))
    unpivot = lambda df: df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("violation", "n"))
    return unpivot(of_postings).unionByName(unpivot(of_docs))


def unsorted_rows(stored: DataFrame) -> int:
    """Rows of a stored postings table that precede, in their file, a row they should follow, and files whose range reaches into that of another."""
    placed = stored.select(F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_n"), unsigned_order(F.col("h")).alias("_h"), "did", "pos")
    order = F.struct("_h", "did", "pos")
    within = placed.withColumn("_prev", F.lag(order).over(Window.partitionBy("_f").orderBy("_n"))).filter(F.col("_prev") > order).count()
    files = placed.groupBy("_f").agg(F.min(order).alias("low"), F.max(order).alias("high"))  # one row a file
    before = F.max("high").over(Window.orderBy("low", "_f").rowsBetween(Window.unboundedPreceding, -1))
    return within + files.withColumn("_before", before).filter(F.col("_before") > F.col("low")).count()
