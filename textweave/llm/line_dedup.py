"""Line-level deduplication across documents.

Lines are exploded and normalised, distinct documents are counted for each hash, lines over the threshold
are dropped and each document is put together again by line position. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import BLANKS, ascii_lower, listed
from textweave.llm.spans import let


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _without(lines: Column, lost: Column) -> Column:
    """``lines`` but those at the ascending places ``lost``: the slices between them, so that no line is looked for in a list."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(lost, i - 1) + 1)
    stop = lambda i: F.coalesce(F.get(lost, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(lost)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``, one row for each row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` distinct documents lose their lines everywhere but in the
    largest id that holds them; there all of them stay. Null or empty text is one empty line. Rows
    sharing an id count as one document and each stays a row. Rows with a null id keep their lines and
    don't count. An empty table gives an empty table. Other columns are passed through; one that is named
    like one of the three gives way to it.
    """
    text = F.col(text_col).cast("string")
    # a row is known by its id and its text's hash: rows that share both have the same lines, hence each place once
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(_lines(text)).alias("place", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= min_chars)
    lines = lines.withColumn("line", ascii_lower(F.col("line"))).select("id", "t", "place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    held = lines.select("id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    repeated = listed(held.filter(F.col("n") >= min_docs).select("a", "b", "last"))
    lost = lines.join(repeated, ["a", "b"]).filter("id < last").groupBy("id", "t").agg(F.array_sort(F.collect_set("place")).alias("lost"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t"))
    joined = rows.join(lost, ["id", "t"], "left")
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    kept = let(_lines(text), lambda own: F.array_join(_without(own, F.col("lost")), "\n"))
    made = joined.select(
        "row",
        F.when(F.col("lost").isNull(), text).otherwise(kept).alias("kept_text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return made.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in made.columns[1:]], *made.columns[1:])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document's lines before dropping, those dropped, and a digest of the rest; as ``dedup_lines``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, (r.key IS NOT NULL AND k.doc_id < r.last) AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
