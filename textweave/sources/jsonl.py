"""Corpus records from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.plans.options import BuildOptions

STRINGS = ("doc_id", "text", "organization_id", "external_id", "source_path", "source_name")


def parse_lines(lines: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """``value`` to records with ``is_normalized``.

    Lines that are empty, longer than the cap, not JSON, or whose doc_id or text is missing, empty or not a
    string are dropped; other fields that aren't strings are empty. The flag is ``text_is_normalized``,
    else ``normalized``, else true unless strict; one that is there but not a boolean is true.
    """
    sized = lines.filter(F.octet_length("value").between(1, options.max_line_bytes)).withColumn("_j", F.try_parse_json("value"))
    sized = sized.filter("_j IS NOT NULL")

    def string(name: str):
        v = F.try_variant_get("_j", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("_j", f"$.{name}", "string"))

    def flag(name: str):
        v = F.try_variant_get("_j", f"$.{name}", "variant")
        return F.when(v.isNotNull(), F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get("_j", f"$.{name}", "boolean")).otherwise(True))

    out = sized.select(*[string(c).alias(c) for c in STRINGS], F.coalesce(flag("text_is_normalized"), flag("normalized"), F.lit(not options.strict)).alias("is_normalized"))
    return out.filter("doc_id <> '' AND text <> ''").fillna("", list(STRINGS[2:]))


DOCIDS = ("doc_id", "organization_id", "external_id", "source_path", "source_name", "meta_path", "preview_text")


def parse_docids(listings: DataFrame) -> DataFrame:
    """``value``, the JSON list of a segment's documents, to a row for each: its place ``did``, and what is said of it.

    A list holds objects, or in the older form plain ids; the first element tells which. An element of
    another kind has no row, and the others keep their places. Missing fields are empty. Other columns stay.
    """
    others = [c for c in listings.columns if c != "value"]
    each = listings.select(*others, F.from_json("value", "array<variant>").alias("_l"))
    each = each.select(*others, (F.schema_of_variant(F.get("_l", F.lit(0))) == "STRING").alias("_old"), F.posexplode("_l").alias("_did", "_v"))

    def said(name: str):
        v = F.try_variant_get("_v", f"$.{name}", "variant")
        field = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))
        plain = F.when(F.schema_of_variant("_v") == "STRING", F.try_variant_get("_v", "$", "string")) if name == "doc_id" else F.lit("")
        return F.coalesce(F.when(F.col("_old"), plain).otherwise(field), F.lit(""))

    return each.select(*others, F.col("_did").cast("long").alias("did"), *[said(c).alias(c) for c in DOCIDS]).filter("doc_id <> ''")


def read_docids(spark: SparkSession, path: str) -> DataFrame:
    """The documents listed in a file."""
    return parse_docids(spark.read.text(path, wholetext=True))


def read_jsonl(spark: SparkSession, path: str, options: BuildOptions = BuildOptions()) -> DataFrame:
    return parse_lines(spark.read.text(path), options)
