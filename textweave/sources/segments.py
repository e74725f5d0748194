"""Stored segments: Parquet tables of documents and postings, and the manifest that lists them in order.

``<root>/<segment>/docs``, ``<root>/<segment>/postings`` (sorted by unsigned hash, document, position, so
row groups cover narrow hash ranges), ``<root>/<segment>/meta.json`` and ``<root>/manifest.json``. A segment
never changes; it counts once the manifest lists it.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.text import unsigned_order
from textweave.operators import index as I
from textweave.operators.validate import MESSAGES, unsorted_rows, violation_counts
from textweave.plans.options import BuildOptions
from textweave.sources.storage import Store

NAME = re.compile(r"[A-Za-z0-9._-]+")
POSTINGS = "segment string, h bigint, did bigint, pos int"


def checked_name(name: str) -> str:
    if not NAME.fullmatch(name) or name in (".", ".."):
        raise ValueError(f"not a usable name: {name!r}")
    return name


def now(pattern: str = "%Y%m%d_%H%M%S") -> str:
    return datetime.now(timezone.utc).strftime(pattern)


def load_manifest(spark: SparkSession, root: str) -> list[dict]:
    """Entries with a name and a path; a missing or broken manifest is empty."""
    entries = Store(spark).read_json(f"{root}/manifest.json").get("segments", [])
    return [e for e in entries if isinstance(e, dict) and e.get("segment_name") and e.get("path")] if isinstance(entries, list) else []


def append_manifest(spark: SparkSession, root: str, entry: dict) -> None:
    """Other keys of the manifest stay as they are. Writers take turns."""
    store = Store(spark)
    with store.locked(f"{root}/manifest.lock"):
        manifest = store.read_json(f"{root}/manifest.json")
        held = manifest.get("segments")
        manifest["segments"] = [*(held if isinstance(held, list) else []), entry]
        store.write(f"{root}/manifest.json", json.dumps(manifest))


def _numbered(spark: SparkSession, records: DataFrame, options: BuildOptions, staging: str) -> DataFrame:
    """Prepared documents with dense numbers in order of the document id.

    Records are dealt out by range of the id before anything is made of their texts, in as many
    partitions as there are tasks, whatever the number of input files. The prepared rows are written
    once with their partition and place, so numbers can't change when a task runs again; only one row
    count a partition is summed up in one place.
    """
    placed = I.prepare(records.repartitionByRange(I.tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text"), options)
    placed.drop("text").withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}).write.parquet(staging)
    stored = spark.read.parquet(staging)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    bases = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    place = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(bases), "_part").withColumn("did", F.col("_base") + place).drop("_part", "_n", "_base")


def build_segment(spark: SparkSession, records: DataFrame, root: str, name: str | None = None, options: BuildOptions = BuildOptions()) -> dict:
    """Build and list one segment from corpus records; the manifest's new entry."""
    name, store = checked_name(name or f"seg_{now()}"), Store(spark)
    path = f"{root}/{name}"
    if store.exists(path):
        raise ValueError(f"segment already exists: {name}")
    done = False
    try:
        numbered = _numbered(spark, records, options, f"{path}/_staging")
        if options.max_docs:
            numbered = numbered.filter(F.col("did") < options.max_docs)
        docs = I.documents(numbered, F.lit(name), options)
        docs.write.parquet(f"{path}/docs")
        n_docs = spark.read.parquet(f"{path}/docs").count()
        if not n_docs:
            raise ValueError("no valid documents")
        order = [unsigned_order(F.col("h")), F.col("did"), F.col("pos")]
        postings = I.postings(numbered, F.lit(name), options).repartitionByRange(I.tasks(spark), order[0]).sortWithinPartitions(*order)
        postings.write.parquet(f"{path}/postings")
        stats = {"docs": n_docs, "k9": spark.read.parquet(f"{path}/postings").count(), "k13": 0}
        entry = {"segment_name": name, "path": path, "built_at_utc": now(), "stats": stats}
        store.write(f"{path}/meta.json", json.dumps({**entry, "strict_text_is_normalized": int(options.strict), "exact_hashes": options.exact_hashes}))
        store.delete(f"{path}/_staging")
        append_manifest(spark, root, entry)
        done = True
        return entry
    finally:
        if not done:
            store.delete(path)


def open_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """(postings, docs, segment order, segments) over all listed segments that are there; None if there are none."""
    store = Store(spark)
    there = [(i, e["segment_name"]) for i, e in enumerate(load_manifest(spark, root)) if store.exists(f"{root}/{e['segment_name']}/docs/_SUCCESS") and store.exists(f"{root}/{e['segment_name']}/postings/_SUCCESS")]
    if not there:
        return None
    read = lambda kind: spark.read.parquet(*[f"{root}/{name}/{kind}" for _, name in there])
    order = spark.createDataFrame([(name, i) for i, name in there], "segment string, ord int")
    return read("postings"), read("docs"), order, len(there)


def validate_segment(spark: SparkSession, root: str, name: str, check_sorted: bool = True) -> list[str]:
    store, path, errors = Store(spark), f"{root}/{name}", []
    if not all(store.exists(f"{path}/{kind}/_SUCCESS") for kind in ("docs", "postings")):
        return [f"can't open segment {name}"]
    postings, docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
    listed = store.read_json(f"{path}/meta.json").get("stats", {}).get("docs")
    if listed is not None and listed != docs.count():
        errors.append(f"document count mismatch: {docs.count()} stored, {listed} listed")
    if check_sorted and unsorted_rows(postings):
        errors.append("postings are not sorted")
    errors += [MESSAGES[r["violation"]] for r in violation_counts(postings, docs).filter("n > 0").collect()]
    return errors


def validate_root(spark: SparkSession, root: str) -> dict:
    entries = load_manifest(spark, root)
    if not entries:
        return {"ok": False, "errors": ["manifest is empty"]}
    errors = [f"{e['segment_name']}: {x}" for e in entries for x in validate_segment(spark, root, e["segment_name"])]
    return {"ok": not errors, "errors": errors}
