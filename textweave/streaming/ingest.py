"""Continuous ingestion: each micro-batch of JSON lines becomes one immutable segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textweave.plans.options import BuildOptions
from textweave.sources.jsonl import parse_lines
from textweave.sources.segments import build_segment, load_manifest
from textweave.sources.storage import Store


def ingest_stream(spark: SparkSession, source: str, root: str, checkpoint: str, prefix: str = "stream", options: BuildOptions = BuildOptions(), **trigger) -> StreamingQuery:
    """The segment's name follows from the batch number, so a batch that is tried again isn't built twice; leftovers of a failed try are removed."""

    def build(batch: DataFrame, number: int) -> None:
        name = f"{prefix}_{number:010d}"
        if any(e["segment_name"] == name for e in load_manifest(spark, root)):
            return
        Store(spark).delete(f"{root}/{name}")
        records = parse_lines(batch, options).persist()
        try:
            if records.limit(1).count():
                build_segment(spark, records, root, name, options)
        except ValueError as e:
            if "no valid documents" not in str(e):
                raise
        finally:
            records.unpersist()

    return spark.readStream.text(source).writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
