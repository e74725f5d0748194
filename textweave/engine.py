"""The service's operations, for organisations under one root folder.

``<root>/<org>/index`` holds the segments, ``catalog`` the document rows (append-only versions),
``tombstones`` the deleted ids, ``uploads`` the stored originals.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.text import normalize, utf8_prefix
from textweave.operators import catalog as K
from textweave.operators.search import hits_json, search
from textweave.plans.options import BuildOptions, SearchOptions
from textweave.sources import archive as A
from textweave.sources import segments as G
from textweave.sources.storage import Store

ISO = "%Y-%m-%dT%H:%M:%SZ"
MAX_QUERY_BYTES = 256 << 10
MAX_ARCHIVE_BYTES = 512 << 20
#: Skipped files that an answer names; it tells the number of all.
TOLD = 1000


class Engine:
    def __init__(self, spark: SparkSession, root: str, converter: Sequence[str] | None = None):
        """``converter``: a command for .doc files, as ``sources.archive.converted`` takes it."""
        self.spark, self.root, self.store, self.converter = spark, root.rstrip("/"), Store(spark), converter

    def _org(self, org: str, part: str = "") -> str:
        return f"{self.root}/{G.checked_name(org)}" + (f"/{part}" if part else "")

    def _table(self, org: str, name: str, schema: str) -> DataFrame:
        path = self._org(org, name)
        return self.spark.read.schema(schema).parquet(path) if self.store.exists(path) else self.spark.createDataFrame([], schema)

    def catalog(self, org: str) -> DataFrame:
        return K.latest(self._table(org, "catalog", K.SCHEMA))

    def _put(self, org: str, rows: DataFrame) -> None:
        K.rows(rows).withColumn("version", F.lit(time.time_ns())).write.mode("append").parquet(self._org(org, "catalog"))

    # ---- ingestion

    def ingest_zip(self, org: str, path: str, normalized: bool = True, segment: str | None = None, options: BuildOptions = BuildOptions()) -> dict:
        """Read archives, store originals and catalog rows, build one segment. ``normalized``: index texts as they are."""
        if self.store.size(path) > MAX_ARCHIVE_BYTES:
            raise ValueError(f"more than {MAX_ARCHIVE_BYTES} bytes uploaded")
        return self._ingest(org, A.read_zips(self.spark, path), normalized, segment, options)

    def ingest_files(self, org: str, path: str, normalized: bool = True, segment: str | None = None, options: BuildOptions = BuildOptions()) -> dict:
        return self._ingest(org, A.read_files(self.spark, path), normalized, segment, options)

    def _ingest(self, org: str, files: DataFrame, normalized: bool, segment: str | None, options: BuildOptions) -> dict:
        name = G.checked_name(segment or f"seg_{G.now()}_{uuid.uuid4().hex[:8]}")
        uploads, at = self._org(org, f"uploads/{uuid.uuid4().hex}"), G.now(ISO)
        # ids are drawn once and stored with the originals; everything later reads them from there
        files.filter(A.extension(F.col("path")).isin(*A.SUPPORTED)).withColumn("doc_id", F.expr("uuid()")).write.parquet(uploads)
        stored = self.spark.read.parquet(uploads)
        if not stored.limit(1).count():
            self.store.delete(uploads)
            raise ValueError("no supported files")
        texts = A.extract(stored, self.converter)
        named = texts.select("doc_id", F.col("path").alias("external_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_name"), "text", "preview", "skipped")
        rows = named.filter("skipped IS NULL").select(F.lit(org).alias("org_id"), "doc_id", "external_id", "source_path", "source_name", F.lit(uploads).alias("stored_path"), "preview", F.lit(at).alias("created_at_utc"))
        self._put(org, rows)
        records = named.filter("skipped IS NULL AND text <> ''").withColumns({"organization_id": F.lit(org), "is_normalized": F.lit(normalized)})
        entry = G.build_segment(self.spark, records, self._org(org, "index"), name, options)
        self._put(org, K.update_last_segment(self.catalog(org), org, rows.select("doc_id"), name))
        left_out = named.filter("skipped IS NOT NULL").select("external_id", "skipped")
        told = [r.asDict() for r in left_out.orderBy("external_id").limit(TOLD).collect()]
        return {**entry, "ingested": rows.count(), "skipped": told, "skipped_total": left_out.count() if len(told) == TOLD else len(told)}

    # ---- search and deletes

    def search(self, org: str, queries: DataFrame | str, options: SearchOptions = SearchOptions(), normalized: bool = True) -> DataFrame | None:
        """Hits of a (qid, text) table or of one text; None if no segment is there. ``normalized``: queries are taken as they are."""
        if isinstance(queries, str):
            if not queries or len(queries.encode()) > MAX_QUERY_BYTES:
                raise ValueError("query is empty or too long")
            queries = self.spark.createDataFrame([(0, queries)], "qid long, text string")
        index = G.open_index(self.spark, self._org(org, "index"))
        if index is None:
            return None
        postings, docs, order, _ = index
        return search(postings, docs, queries, options, normalized, order, self._table(org, "tombstones", "doc_id string"))

    def search_json(self, org: str, query: str, options: SearchOptions = SearchOptions(), normalized: bool = True) -> str:
        hits = self.search(org, query, options, normalized)
        row = hits_json(hits).first() if hits is not None else None
        index = G.open_index(self.spark, self._org(org, "index"))
        return f'{{"segments_scanned":{index[3] if index else 0},"hits":{row["result"] if row else "[]"}}}'

    def delete_doc(self, org: str, key: str) -> dict:
        """Every row whose document or external id is ``key`` is marked and gets a tombstone, so none of them can be found any more. Unknown keys are no error."""
        current = self.catalog(org)
        named = K.mark_deleted(current.filter("deleted = 0"), org, key, G.now(ISO))
        ids = named.select("doc_id")
        if ids.limit(1).count():
            ids.write.mode("append").parquet(self._org(org, "tombstones"))
            self._put(org, K.mark_deleted(current.filter("deleted = 0"), org, key, G.now(ISO)))
        return {"ok": True}

    def list_docs(self, org: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return K.list_docs(self.catalog(org), org, limit, offset)

    # ---- looking inside

    def index_view(self, org: str, key: str, max_preview: int = 2000) -> dict:
        """A document's catalog row, its index row and its segment's entry. KeyError: unknown; LookupError: not indexed."""
        row = K.lookup(self.catalog(org), org, key).first()
        if row is None:
            raise KeyError(key)
        entries = {e["segment_name"]: e for e in G.load_manifest(self.spark, self._org(org, "index"))}
        entry = entries.get(row["last_segment"])
        if entry is None:
            raise LookupError(f"{key} isn't indexed")
        docs = self.spark.read.parquet(f"{self._org(org, 'index')}/{row['last_segment']}/docs")
        most = min(200_000, max(200, max_preview))
        found = docs.filter(F.col("doc_id") == row["doc_id"]).orderBy("did").limit(1).first()
        preview = self.document_text(org, key, max_bytes=most)["text"]
        return {"catalog": row.asDict(), "index": {**found.asDict(), "preview_text": preview} if found else None, "segment": entry}

    def document_meta(self, org: str, segment: str, did: int) -> dict | None:
        """The index row of a document by its number in a segment."""
        docs = self.spark.read.parquet(f"{self._org(org, 'index')}/{G.checked_name(segment)}/docs")
        found = docs.filter(F.col("did") == did).first()
        return found.asDict() if found else None

    def document_text(self, org: str, key: str, normalized: bool = False, max_bytes: int = 8 << 20) -> dict:
        """The stored original's text, read again; ``truncated`` if it was cut to ``max_bytes`` (64 MiB at most)."""
        row = K.lookup(self.catalog(org), org, key).first()
        if row is None:
            raise KeyError(key)
        most = min(max(1, max_bytes), 64 << 20)
        one = A.extract(self.spark.read.parquet(row["stored_path"]).filter(F.col("doc_id") == row["doc_id"]), self.converter)
        text = normalize(F.col("text")) if normalized else F.col("text")
        told = one.select(utf8_prefix(text, most).alias("text"), (F.octet_length(text) > most).alias("truncated")).first()
        return told.asDict()

    def validate(self, org: str) -> dict:
        return G.validate_root(self.spark, self._org(org, "index"))

    def wipe_org(self, org: str, confirm: str) -> bool:
        if confirm != "WIPE_ORG":
            raise ValueError("not confirmed")
        return self.store.delete(self._org(org))

    def wipe_all(self, confirm: str) -> list[str]:
        if confirm != "WIPE_ALL":
            raise ValueError("not confirmed")
        gone = [n for n in self.store.names(self.root) if G.NAME.fullmatch(n)]
        for n in gone:
            self.store.delete(f"{self.root}/{n}")
        return gone


def options_from(request: dict) -> SearchOptions:
    """Search options by name, others ignored; wrong types are refused."""
    known = {k: request[k] for k in SearchOptions.__dataclass_fields__ if k in request}
    for k, v in known.items():
        if isinstance(v, bool) or not isinstance(v, int | float if k == "alpha" else int) or (k != "alpha" and v < 0):
            raise ValueError(f"{k} has a wrong type")
    return replace(SearchOptions(), **known)
