"""Segments in the portable binary layout, for exchange with other programs.

Little-endian: a header of four magic bytes (given by the caller), version u32, documents u32, postings u64
and a reserved u64; for each document tok_len u32, simhash high and low u64; then postings hash u64, document
u32, position u32, in unsigned order. One file is made and read in one task: it is a format of single files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.text import unsigned_order
from textweave.sources.storage import Store

HEADER = "<4sIIQQ"
HEADER_BYTES = struct.calcsize(HEADER)
VERSION = 2
DOC = np.dtype([("tok_len", "<u4"), ("simhash_hi", "<u8"), ("simhash_lo", "<u8")])
POSTING = np.dtype([("h", "<u8"), ("did", "<u4"), ("pos", "<u4")])


def read_header(data: bytes, magic: bytes) -> tuple[int, int]:
    """(documents, postings); ValueError if this isn't such a file."""
    if len(data) < HEADER_BYTES:
        raise ValueError("file too short for a header")
    found, version, docs, postings, _ = struct.unpack_from(HEADER, data)
    if found != magic or version != VERSION:
        raise ValueError("bad magic or version")
    if len(data) < HEADER_BYTES + docs * DOC.itemsize + postings * POSTING.itemsize:
        raise ValueError("file shorter than its header says")
    return docs, postings


def encode(docs: pd.DataFrame, postings: pd.DataFrame, magic: bytes) -> bytes:
    """Documents in order of ``did``; postings in any order."""
    d, p = np.zeros(len(docs), DOC), np.zeros(len(postings), POSTING)
    docs = docs.sort_values("did")
    for c in DOC.names:
        d[c] = docs[c].to_numpy().astype(np.int64).view(np.uint64)
    p["h"], p["did"], p["pos"] = postings["h"].to_numpy(np.int64).view(np.uint64), postings["did"], postings["pos"]
    return struct.pack(HEADER, magic, VERSION, len(d), len(p), 0) + d.tobytes() + np.sort(p, order=["h", "did", "pos"]).tobytes()


def export_segment(spark: SparkSession, root: str, name: str, path: str, magic: bytes) -> None:
    """Write one stored segment, built with exact hashes, as a single file. Postings are streamed sorted, a partition at a time."""
    docs = spark.read.parquet(f"{root}/{name}/docs").select("did", *DOC.names).orderBy("did")
    postings = spark.read.parquet(f"{root}/{name}/postings").select("h", "did", "pos").orderBy(unsigned_order(F.col("h")), "did", "pos")
    fs, p = Store(spark)._at(path)
    out = fs.create(p, True)
    out.write(bytearray(struct.pack(HEADER, magic, VERSION, docs.count(), postings.count(), 0)))
    for df, kind in ((docs, DOC), (postings, POSTING)):
        rows: list[tuple] = []
        for r in df.toLocalIterator():
            rows.append(tuple(int(r[c]) & (2**64 - 1) for c in kind.names))
            if len(rows) == 65_536:
                out.write(bytearray(np.array(rows, kind).tobytes()))
                rows = []
        out.write(bytearray(np.array(rows, kind).tobytes()))
    out.close()


def import_segment(spark: SparkSession, path: str, magic: bytes, segment: str) -> tuple[DataFrame, DataFrame]:
    """(postings, docs) of a binary file."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data in (bytes(x) for b in batches for x in b["content"]):
            n, _ = read_header(data, magic)
            d = np.frombuffer(data, DOC, n, HEADER_BYTES)
            yield pd.DataFrame({"segment": segment, "did": np.arange(n), "tok_len": d["tok_len"].astype(np.int32), "simhash_hi": d["simhash_hi"].astype(np.uint64).view(np.int64) if n else [], "simhash_lo": d["simhash_lo"].astype(np.uint64).view(np.int64) if n else []})

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data in (bytes(x) for b in batches for x in b["content"]):
            n, m = read_header(data, magic)
            at = HEADER_BYTES + n * DOC.itemsize
            for start in range(0, m, 1 << 20):
                p = np.frombuffer(data, POSTING, min(1 << 20, m - start), at + start * POSTING.itemsize)
                yield pd.DataFrame({"segment": segment, "h": p["h"].astype(np.uint64).view(np.int64), "did": p["did"].astype(np.int64), "pos": p["pos"].astype(np.int32)})

    return files.mapInPandas(postings, "segment string, h bigint, did bigint, pos int"), files.mapInPandas(docs, "segment string, did bigint, tok_len int, simhash_hi bigint, simhash_lo bigint")
