"""An index searched with its own texts, where only rare shingles count.

Most shingles of a corpus stand in one text only and tell nothing but that the text equals itself, so they
travel once, packed, to be found rare, common or alone, and only pairs of places go on. A text's diagonal
with itself is told by the places that are left out of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.portable import shingle_hashes
from textweave.functions.text import SHINGLE, words
from textweave.operators import search as S
from textweave.operators.index import spread, tasks
from textweave.plans.options import SearchOptions

#: Bytes of text whose shingles one task holds, some 16 bytes of keys for 6 of text.
BUCKET_BYTES = 8 << 20
#: Shingles that are packed at once.
PACKED = 1 << 19
#: Postings of a hash up to which all pairs of its places are made.
RARE = 16
POINTS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int32()), ("pb", pa.int32()), ("fa", pa.int8()), ("fb", pa.int8())])


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, after a byte that tells how many those are."""
    low, high = x.min(initial=0), x.max(initial=0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([kind().itemsize]) + x.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64)


def _packed(buckets: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token hashes of texts to a row a bucket: hashes, places, and the runs of texts. Places of a hash beyond ``most`` + 1 go without it."""

    def pack(bucket: int, h: np.ndarray, did: np.ndarray, pos: np.ndarray) -> tuple:
        new = np.flatnonzero(np.concatenate(([True], did[1:] != did[:-1])))
        steps = np.diff(did[new])  # wraps, and so does their sum
        return bucket, h.tobytes(), did[:1].tobytes() + _narrow(steps), _narrow(np.diff(new, append=len(did))), _narrow(pos)

    def parts(did: np.ndarray, n: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        each = np.maximum(n - SHINGLE + 1, 0)
        row = np.repeat(np.arange(len(n)), each)
        if not len(row):
            return
        pos = np.arange(len(row)) - (np.cumsum(each) - each)[row]
        h = shingle_hashes(hashes, (np.cumsum(n) - n)[row] + pos)
        of = did[row]
        order = np.argsort(h, kind="stable")
        by = h[order]
        again = np.zeros(len(h), bool)  # the most + 1 before it are equal
        again[order[most + 1 :]] = by[most + 1 :] == by[: -most - 1]
        kept = np.flatnonzero(~again)
        kept = kept[np.argsort(h[kept] % np.uint64(buckets), kind="stable")]
        to = (h[kept] % np.uint64(buckets)).astype(np.int64)
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = [pack(b, h[k], of[k], pos[k]) for b in range(buckets) if len(k := kept[cuts[b] : cuts[b + 1]])]
        if again.any():
            rows.append(pack(int(of[0]) % buckets, h[:0], of[again], pos[again]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "h", "did", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column(0).to_numpy(zero_copy_only=False)
            n = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(n)
            low = 0
            while low < len(n):
                base = ends[low] - n[low]
                high = max(low + 1, int(np.searchsorted(ends, base + PACKED, "right")))
                yield from parts(did[low:high], n[low:high], hashes[base : ends[high - 1]])
                low = high

    return run


def _pairs(most: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's rows to pairs of places (a <= b) under hashes of at most ``most`` postings; a place left out is paired with itself.

    fa and fb tell the first place of the hash in a and in b.
    """

    def run(table: pa.Table) -> pa.Table:
        hs, dids, places = [], [], []
        out: list[tuple[np.ndarray, ...]] = []
        for h, did, n, pos in zip(*(table.column(c).to_pylist() for c in ("h", "did", "n", "pos")), strict=True):
            did = np.repeat(np.cumsum(np.concatenate((np.frombuffer(did, np.int64, 1), _wide(did[8:])))), _wide(n))
            pos = _wide(pos).astype(np.int32)
            if not h:
                zero = np.zeros(len(did), np.int8)
                out.append((did, did, pos, pos, zero, zero))
            else:
                hs.append(np.frombuffer(h, np.uint64)), dids.append(did), places.append(pos)
        if hs:
            h, did, pos = np.concatenate(hs), np.concatenate(dids), np.concatenate(places)
            order = np.lexsort((pos, did, h))
            h, did, pos = h[order], did[order], pos[order]
            fresh = np.concatenate(([True], h[1:] != h[:-1]))
            group = np.cumsum(fresh) - 1
            df = np.bincount(group)[group]
            first = (fresh | np.concatenate(([True], did[1:] != did[:-1]))).astype(np.int8)
            gone = df > most
            zero = np.zeros(int(gone.sum()), np.int8)
            out.append((did[gone], did[gone], pos[gone], pos[gone], zero, zero))
            some = (df > 1) & ~gone
            h, did, pos, first, group = h[some], did[some], pos[some], first[some], group[some]
            for k in range(1, most):
                i = np.flatnonzero(group[k:] == group[:-k])
                if not len(i):
                    break
                out.append((did[i], did[i + k], pos[i], pos[i + k], first[i], first[i + k]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 6
        order = np.lexsort((columns[2], columns[1], columns[0]))  # near rows pack better
        columns = [c[order] for c in columns]
        return pa.Table.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, POINTS, strict=True)], schema=POINTS)

    return run


def runs(rows: DataFrame, buckets: int, options: SearchOptions) -> DataFrame:
    """(a, b, delta, q_from, q_to, ha, hb) of texts (did, keys): islands on the diagonals of each pair a <= b, with the
    hits that they hold either way. Where a is b, delta 0 has the places left out, in blocks without gaps."""
    packed = rows.mapInArrow(_packed(buckets, options.max_postings_per_hash), "bucket int, h binary, did binary, n binary, pos binary")
    schema = "a long, b long, pa int, pb int, fa byte, fb byte"
    points = packed.repartition(min(buckets, 4096), "bucket").groupBy("bucket").applyInArrow(_pairs(options.max_postings_per_hash), schema)
    points = points.withColumn("delta", F.col("pb") - F.col("pa")).drop("pb").repartition(tasks(rows.sparkSession), "a", "b")
    line = Window.partitionBy("a", "b", "delta").orderBy("pa")
    gap = F.when((F.col("a") == F.col("b")) & (F.col("delta") == 0), 1).otherwise(1 + options.span_gap)
    fresh = F.coalesce((F.col("pa") - F.lag("pa").over(line) > gap).cast("int"), F.lit(1))
    islands = points.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.min("pa").alias("q_from"), F.max("pa").alias("q_to"), F.sum("fa").alias("ha"), F.sum("fb").alias("hb")
    return islands.groupBy("a", "b", "delta", "island").agg(*ends).drop("island")


def own_runs(left_out: DataFrame, lengths: DataFrame, options: SearchOptions) -> DataFrame:
    """(did, q_from, q_to): each text's runs with itself, between blocks of places left out that end a run."""
    ends = lengths.select("did", F.explode(F.array(F.lit(-1), F.col("n"))).alias("q_from")).withColumn("q_to", F.col("q_from"))
    blocks = left_out.join(lengths, "did").filter((F.col("q_to") - F.col("q_from") >= options.span_gap) | (F.col("q_from") == 0) | (F.col("q_to") == F.col("n") - 1))
    cut = ends.unionByName(blocks.select("did", "q_from", "q_to"))
    between = cut.select("did", (F.col("q_to") + 1).alias("q_from"), (F.lead("q_from").over(Window.partitionBy("did").orderBy("q_from", "q_to")) - 1).alias("q_to"))
    return between.filter(F.col("q_to") >= F.col("q_from"))


def search_itself(records: DataFrame, options: SearchOptions, segment: str = "all") -> DataFrame:
    """The hits of every record's text (did, doc_id, text) in the index of all of them, without caps on texts; did is unique."""
    if options.max_postings_per_hash > RARE:
        raise ValueError(f"pairs of places are made for hashes of at most {RARE} postings")
    records = spread(records.select("did", "doc_id", "text"))
    size = records.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    keyed = records.select("did", F.transform(words(F.col("text")), lambda t: F.xxhash64(t)).alias("keys"))
    found = runs(keyed, buckets, options).persist()
    docs = records.select("did", "doc_id", F.size(words(F.col("text"))).alias("tok_len")).persist()
    lengths = docs.select("did", S.doc_shingles(F.col("tok_len")).alias("n")).filter("n > 0")
    left_out = found.filter("a = b and delta = 0").select(F.col("a").alias("did"), "q_from", "q_to")
    gone = left_out.groupBy("did").agg(F.sum(F.col("q_to") - F.col("q_from") + 1).alias("_gone"))
    own_hits = lengths.join(gone, "did", "left").select(F.col("did").alias("qid"), "did", (F.col("n") - F.coalesce("_gone", F.lit(0))).alias("hits"))
    sides = F.array(F.struct(F.col("a").alias("qid"), F.col("b").alias("did"), F.col("ha").alias("hits")), F.struct(F.col("b").alias("qid"), F.col("a").alias("did"), F.col("hb").alias("hits")))
    hits = found.filter("a <> b").groupBy("a", "b").agg(F.sum("ha").alias("ha"), F.sum("hb").alias("hb")).select(F.inline(sides))
    hits = hits.unionByName(own_hits).withColumn("segment", F.lit(segment))
    chosen = S.listed(S.candidates(hits, options).select("qid", "segment", "did"))
    long = found.filter((F.col("q_to") - F.col("q_from") + 1 >= options.span_min_len) & ~((F.col("a") == F.col("b")) & (F.col("delta") == 0)))
    there = F.struct(F.col("a").alias("qid"), F.col("b").alias("did"), "delta", "q_from", "q_to")
    back = F.struct(F.col("b").alias("qid"), F.col("a").alias("did"), (-F.col("delta")).alias("delta"), (F.col("q_from") + F.col("delta")).alias("q_from"), (F.col("q_to") + F.col("delta")).alias("q_to"))
    own = own_runs(left_out, lengths, options).select(F.col("did").alias("qid"), "did", F.lit(0).alias("delta"), "q_from", "q_to")
    spans = long.select(F.inline(F.array(there, back))).unionByName(own).withColumn("segment", F.lit(segment))
    spans = spans.withColumns({"length": F.col("q_to") - F.col("q_from") + 1, "d_from": F.col("q_from") + F.col("delta"), "d_to": F.col("q_to") + F.col("delta")})
    spans = spans.filter(F.col("length") >= options.span_min_len).join(chosen, ["qid", "segment", "did"], "left_semi")
    totals = lengths.select(F.col("did").alias("qid"), F.col("n").cast("long").alias("q_total"))
    scored = S.scores(S.top_spans(spans, options), totals, docs.withColumn("segment", F.lit(segment)), options)
    return S.top_hits(scored, options)
