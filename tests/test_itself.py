import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweave.functions import text as T
from textweave.operators import index as I
from textweave.operators import itself
from textweave.operators import search as S
from textweave.plans.options import SearchOptions

TIGHT = SearchOptions(topk=2, candidates_topn=3, min_hits=3, max_postings_per_hash=6, span_min_len=2, span_gap=2, max_spans_per_doc=2)


def told(hits):
    return sorted((r.qid, r["rank"], r.doc_id, r.matched_shingles, r.q_total, r.d_total, round(r.C, 9), [tuple(s) for s in r.match_spans]) for r in hits.collect())


@pytest.mark.parametrize("options", [TIGHT, replace(TIGHT, span_gap=0, span_min_len=1, min_hits=1, max_postings_per_hash=3, topk=9, candidates_topn=9, max_spans_per_doc=9)])
def test_an_index_searched_with_itself_equals_the_general_search(spark, options, monkeypatch):
    """Copies, common and repeated passages, also within a text, and texts in many parts and buckets."""
    monkeypatch.setattr(itself, "BUCKET_BYTES", 1000)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(9, 25))] for _ in range(5)]

    def text():
        return [w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(shared) if rng.random() < 0.5 else [rng.choice(words) for _ in range(12)])]

    texts = [text() for _ in range(30)]
    texts += [texts[0], texts[1], texts[2] + texts[2], ["a"] * 40, ["a"] * 12, ["b", "c"] * 20, ["too", "short"], [], shared[0] + texts[3]]
    ids = [rng.randrange(-(1 << 62), 1 << 62) if i % 7 == 0 else 3 * i for i in range(len(texts))]
    rows = spark.createDataFrame([(i, f"d{i}", " ".join(t), False) for i, t in zip(ids, texts, strict=True)], "did long, doc_id string, text string, is_normalized boolean")
    records = rows.withColumns({c: F.lit("") for c in ("organization_id", "external_id", "source_path", "source_name")})
    read = I.tokenized(records)
    docs = I.documents(read.filter(F.size("toks") >= T.SHINGLE), F.lit("all"), simhash=False)
    want = told(S.search(I.postings(read, F.lit("all")), docs, rows.select(F.col("did").alias("qid"), "text"), options))
    assert told(itself.search_itself(records, options)) == want and len(want) > 40


def test_places_of_a_common_hash_are_told_without_it():
    import pyarrow as pa

    keys = [np.zeros(50, np.int64), np.arange(20), np.zeros(30, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 1 << 60, -7], pa.int64()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64()))], ["did", "keys"])
    packed = pa.Table.from_batches(itself._packed(3, 4)(iter([batch])))
    assert sum(len(h.as_py()) // 8 for h in packed["h"]) == 5 + 12
    found = {(r["a"], r["pa"]) for b in set(packed["bucket"].to_pylist()) for r in itself._pairs(4)(packed.filter(pa.compute.equal(packed["bucket"], b))).to_pylist() if r["a"] == r["b"] and r["pa"] == r["pb"]}
    assert found == {(5, p) for p in range(42)} | {(-7, p) for p in range(22)}
