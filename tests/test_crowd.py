import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textweave.functions import text as T
from textweave.operators import crowd
from textweave.operators import index as I
from textweave.operators import search as S
from textweave.plans.options import SearchOptions
from textweave.plans.queries import QUERIES

DUPS = SearchOptions(topk=5)
LOW = SearchOptions(topk=4, candidates_topn=5, min_hits=3, max_postings_per_hash=25, span_min_len=3, span_gap=2, max_spans_per_doc=3)


def told(hits):
    return sorted((r.qid, r["rank"], r.doc_id, r.matched_shingles, r.q_total, r.d_total, round(r.C, 9), round(r.Cq, 9), round(r.Cd, 9)) for r in hits.collect())


def corpus(seed):
    """Copies, a line that most texts hold, once or twice, common and cut passages, and texts of a few words again and again."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    line = [f"l{i}" for i in range(13)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(9, 40))] for _ in range(6)]

    def part():
        kind = rng.random()
        if kind < 0.3:
            return line
        if kind < 0.7:
            passage = rng.choice(shared)
            low = rng.randrange(0, 6)
            return passage[low:] if rng.random() < 0.7 else [w if rng.random() < 0.95 else "x" for w in passage]
        return [rng.choice(words) for _ in range(12)]

    texts = [[w for _ in range(rng.randrange(1, 6)) for w in part()] for _ in range(60)]
    texts += [texts[0]] * 8 + [texts[1], texts[2] + texts[2], ["a"] * 60, ["a"] * 14, ["a"] * 60, ["b", "c"] * 30, ["too", "short"], [], shared[0] + texts[3], ["only"] + [f"o{i}" for i in range(20)]]
    return [(rng.randrange(-(1 << 62), 1 << 62) if i % 7 == 0 else 3 * i, f"d{i}", " ".join(t), False) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options, points", [(DUPS, 1 << 20), (replace(DUPS, candidates_topn=7, max_postings_per_hash=12), 40), (LOW, 1 << 20), (replace(LOW, span_gap=0, span_min_len=1, min_hits=1, max_postings_per_hash=60, candidates_topn=9), 30)])
def test_crowds_of_texts_equal_the_general_search(spark, options, points, monkeypatch):
    monkeypatch.setattr(crowd, "BUCKET_BYTES", 3000)
    rows = spark.createDataFrame(corpus(5), "did long, doc_id string, text string, is_normalized boolean")
    records = rows.withColumns({c: F.lit("") for c in ("organization_id", "external_id", "source_path", "source_name")})
    read = I.tokenized(records)
    docs = I.documents(read.filter(F.size("toks") >= T.SHINGLE), F.lit("all"), simhash=False)
    want = told(S.search(I.postings(read, F.lit("all")), docs, rows.select(F.col("did").alias("qid"), "text"), options))
    got = told(crowd.search_crowd(records, options, points=points))
    assert got == want and len(want) > 90


def test_texts_with_one_line_in_common_make_no_pairs(spark, tmp_path, monkeypatch):
    """Their number used to be squared; now a line too short for a span finds nobody."""
    line = " ".join(f"l{i}" for i in range(13))
    spark.range(1500).selectExpr("id as doc_id", f"concat('{line} ', array_join(transform(sequence(1, 20), i -> concat('own', id, 'x', i)), ' ')) as text", "'en' as lang", "'s' as source", "cast(1 as bigint) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    least = []
    general = S.candidate_hits
    monkeypatch.setattr(S, "candidate_hits", lambda *a: least.append(1) or general(*a))
    out = QUERIES["corpus_self_dups"](spark, str(tmp_path)).collect()
    assert not least
    assert sorted((r.qid, int(r.doc_id), r["rank"], r.matched_shingles, r.c) for r in out) == [(i, i, 1, 25, 100.0) for i in range(1500)]
