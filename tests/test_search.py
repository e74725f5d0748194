import random
from dataclasses import replace

import model
import pytest
from pyspark.sql import functions as F

from textweave.functions import text as T
from textweave.operators import index as I
from textweave.operators import search as S
from textweave.operators.validate import violation_counts
from textweave.plans.options import BuildOptions, SearchOptions

STRINGS = ("organization_id", "external_id", "source_path", "source_name")


def indexed(spark, segments, build=BuildOptions()):
    rows = [(n, did, doc_id, " ".join(t)) for n, docs in segments.items() for did, doc_id, t in docs]
    records = spark.createDataFrame(rows, "segment string, did long, doc_id string, text string").withColumns({"is_normalized": F.lit(True)} | {c: F.lit("") for c in STRINGS})
    prepared = I.prepare(records, build)
    order = spark.createDataFrame([(n, i) for i, n in enumerate(segments)], "segment string, ord int")
    return I.postings(prepared, F.col("segment"), build), I.documents(prepared, F.col("segment"), build, simhash=False), order


def got(spark, segments, queries, options):
    postings, docs, order = indexed(spark, segments)
    q = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(queries)], "qid long, text string")
    out = {i: [] for i in range(len(queries))}
    for r in S.search(postings, docs, q, options, True, order).orderBy("qid", "rank").collect():
        out[r.qid].append((r.doc_id, r.segment, r.matched_shingles, round(r.C, 9), [tuple(s) for s in r.match_spans]))
    return out


@pytest.mark.parametrize("options", [
    SearchOptions(min_hits=1, span_min_len=1),
    SearchOptions(topk=2, candidates_topn=3, min_hits=2, max_postings_per_hash=6, span_min_len=2, span_gap=2, max_spans_per_doc=2, alpha=0.3),
])
def test_search_equals_the_model(spark, options):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(10, 30))] for _ in range(6)]

    def text():
        return [w for _ in range(rng.randrange(1, 5)) for w in (rng.choice(shared) if rng.random() < 0.6 else [rng.choice(words) for _ in range(12)])]

    segments = {"s2": [(i, f"d{i:02}", text()) for i in range(20)], "s1": [(i, f"d{i + 10:02}", text()) for i in range(20)]}
    queries = [text() for _ in range(8)] + [["too", "short"], shared[0][:9]]
    found = got(spark, segments, queries, options)
    for i, q in enumerate(queries):
        assert found[i] == [(d, s, m, round(c, 9), runs) for d, s, m, c, runs in model.search(segments, q, options)]


def test_a_text_finds_itself_whole(spark):
    text = [f"w{i}" for i in range(40)]
    [(doc, _, matched, c, runs)] = got(spark, {"s": [(0, "a", text)]}, [text], SearchOptions())[0]
    assert (doc, matched, c, runs) == ("a", 32, 100.0, [(0, 31, 0, 31, 32)])


def test_short_runs_are_dropped(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(40)]
    for n, hits in ((13, 0), (14, 1)):
        assert len(got(spark, {"s": [(0, "x", a)]}, [b[:20] + a[5 : 5 + n] + b[20:]], SearchOptions())[0]) == hits


def test_the_earlier_segment_wins_a_tie(spark):
    text = [f"w{i}" for i in range(20)]
    segments = {"late_name_first": [(0, "a", text)], "a_name_second": [(0, "a", text)]}
    assert [h[1] for h in got(spark, segments, [text], SearchOptions())[0]] == ["late_name_first"]


def test_deleted_documents_leave_gaps(spark):
    text = [f"w{i}" for i in range(20)]
    postings, docs, order = indexed(spark, {"s": [(i, f"d{i}", text) for i in range(5)]})
    q = spark.createDataFrame([(0, " ".join(text))], "qid long, text string")
    dead = spark.createDataFrame([("d0",)], "doc_id string")
    hits = S.search(postings, docs, q, replace(SearchOptions(), topk=2), True, order, dead).collect()
    assert [(r.doc_id, r["rank"]) for r in hits] == [("d1", 2)]


def test_caps_and_strides(spark):
    text = [f"w{i}" for i in range(30)]
    segments = {"s": [(0, "a", text), (1, "b", text[:8]), (2, "c", text[:9])]}
    postings, docs, _ = indexed(spark, segments, BuildOptions(shingle_stride=3, max_shingles=4))
    assert sorted((r.did, r.pos) for r in postings.collect()) == [(0, 0), (0, 3), (0, 6), (0, 9), (2, 0)]
    assert sorted((r.did, r.tok_len) for r in docs.collect()) == [(0, 30), (2, 9)]
    capped, _, _ = indexed(spark, segments, BuildOptions(max_tokens=10))
    assert capped.filter("did = 0").count() == 2


def test_violations_are_counted(spark):
    postings, docs, _ = indexed(spark, {"s": [(0, "a", [f"w{i}" for i in range(12)])]})
    bad = postings.unionByName(postings.withColumn("did", F.lit(9).cast("long"))).unionByName(postings.limit(1).withColumn("pos", F.lit(4)))
    counts = {r.violation: r.n for r in violation_counts(bad, docs.withColumn("tok_len", F.col("tok_len"))).collect()}
    assert counts == {"did_out_of_range": 4, "pos_out_of_range": 1, "tok_len_too_small": 0}


def test_texts_are_split_once_and_matches_made_once(spark):
    """Each further pass over the texts or over the postings of an index costs as much as the whole search."""
    rows = spark.createDataFrame([(i, str(i), " ".join(f"w{i * j}" for j in range(30)), False) for i in range(20)], "did long, doc_id string, text string, is_normalized boolean")
    records = rows.withColumns({c: F.lit("") for c in STRINGS})
    postings = I.postings(I.tokenized(records), F.lit("s"))
    assert postings._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    read = spark.sparkContext.accumulator(0)

    def seen(r):
        read.add(1)
        return r

    held = spark.createDataFrame(postings.rdd.map(seen), postings.schema)
    docs = I.documents(I.prepare(records), F.lit("s"), simhash=False)
    n = postings.count()
    hits = S.search(held, docs, records.filter("did < 3").select(F.col("did").alias("qid"), "text"), replace(SearchOptions(), topk=1))
    assert sorted((r.qid, r.doc_id) for r in hits.collect()) == [(0, "0"), (1, "1"), (2, "2")]
    assert read.value == n


def test_starts_of_shingles_have_strides_and_ends(spark):
    rows = spark.createDataFrame([(0, [f"w{i}" for i in range(14)]), (1, ["a"] * 8), (2, []), (3, None), (4, ["b"] * 9)], "i int, t array<string>")
    for stride, most, want in ((1, 2**31 - 1, [0, 1, 2, 3, 4, 5]), (2, 2**31 - 1, [0, 2, 4]), (4, 9, [0, 4]), (3, 1, [0])):
        keys = T.shingle_keys(rows, F.col("t"), "i", stride=stride, most=most).collect()
        assert sorted((r.i, r.pos) for r in keys) == [*((0, p) for p in want), (4, 0)]


def planned(spark, name):
    from textweave.plans.queries import QUERIES

    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_made_from_kept_matches(spark):
    plan = planned(spark, "search_scores")
    assert "InMemoryRelation" in plan and "regexp_replace" not in plan


def test_strided_postings_are_matched_once(spark):
    plan = planned(spark, "stride_variant")
    assert "InMemoryRelation" in plan and "regexp_replace" not in plan


def test_overlapping_segments_are_matched_once(spark):
    plan = planned(spark, "search_overlapping_segments")
    assert "InMemoryRelation" in plan and "regexp_replace" not in plan


def split_to_filter(plan):
    """Lines of a plan that split texts only to drop short ones."""
    return [line for line in plan.splitlines() if "Filter" in line and "regexp_extract_all" in line]


def test_scores_split_no_text_to_drop_short_documents(spark):
    assert not split_to_filter(planned(spark, "search_scores"))


def test_strided_search_splits_no_text_to_drop_short_documents(spark):
    assert not split_to_filter(planned(spark, "stride_variant"))


def test_named_documents_are_those_of_the_whole_index(spark):
    """Repeated ids with a long and a short text, an id that is null, segments that share ids."""
    long, short = " ".join(f"W{i}" for i in range(12)), "too short"
    rows = [(1, "a", "a", long), (1, "a", "b", short), (1, "b", "a", long + " more"), (2, "a", "c", short), (3, "a", "d", long), (3, "a", "d", long), (None, "a", "e", long), (4, "b", "f", long)]
    records = spark.createDataFrame(rows, "did long, segment string, doc_id string, text string").withColumns({"is_normalized": F.lit(False)} | {c: F.lit("") for c in STRINGS})
    ids = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("a", None), ("c", 4)], "segment string, did long")
    whole = I.documents(I.prepare(records), F.col("segment"), simhash=False).join(ids, ["segment", "did"], "left_semi")
    named = I.named(records, F.col("segment"), ids)
    assert named.columns == whole.columns
    assert sorted(named.collect()) == sorted(whole.collect())
    assert sorted((r.segment, r.did, r.tok_len) for r in named.collect()) == [("a", 1, 12), ("a", 3, 12), ("a", 3, 12), ("b", 1, 13)]


def test_a_text_in_several_segments_is_split_once(spark):
    from textweave.plans.queries import _held

    ids = [*range(31), -1, -5, -30, None]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "did long, text string")
    end = " one two three four five six seven eight nine"
    want = sorted((i, f"s{k}", f"text {i}" + (end if i % 5 == 0 and k == 1 else "")) for i in ids if i is not None for k in range(3) if (i % 3 if i >= 0 else -(-i % 3)) != k)
    held = _held(rows)
    assert sorted(tuple(r) for r in held.select("did", F.explode("segment"), "text").collect()) == want
    assert held.count() == held.select("did", "text").distinct().count()
    assert not split_to_filter(planned(spark, "search_overlapping_segments"))


def test_scores_use_texts_to_their_end(spark, tmp_path):
    """A passage behind 50,000 shingles, 100,000 tokens or 8 MiB counts, and so does a text's whole length."""
    from textweave.plans.queries import QUERIES

    passage = " ".join(f"p{i}" for i in range(20))
    before = {1: " ".join(f"a{i}" for i in range(60_000)), 2: " ".join(f"b{i}" for i in range(110_000)), 3: "." * (9 << 20)}
    spark.createDataFrame([(i, f"{t} {passage}") for i, t in before.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(tuple(r) for r in QUERIES["search_scores"](spark, str(tmp_path)).collect())
    cd = [100 * 12 / n for n in (60_012, 110_012, 12)]
    assert found == [(7, i, 12, round(60 + 0.4 * x, 6), 100.0, round(x, 6)) for i, x in enumerate(cd, 1)]
