"""Text-reuse search: query shingles against postings, for all queries at once.

``postings`` has (segment, h, did, pos), ``docs`` has (segment, did, doc_id, tok_len) and more columns,
``queries`` has (qid, text). Ties, where an order is cut, go to the smaller did, doc id or diagonal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.text import SHINGLE, shingle_keys, tokens, words
from textweave.operators.index import spread, tasks
from textweave.plans.options import SearchOptions

#: Distinct query hashes that are broadcast at most: 8 bytes each.
BROADCAST_HASHES = 4_000_000
#: Rows (a query, a segment and a document, or a hash) that are broadcast at most: some 30 bytes each.
BROADCAST_ROWS = 1_000_000
DOC_COLUMNS = ("organization_id", "external_id", "source_path", "source_name", "meta_path", "preview_text")


def query_shingles(queries: DataFrame, normalized: bool = False) -> DataFrame:
    """(qid, h, qpos): every shingle of every query, stride 1, no caps; fewer than nine tokens give none."""
    toks = tokens(F.col("text")) if normalized else words(F.col("text"))
    return shingle_keys(queries, toks, "qid").select("qid", "h", F.col("pos").alias("qpos"))


def doc_shingles(tok_len: Column) -> Column:
    return F.greatest(tok_len - (SHINGLE - 1), F.lit(0))


def few_shingles(queries: DataFrame) -> bool:
    """Whether the queries' shingles are few enough to broadcast, judged by the bytes of the texts: a shingle begins at a token, and no two tokens begin within two bytes."""
    return (queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 <= BROADCAST_HASHES


def listed(df: DataFrame) -> DataFrame:
    """``df``, kept, for one side of a join: broadcast if its counted length allows."""
    kept = df.persist()
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def matched_postings(postings: DataFrame, shingles: DataFrame, most_per_hash: int, broadcast_hashes: bool | None = None) -> DataFrame:
    """Postings of the queries' hashes, without the hashes that a segment has more than ``most_per_hash`` times.

    Postings are reduced by a semi-join before anything else touches them, so later steps follow the
    matches, not the index. The hash list is broadcast only when its length is known to be small; the matches
    are then kept, as all later steps read them and making them reads the whole index. Common
    hashes are counted by partial sums, and only if there are any, their postings are left out by an
    anti-join; no task gathers the postings of one hash.
    """
    hashes = shingles.select("h").distinct()
    if broadcast_hashes is None:
        broadcast_hashes = shingles.count() <= BROADCAST_HASHES
    hit = postings.join(F.broadcast(hashes), "h", "left_semi").persist() if broadcast_hashes else postings.join(hashes, "h", "left_semi")
    common = hit.groupBy("segment", "h").agg(F.count(F.lit(1)).alias("_df")).filter(F.col("_df") > most_per_hash).select("segment", "h").persist()
    n = common.count()
    if not n:
        common.unpersist()
        return hit
    return hit.join(F.broadcast(common) if n <= BROADCAST_ROWS else common, ["segment", "h"], "left_anti")


def candidate_hits(matched: DataFrame, shingles: DataFrame) -> DataFrame:
    """(qid, segment, did, hits): postings of the document under distinct query hashes; repeats in the query don't count."""
    each = matched.groupBy("segment", "h", "did").agg(F.count(F.lit(1)).alias("_n"))
    return each.join(shingles.select("qid", "h").distinct(), "h").groupBy("qid", "segment", "did").agg(F.sum("_n").alias("hits"))


def candidates(hits: DataFrame, options: SearchOptions) -> DataFrame:
    best = Window.partitionBy("qid", "segment").orderBy(F.desc("hits"), "did")
    return hits.filter(F.col("hits") >= options.min_hits).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= options.candidates_topn).drop("_r")


def match_points(matched: DataFrame, shingles: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, segment, did, qpos, dpos): all pairs of equal shingles in candidate documents."""
    points = matched.join(shingles, "h").join(chosen, ["qid", "segment", "did"], "left_semi")
    return points.select("qid", "segment", "did", "qpos", F.col("pos").alias("dpos"))


def spans(points: DataFrame, options: SearchOptions) -> DataFrame:
    """Runs along diagonals: islands of query positions with gaps of at most ``span_gap``; bridged gaps count as matched."""
    line = Window.partitionBy("qid", "segment", "did", "delta").orderBy("qpos")
    stepped = points.withColumn("delta", F.col("dpos") - F.col("qpos")).dropDuplicates(["qid", "segment", "did", "delta", "qpos"])
    fresh = F.coalesce((F.col("qpos") - F.lag("qpos").over(line) > 1 + options.span_gap).cast("int"), F.lit(1))
    islands = stepped.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("qid", "segment", "did", "delta", "island").agg(F.min("qpos").alias("q_from"), F.max("qpos").alias("q_to"))
    runs = runs.withColumns({"length": F.col("q_to") - F.col("q_from") + 1, "d_from": F.col("q_from") + F.col("delta"), "d_to": F.col("q_to") + F.col("delta")})
    return runs.filter(F.col("length") >= options.span_min_len).drop("island")


def top_spans(runs: DataFrame, options: SearchOptions) -> DataFrame:
    order = Window.partitionBy("qid", "segment", "did").orderBy(F.desc("length"), "q_from", "delta")
    return runs.withColumn("span_rank", F.row_number().over(order)).filter(F.col("span_rank") <= options.max_spans_per_doc)


def scores(kept: DataFrame, shingles: DataFrame, docs: DataFrame, options: SearchOptions) -> DataFrame:
    """One row a hit, with coverages and score in percent, and its spans in order. ``shingles`` may be totals (qid, q_total) already."""
    span = F.struct("span_rank", "q_from", "q_to", "d_from", "d_to", "length")
    hits = kept.groupBy("qid", "segment", "did").agg(F.sum("length").alias("matched_shingles"), F.array_sort(F.collect_list(span)).alias("_spans"))
    totals = shingles if "q_total" in shingles.columns else shingles.groupBy("qid").agg(F.count(F.lit(1)).alias("q_total"))
    told = hits.join(totals, "qid").join(docs, ["segment", "did"]).withColumn("d_total", doc_shingles(F.col("tok_len")).cast("long"))

    def coverage(total: str) -> Column:
        return F.when(F.col(total) > 0, F.least(F.lit(1.0), F.col("matched_shingles") / F.col(total))).otherwise(0.0)

    a = F.lit(options.alpha)
    told = told.withColumns({"_cq": coverage("q_total"), "_cd": coverage("d_total")})
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a * F.col("_cq") + (1 - a) * F.col("_cd")))
    fields = ("q_from", "q_to", "d_from", "d_to", "length")
    told = told.withColumns({"C": 100 * score, "Cq": 100 * F.col("_cq"), "Cd": 100 * F.col("_cd"), "alpha": a})
    return told.withColumn("match_spans", F.transform("_spans", lambda s: F.struct(*[s[f].alias(f) for f in fields]))).drop("_cq", "_cd", "_spans")


def top_hits(scored: DataFrame, options: SearchOptions, segment_order: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """Cut to ``topk`` in each segment, keep each document's best hit (the earlier segment on a tie), cut again, then drop deleted documents.

    Deleted documents go last, so a query may get fewer than ``topk`` hits although more would match.
    """
    within = Window.partitionBy("qid", "segment").orderBy(F.desc("C"), "did")
    cut = scored.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= options.topk)
    ordered = cut.withColumn("ord", F.col("segment")) if segment_order is None else cut.join(segment_order.select("segment", "ord"), "segment")
    best = Window.partitionBy("qid", "doc_id").orderBy(F.desc("C"), "ord", "_r")
    single = ordered.withColumn("_b", F.row_number().over(best)).filter(F.col("_b") == 1)
    over = Window.partitionBy("qid").orderBy(F.desc("C"), "doc_id")
    final = single.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= options.topk).drop("_r", "_b", "ord")
    return final if tombstones is None else final.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")


def search(postings: DataFrame, docs: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), normalized: bool = False, segment_order=None, tombstones=None, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All steps for all queries. Candidates are chosen from counts by hash and document; only then, and for them alone, are points made and dealt out by query and document.

    ``named`` makes the rows of ``docs`` for some (segment, did), where ``docs`` would have to be made whole to be joined with them.
    """
    queries = spread(queries.select("qid", "text"))
    shingles = query_shingles(queries, normalized)
    few = few_shingles(queries)
    matched = matched_postings(postings, shingles, options.max_postings_per_hash, few)
    chosen = listed(candidates(candidate_hits(matched, shingles), options).select("qid", "segment", "did"))
    if few:  # documents are told of before their texts are touched again
        ids = listed(chosen.select("segment", "did").distinct())
        docs = docs.join(ids, ["segment", "did"], "left_semi") if named is None else named(ids)
    points = match_points(matched, shingles, chosen).repartition(tasks(queries.sparkSession), "qid", "segment", "did")
    kept = top_spans(spans(points, options), options)
    return top_hits(scores(kept, shingles, docs, options), options, segment_order, tombstones)


def hits_json(hits: DataFrame) -> DataFrame:
    """(qid, result): each query's hits as one JSON text, best first."""
    names = ("doc_id", "C", "Cq", "Cd", "alpha", "matched_shingles", "q_total", "d_total", "match_spans", "organization_id", "external_id", "meta_path", "segment", "source_path", "source_name", "preview")
    told = hits.withColumn("preview", F.col("preview_text")).withColumn("segment", F.col("meta_path"))
    hit = F.struct("rank", F.struct(*names).alias("hit"))
    return told.groupBy("qid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["hit"])).alias("result"))
