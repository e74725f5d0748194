"""The same operators as one chain of SQL, for checking results with another engine.

Shingles are compared as text there, so nothing rests on a hash.
"""

from __future__ import annotations

from textweave.functions.text import LOWER, SEPARATORS, UPPER
from textweave.plans.options import SearchOptions


def norm(text: str) -> str:
    return f"trim(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{SEPARATORS}', ' ', 'g'))"


def toks(text: str) -> str:
    return f"list_filter(string_split({norm(text)}, ' '), lambda x: x <> '')"


def corpus(source: str, segment: str = "'all'", stride: int = 1) -> str:
    """CTEs ``d`` (segment, did, doc_id, tok_len) and ``p`` (segment, did, pos, h) from a source of (did, doc_id, text)."""
    return f"""
d0 AS (SELECT {segment} AS segment, did, doc_id, {toks("text")} AS t FROM ({source})),
d AS (SELECT segment, did, doc_id, len(t) AS tok_len, t FROM d0 WHERE len(t) >= 9),
p AS (SELECT segment, did, pos, array_to_string(t[pos + 1:pos + 9], ' ') AS h
      FROM (SELECT segment, did, t, unnest(range(0, len(t) - 8, {stride})) AS pos FROM d))"""


def queries(source: str) -> str:
    """CTE ``q`` (qid, qpos, h) from a source of (qid, text)."""
    return f"""
q AS (SELECT qid, qpos, array_to_string(t[qpos + 1:qpos + 9], ' ') AS h
      FROM (SELECT qid, t, unnest(range(0, len(t) - 8)) AS qpos FROM (SELECT qid, {toks("text")} AS t FROM ({source}))))"""


def chain(o: SearchOptions = SearchOptions()) -> str:
    """CTEs from matched postings to final hits."""
    return f"""
m0 AS (SELECT *, count(*) OVER (PARTITION BY segment, h) AS df FROM p WHERE h IN (SELECT h FROM q)),
m AS (SELECT * FROM m0 WHERE df <= {o.max_postings_per_hash}),
hits AS (SELECT qid, segment, did, count(*) AS hits FROM m JOIN (SELECT DISTINCT qid, h FROM q) USING (h) GROUP BY qid, segment, did),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, segment ORDER BY hits DESC, did) AS r FROM hits WHERE hits >= {o.min_hits}) WHERE r <= {o.candidates_topn}),
pts AS (SELECT DISTINCT qid, segment, did, qpos, pos AS dpos, pos - qpos AS delta FROM m JOIN q USING (h) JOIN cand USING (qid, segment, did)),
lagged AS (SELECT *, CASE WHEN qpos - lag(qpos) OVER w <= {1 + o.span_gap} THEN 0 ELSE 1 END AS fresh FROM pts WINDOW w AS (PARTITION BY qid, segment, did, delta ORDER BY qpos)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY qid, segment, did, delta ORDER BY qpos) AS island FROM lagged),
runs AS (SELECT qid, segment, did, delta, min(qpos) AS q_from, max(qpos) AS q_to, max(qpos) - min(qpos) + 1 AS length
         FROM isl GROUP BY qid, segment, did, delta, island HAVING max(qpos) - min(qpos) + 1 >= {o.span_min_len}),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, segment, did ORDER BY length DESC, q_from, delta) AS span_rank FROM runs) WHERE span_rank <= {o.max_spans_per_doc}),
qt AS (SELECT qid, count(*) AS q_total FROM q GROUP BY qid),
cov AS (SELECT qid, segment, did, doc_id, matched, q_total, greatest(tok_len - 8, 0) AS d_total
        FROM (SELECT qid, segment, did, sum(length) AS matched FROM kept GROUP BY qid, segment, did) JOIN qt USING (qid) JOIN (SELECT segment, did, doc_id, tok_len FROM d) USING (segment, did)),
sc AS (SELECT *, least(1.0, matched / q_total::DOUBLE) AS cq, least(1.0, matched / d_total::DOUBLE) AS cd FROM cov),
scored AS (SELECT *, 100 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, {o.alpha}::DOUBLE * cq + (1 - {o.alpha}::DOUBLE) * cd)) AS c FROM sc),
seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, segment ORDER BY c DESC, did) AS r FROM scored) WHERE r <= {o.topk}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY c DESC, segment, r) AS b FROM seg) WHERE b = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, doc_id) AS rank FROM best) WHERE rank <= {o.topk})"""


HIT = "SELECT qid, CAST(rank AS BIGINT) AS rank, segment, doc_id, CAST(matched AS BIGINT) AS matched_shingles, CAST(q_total AS BIGINT) AS q_total, CAST(d_total AS BIGINT) AS d_total, round(c, 6) AS c, round(100 * cq, 6) AS cq, round(100 * cd, 6) AS cd FROM top"
DOCUMENTS = "SELECT doc_id AS did, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents"
BENCHMARK = "SELECT item_id AS qid, text FROM benchmark"


def full(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
