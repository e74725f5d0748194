"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length, where the order by Euclidean distance is the order by cosine. A table
hashes a vector to floor((a_i . v + b_i) / w) for ``functions`` Gaussian (2-stable) directions a_i. A query
visits its own bucket and then perturbed ones, in the order of their estimated success: the sum of the
squared distances from the query's projections to the borders that the perturbation crosses. Visits are
ids; small buckets share a cell and large ones are dealt over blocks, and a query's vector travels once to
each block that holds buckets it visits. There it meets these buckets' vectors, and no others, as matrix
products; each block gives its nearest few, and the candidates of all blocks and tables are merged and
ranked by exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.llm.common import chunk_count, listed, materialise, table


def probes(down: np.ndarray, width: float, count: int) -> list[tuple[tuple[int, int], ...]]:
    """The ``count`` best perturbations, as (function, -1 or 1) steps, for a query ``down`` above its bucket's lower borders."""
    steps = sorted([(x * x, i, -1) for i, x in enumerate(down)] + [((width - x) ** 2, i, 1) for i, x in enumerate(down)])
    out: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        if len({steps[j][1] for j in chosen}) == len(chosen):
            out.append(tuple(steps[j][1:] for j in chosen))
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
    return out


def _family(dim: int, index: int, functions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([83, dim, index])
    return rng.normal(size=(dim, functions)), rng.uniform(0, width, functions)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(tables: int, functions: int, width: float, count: int):
    """Buckets of each vector: its own if ``count`` is 1, else those that a query visits. Ids only, no vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vector"].map(len)):
                x, rows, of, names = _units(part["vector"]), [], [], []
                for t in range(tables):
                    a, b = _family(int(dim), t, functions, width)
                    at = x @ a + b
                    low = np.floor(at / width).astype(np.int64)
                    down = at - low * width
                    for i in range(len(x)):
                        for steps in probes(down[i], width, count) if count > 1 else [()]:
                            y = low[i].copy()
                            for j, step in steps:
                                y[j] += step
                            rows.append(i)
                            of.append(t)
                            names.append(",".join(map(str, y)))
                named = pd.Series(part["class"].to_numpy(dtype=object)[rows], dtype=object)
                yield pd.DataFrame({"class": named, "dim": int(dim), "of": of, "bucket": pd.Series(names, dtype=object)})

    return run


def _nearest(k: int):
    """The k nearest classes of each query within the buckets of one block that it visits, with all that tie with the last."""

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "class": [], "score": []}
        if len(queries) and len(block):
            base, ids = np.stack(block["vector"].to_numpy()).astype(np.float64), block["class"].to_numpy()
            base_norms = np.sqrt((base * base).sum(1))
            asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            norms = np.sqrt((asked * asked).sum(1))
            visits = queries["buckets"].reset_index(drop=True).explode()
            askers = visits.groupby(visits).groups
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(asked))]
            for bucket, here in block.reset_index(drop=True).groupby("bucket").indices.items():
                who = np.asarray(askers.get(bucket, ()), dtype=np.int64)
                for start in range(0, len(who), 512):
                    part = who[start : start + 512]
                    rough = (asked[part] @ base[here].T) / base_norms[here]
                    last = -np.partition(-rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(part), -np.inf)
                    for i, one in enumerate(part):
                        j = here[rough[i] >= last[i] - 1e-9 * norms[one]]
                        found[one].append((j, (asked[one] * base[j]).sum(1) / (norms[one] * base_norms[j])))
            for name, parts in zip(queries["class"], found):
                if parts:
                    j, scores = (np.concatenate(x) for x in zip(*parts))
                    if len(j) > k:
                        best = scores >= -np.partition(-scores, k - 1)[k - 1]
                        j, scores = j[best], scores[best]
                    out["query"] += [name] * len(j)
                    out["class"] += ids[j].tolist()
                    out["score"] += scores.tolist()
        return pd.DataFrame({c: pd.Series(v, dtype=float if c == "score" else object) for c, v in out.items()})

    return run


def nearest(
    vectors: DataFrame, is_query, k: int = 5, tables: int = 3, functions: int = 5, width: float = 2.0, visits: int = 64, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest found for each row for which ``is_query`` holds, among all other rows.

    Equal vectors are hashed and searched once, whatever their number: of a group of copies only the k + 1
    least ids can be in any result, and these are kept. A bucket of more than ``block_rows``
    vectors is dealt over blocks of about that size; smaller ones share cells of about as many. A query for which the visited buckets hold fewer than k + 1 rows visits every
    bucket of the first table, hence finds k whenever there are k. Vectors that are null, zero, or hold
    null or non-finite components take no part; those of another length are not compared. Ties go to
    the smaller id. A repeated id is a row of its own.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).filter(~bad & F.exists(vector_col, lambda x: x != 0))
    sound = sound.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    # cosines don't change with a vector's scale: one whose squares leave the range of doubles is scaled by a power of two
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    far = (largest > 1e100) | (largest < 1e-100)
    power = F.floor(F.log2(largest))
    half = F.floor(power / 2)  # in two steps, as one factor may be out of range itself
    scaled = F.transform("vector", lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power))
    sound = sound.withColumn("vector", F.when(far, scaled).otherwise(F.col("vector")))
    sound = sound.withColumn("class", F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))
    first = Window.partitionBy("class").orderBy("id")
    members = sound.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    classes = materialise(members.groupBy("class").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")))
    asking = materialise(sound.filter("asks").select("id", "class"))
    queries = classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "vector")
    shape = "class string, dim int, of int, bucket string"

    def hashed(rows: DataFrame, count: int) -> DataFrame:
        named = rows.select("class", "vector").mapInPandas(_hashed(tables, functions, width, count), shape)
        return named.withColumn("bucket", F.xxhash64("bucket"))  # should two names fall together, both are visited

    base = materialise(hashed(classes, 1))
    cells = chunk_count(classes.count(), block_rows)
    there = base.groupBy("dim", "of", "bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    there = listed(there.withColumn("cell", F.pmod(F.xxhash64(F.lit(5), "bucket"), F.lit(cells)).cast("int")))
    place = ["dim", "of", "cell", "block"]
    base = base.join(there, ["dim", "of", "bucket"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    base = base.select("class", "bucket", *place).join(classes.select("class", "vector"), "class")

    def search(visiting: DataFrame) -> DataFrame:
        """Only (bucket, block) pairs that exist are visited. The vectors of queries join once a block."""
        placed = visiting.join(there, ["dim", "of", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.groupBy("class", *place).agg(F.collect_list("bucket").alias("buckets")).join(queries, "class")
        found = placed.groupBy(*place).cogroup(base.groupBy(*place)).applyInPandas(_nearest(k + 1), "query string, class string, score double")
        found = found.distinct().withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("_r") <= k + 1)
        return materialise(found.drop("_r").join(classes.select("class", "ids"), "class"))

    found = search(hashed(queries, visits))
    enough = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > k).select(F.col("query").alias("class"))
    short = materialise(queries.join(enough, "class", "left_anti"))
    if short.limit(1).count() and classes.limit(2).count():
        everywhere = there.filter("of = 0").select(*[F.col(c).alias(c) for c in ("dim", "of", "bucket")])
        all_of = short.select("class", F.size("vector").alias("dim")).join(everywhere, "dim")
        rest = search(all_of)
        found = found.join(short.select(F.col("class").alias("query")), "query", "left_anti").unionByName(rest)
    own = asking.select(F.col("id").alias("query_id"), F.col("class").alias("query"))
    pairs = own.join(found, "query").select("query_id", F.explode("ids").alias("id"), "score").filter("id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50; as ``nearest``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", F.col("vec_id").cast("long"), "score")
