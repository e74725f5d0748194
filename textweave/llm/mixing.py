"""Mixing sources to target weights in fixed-length blocks.

Each source's words form one stream, cut into blocks of a fixed length. Output shards have fixed numbers
of slots; how many slots of a shard go to each source is a multinomial draw, made under the condition
that the draws of all shards add up to the source's share. A source's slots are numbered through and
mapped to its blocks by pseudorandom permutations of the block numbers, one for each pass over the
source, and joined with the blocks by number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.llm.common import WORD, chunk_count, materialise, running_total
from textweave.llm.spans import let


def word_targets(words: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Each source's target in words.

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share`` of all words
    by weight; what a source would get above ``most`` times its words goes to the others by weight, until
    none is above.
    """
    ordered = sorted(s for s in words if s is not None) + [None] * (None in words)
    weigh = {s: float(weights[i % len(weights)]) for i, s in enumerate(ordered)}
    targets: dict[str | None, float] = {}
    rest = share * sum(words.values())
    while open_ := [s for s in ordered if s not in targets]:
        per_weight = rest / sum(weigh[s] for s in open_)
        above = [s for s in open_ if per_weight * weigh[s] > most * words[s]]
        if not above:
            targets |= {s: per_weight * weigh[s] for s in open_}
        for s in above:
            targets[s] = most * words[s]
            rest -= targets[s]
    return targets


@dataclass(frozen=True)
class SourcePlan:
    number: int
    source: str | None
    words: int
    target: float
    block_words: int
    blocks: int
    slots: int


def plan_sources(words: dict[str | None, int], block_words: int = 128, least_blocks: int = 256, **options) -> list[SourcePlan]:
    """Blocks and slots of each source. Sources of few words get shorter blocks, so that their share can be met closely."""
    targets = word_targets(words, **options)
    plans = []
    for number, (source, target) in enumerate(targets.items()):
        n = words[source]
        length = max(1, min(block_words, n // least_blocks))
        blocks = -(-n // length)
        slots = min(2 * blocks, round(target * blocks / n)) if n else 0
        plans.append(SourcePlan(number, source, n, target, length, blocks, slots))
    return plans


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each seed, at ``index``: a Feistel network walked until it is in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, s = out[todo], half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            z = right + s + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_draws(shard: int, shards: int, totals: np.ndarray, seed: int, run: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and in all shards before it.

    The shards' counts are multinomial draws given their sums. Shards stand in runs of ``run``, and each run
    has its even part of each source's ``totals``. Halving the range of shards of a run again and again,
    with a generator seeded by the range, lets any shard find its own counts alone.
    """

    def up_to(i: int) -> np.ndarray:
        """Slots of each source in the first ``i`` shards, where a run begins or ends: each source's own even part, made up to a whole number of slots."""
        exact = [int(t) * i for t in totals]
        low = np.array([x // shards for x in exact], np.int64)
        short = int(totals.sum()) * i // shards - int(low.sum())
        low[sorted(range(len(exact)), key=lambda k: (-(exact[k] % shards), k))[:short]] += 1
        return low

    bounds = lambda i: int(totals.sum()) * i // shards
    lo = shard // run * run
    hi = min(shards, lo + run)
    before = up_to(lo)
    here = up_to(hi) - before
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, bounds(mid) - bounds(lo), method="marginals")
        if shard < mid:
            hi, here = mid, left
        else:
            lo, here, before = mid, here - left, before + left
    return here, before


def draw_slots(spark, plans: list[SourcePlan], slots_per_shard: int = 4096, seed: int = 7) -> DataFrame:
    """One row an output slot: shard, slot, number (of the source), pass_ (over the source) and block."""
    totals = np.array([p.slots for p in plans], np.int64)
    shards = chunk_count(int(totals.sum()), slots_per_shard)
    blocks = np.array([max(1, p.blocks) for p in plans], np.int64)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts, before = shard_draws(int(shard), shards, totals, seed)
                number = np.repeat(np.arange(len(counts)), counts)
                index = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts) + before[number]
                turn, place = index // blocks[number], index % blocks[number]
                block = permuted(place, blocks[number], (number + 1) * 1_000_003 + turn * 7919 + seed)
                order = np.random.default_rng([seed, int(shard)]).permutation(len(number))  # sources in mixed order within the shard
                yield pd.DataFrame({"shard": int(shard), "slot": np.arange(len(number)), "number": number[order], "pass_": turn[order], "block": block[order]})

    if not totals.sum():
        return spark.createDataFrame([], "shard long, slot long, number long, pass_ long, block long")
    return spark.range(shards).mapInPandas(emit, "shard long, slot long, number long, pass_ long, block long")


def source_words(docs: DataFrame, max_sources: int = 100_000) -> dict[str | None, int]:
    """Words by source, on the driver; a source is a dimension value, and more than ``max_sources`` are refused."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return {r["source"]: int(r["n"] or 0) for r in rows}


def word_count(text) -> object:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(sized: DataFrame, plans: list[SourcePlan], rows_per_chunk: int) -> DataFrame:
    """Rows of ``sized`` with words, with their source's plan and ``first``, the place of their first word in the source's stream."""
    spark = sized.sparkSession
    known = spark.createDataFrame(
        [(p.source, p.number, p.words, p.target, p.block_words) for p in plans], "_source string, number long, source_size long, target double, block_words long"
    )
    # one row a source, at most max_sources of them: small whatever the input
    joined = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["_source"])).drop("_source")
    return running_total(joined, ["number"], F.col("doc_id"), [F.col("doc_id"), F.col("size")], F.col("size"), chunk_count(sized.count(), rows_per_chunk), "first")


def block_uses(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """One row for each block that a document has words in: its place, the words in it, and the passes that take it."""
    last = F.expr("(first + size - 1) div block_words")
    pieces = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.expr("first div block_words"), last)))
    start = F.greatest(F.col("first"), F.col("block") * F.col("block_words"))
    stop = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    pieces = pieces.select("number", "block", "first", (start - F.col("first")).alias("from_word"), (stop - start).alias("words"))
    taken = slots.groupBy("number", "block").agg(F.sort_array(F.collect_list("pass_")).alias("passes"))
    return pieces.join(taken.hint("merge"), ["number", "block"])  # slots come from a short range of shards and look small to the planner


def mix(docs: DataFrame, block_words: int = 128, rows_per_chunk: int = 8_192, seed: int = 7, **options) -> DataFrame:
    """For each row of ``docs`` (doc_id, source, size in words): ``source_size``, ``target`` (of its source, words) and ``taken`` (words of it in the mix, repeats counted).

    Null sources are one source, last in order. Rows of size 0 are returned with nothing taken. A block
    is taken at most twice, hence no row gives more than twice its size. Repeated rows are rows of
    their own. The same input and seed give the same mix.
    """
    plans = plan_sources(source_words(docs), block_words, **options)
    placed = _placed(docs.select("doc_id", "source", "size"), plans, rows_per_chunk)
    uses = block_uses(placed, draw_slots(docs.sparkSession, plans, seed=seed))
    taken = uses.groupBy("number", "first").agg(F.sum(F.col("words") * F.size("passes")).alias("_taken"))
    sized = placed.filter(F.col("size") > 0).join(taken, ["number", "first"], "left").withColumn("taken", F.coalesce("_taken", F.lit(0)))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    empty = placed.filter(F.col("size") == 0).select(*columns, F.lit(0).cast("long").alias("taken"))
    return sized.select(*columns, "taken").unionByName(empty)


def mix_texts(docs: DataFrame, block_words: int = 128, rows_per_chunk: int = 8_192, seed: int = 7, **options) -> DataFrame:
    """The mix itself: one row with the columns of ``docs`` for each document and pass over its source that takes words of it.

    ``text`` holds the words taken in that pass: the text as it is if they are all, else the taken words
    with single spaces between them; ``n_chars``, if there, is its length. Documents of which nothing is
    taken, as those without words, are not in the mix. A null source is a source, null ids are ids.
    Repeated rows are rows of their own; other columns stay, whatever their names. An empty table gives an
    empty table.
    """
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    content = [*[F.to_json(F.struct(F.col(c))) for c in names], F.col("text")]
    # a row is known by 128 bits of its content, and by a number where rows are equal in all columns
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b"))
    sizes = materialise(keyed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "a", "b", word_count(F.col("row.text")).alias("size")))
    again = bool(sizes.groupBy("a", "b").count().filter("count > 1").limit(1).count())
    number = F.row_number().over(Window.partitionBy("a", "b").orderBy("a")) if again else F.lit(1)
    sizes, keyed = sizes.withColumn("nth", number), keyed.withColumn("nth", number)
    plans = plan_sources(source_words(sizes), block_words, **options)
    placed = materialise(_placed(sizes, plans, rows_per_chunk))
    uses = block_uses(placed, draw_slots(docs.sparkSession, plans, seed=seed))
    taken = uses.select("number", "first", "from_word", "words", F.explode("passes").alias("pass_")).groupBy("number", "first", "pass_")
    taken = taken.agg(F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("pieces"), F.sum("words").alias("taken"))
    rows = placed.filter("size > 0").join(taken, ["number", "first"]).select("a", "b", "nth", "size", "pieces", "taken")
    text = F.col("row.text")
    part = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda own: F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(own, (p["from_word"] + 1).cast("int"), p["words"].cast("int")))), " "))
    out = keyed.join(rows, ["a", "b", "nth"]).select("row", F.when(F.col("taken") < F.col("size"), part).otherwise(text).alias("made"))
    kinds = dict(docs.dtypes)
    made = {"text": F.col("made"), "n_chars": F.length("made").cast(kinds.get("n_chars", "long"))}
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words that the mix takes of it; as ``mix``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(materialise(docs)).select("doc_id", "size", "source_size", "target", "taken")
