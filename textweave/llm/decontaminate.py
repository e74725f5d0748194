"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words: some count, the others are ignored. The masks for items of four
words and more keep three words; together they leave no text that holds an item without a hit, since no way
to change 40 % of six or more words, or of five or four, escapes all of them (``tests/llm`` tries them all).
Items of one to three words have masks of one or two. Hashes of all document positions are joined with those
of the benchmark. Of the hits along one diagonal (a document, an item and the shift between them), those
count that begin a run of equal words: there the document's words are laid against the whole item and the
equal ones counted, so that substitutions cost one word each. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import listed, materialise, table

#: The places that a mask keeps, and the least and greatest number of words of the items that need it (None: no bound).
SEEDS: tuple[tuple[tuple[int, ...], int, int | None], ...] = (
    ((0, 1, 2), 4, None), ((0, 1, 3), 4, None), ((0, 2, 3), 4, None), ((0, 1, 4), 5, None),
    ((0, 2, 4), 5, 5), ((0, 3, 4), 5, 5), ((0, 1), 2, 3), ((0, 2), 3, 3), ((0,), 1, 1),
)
#: The least share and the least length of a stretch for which the masks vouch.
LEAST_SHARE, LEAST_RUN = 0.6, 6
#: Benchmark rows (a masked hash, an item and a place: about 40 bytes) that are broadcast at most.
BROADCAST_ROWS = 2_000_000


#: What separates words: all but letters, marks and digits; ASCII comes first, where it is told from letters without looking up categories.
SEPARATORS = r"[\x00-/:-`{-\x7F[\x80-\x{10FFFF}&&[^\p{L}\p{M}\p{N}]]]++"


def _words(text: Column) -> Column:
    """Hashes of the words, case folded; a word is a run of letters, marks and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def _places(df: DataFrame, words: str) -> DataFrame:
    """A row for each place of ``words``. Numbers are exploded and not the array, whose length the optimiser would ask in a filter that makes it a second time."""
    return df.withColumn("place", F.explode(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))))


def _masked(words: str, numbers: list[int]) -> Column:
    """Of the place ``place`` of ``words``, the hashes under the masks of these numbers; null where the mask goes beyond the end."""
    each = []
    for number in numbers:
        at = [F.get(words, F.col("place") + by) for by in SEEDS[number][0]]
        each.append(F.when(at[-1].isNotNull(), F.xxhash64(F.lit(number), *at)))
    return F.array(*each)


def _same(words: Column, item: Column, place: Column, at: Column) -> Column:
    return F.coalesce(F.get(words, place) == F.get(item, at), F.lit(False))


def _equal(words: Column, item: Column, shift: Column) -> Column:
    """The number of equal words of ``item`` and of ``words`` from place ``shift`` on."""
    return F.size(F.filter(item, lambda w, i: F.get(words, i + shift) == w))


def _overlap(words: Column, item: Column, shift: Column, least_run: int) -> Column:
    """Equal words of ``item`` and of ``words`` from place ``shift`` on, and whether some stretch of at least ``least_run`` words of the item has at least 80 % equal.

    With 1 for an equal word and -4 for another, a stretch has 80 % if its sum is not negative. So the
    sums of the item's first words are compared with the least such sum ``least_run`` or more words before.
    """

    def equal(i: Column, w: Column) -> Column:
        return F.coalesce(F.get(words, i + shift) == w, F.lit(False))

    def gain(same: Column) -> Column:
        return F.when(same, 1).otherwise(-4)

    def step(seen: Column, same: Column) -> Column:
        at = seen["at"] + 1
        total = seen["total"] + gain(same)
        left = seen["at"] - least_run  # compared again: a lookup in the pairs would build them anew at each step
        before = F.when(left >= 0, seen["before"] + gain(equal(left, F.get(item, left)))).otherwise(0)
        low = F.least(seen["low"], before)
        return F.struct(
            at.alias("at"), (seen["equal"] + same.cast("int")).alias("equal"), total.alias("total"), before.alias("before"), low.alias("low"),
            (seen["run"] | ((at >= least_run) & (total >= low))).alias("run"),
        )

    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "equal", "total", "before", "low")], F.lit(False).alias("run"))
    return F.aggregate(F.transform(item, lambda w, i: equal(i, w)), zero, step, lambda s: F.struct(s["equal"].alias("equal"), s["run"].alias("run")))


def _laid(hits: DataFrame, least_share: float, least_run: int) -> DataFrame:
    """(id, k) of hits (id, words, k, item, shift) whose document holds the item, with the equal words."""
    equal = _equal(F.col("words"), F.col("item"), F.col("shift"))
    # few hits have enough equal words for either rule; the condition guards the search for stretches wherever the planner puts it
    worth = equal >= F.least(least_share * F.size("item"), F.lit(0.8 * least_run))
    laid = hits.select("id", "k", F.size("item").alias("n"), F.when(worth, _overlap(F.col("words"), F.col("item"), F.col("shift"), least_run)).alias("o"))
    held = laid.filter((F.col("o.equal") >= least_share * F.col("n")) | F.col("o.run"))
    return held.groupBy("id", "k").agg(F.max("o.equal").alias("equal"), F.max("n").alias("item_words"))


def overlaps(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, least_run: int = 13, id_col: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, item_id, equal, item_words): a document and an item that it holds.

    It does if, laid at some place, at least ``least_share`` of the item's words are equal, or a stretch of
    at least ``least_run`` words has at least 80 % equal, whatever the item's length. All such documents are
    found; a share under 0.6 or a run under 6 words, for which the masks don't vouch, is an error. Items
    with equal words are compared once and all of them told; an item with a null id is told as null. Null
    or blank texts and items hold nothing; documents with a null id are left out. Repeated rows count once,
    rows that share an id as one document. Empty tables give an empty table; other columns aren't read.

    The benchmark's masked hashes are counted. Up to ``broadcast_rows`` of them are broadcast with the items
    and nothing else moves; beyond, (id, hash, place) is shuffled, and the distinct diagonals are joined
    with the words once.
    """
    if least_share < LEAST_SHARE or least_run < LEAST_RUN:
        raise ValueError(f"the masks find shares of {LEAST_SHARE} and runs of {LEAST_RUN} words or more")
    items = benchmark.select("item_id", _words(F.col("text")).alias("item")).filter(F.size("item") > 0)
    null = F.max(F.col("item_id").isNull()).alias("unnamed")
    items = items.groupBy("item").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), null)
    items = materialise(items.withColumn("k", F.monotonically_increasing_id()))
    seeds = _places(items.select("k", "item"), "item")
    fits = [F.size("item").between(least, most or 2**31 - 1) for _, least, most in SEEDS]
    hashes = F.arrays_zip(F.array(*[F.when(fit, F.lit(i)) for i, fit in enumerate(fits)]).alias("mask"), _masked("item", list(range(len(SEEDS)))).alias("h"))
    seeds = seeds.select("k", F.col("place").alias("at"), F.explode(hashes).alias("s")).select("s.mask", "s.h", "k", "at")
    seeds = materialise(seeds.filter("mask IS NOT NULL AND h IS NOT NULL"))
    used = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}
    seeds, masks = seeds.drop("mask"), sorted(used) or [0]

    words = docs.select(F.col(id_col).alias("id"), _words(F.col("text")).alias("words")).filter("id IS NOT NULL")
    places = _places(words, "words")
    begins = ~_same(F.col("words"), F.col("item"), F.col("place") - 1, F.col("at") - 1)
    shift = (F.col("place") - F.col("at")).alias("shift")
    if sum(used.values()) <= broadcast_rows:
        hit = places.select("id", "words", "place", F.explode(_masked("words", masks)).alias("h")).join(F.broadcast(seeds), "h")
        hits = hit.join(F.broadcast(items.select("k", "item")), "k").filter(begins).select("id", "words", "k", "item", shift)
    else:
        hit = places.select("id", "place", F.explode(_masked("words", masks)).alias("h")).filter("h IS NOT NULL").join(seeds, "h")
        diagonals = materialise(hit.select("id", "k", shift).distinct())
        hits = diagonals.join(words, "id").join(items.select("k", "item"), "k")
    held = _laid(hits, least_share, least_run).join(items.select("k", "ids", "unnamed"), "k")
    named = F.explode(F.when(F.col("unnamed"), F.concat("ids", F.array(F.lit(None)))).otherwise(F.col("ids"))).alias("item_id")
    return held.select(F.col("id").alias(id_col), named, "equal", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as ``overlaps`` defines it; rows with a null id stay. Columns stay as they are."""
    held = overlaps(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(listed(held), id_col, "left_anti").select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each document with the items that it holds, by ascending id and joined by commas; an item with a null id counts but isn't named."""
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n"))
    told = docs.select("doc_id").join(found, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    n = F.coalesce("n", F.lit(0))
    return told.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"))
