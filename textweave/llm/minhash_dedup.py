"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

Each distinct shingle set gets a signature of 32 positions of 16 bits, cut into 8 chunks of 4 positions.
Two signatures that differ in at most 15 positions have, by the pigeonhole principle, a chunk with at
most one differing position; so each chunk enters the index once for each position left out, and every
pair within that distance meets under some key. At a similarity of 0.85 a position differs with
probability 0.15, and 16 or more of 32 do with a probability of about 3e-6. Pairs that meet are
confirmed on the full sets.

Groups of copies are never expanded into all pairs. Equal sets are one class from the start. Under a
key, classes are first compared with the key's least class, which joins most groups; afterwards only
pairs in different components are compared, in blocks, and those that a sketch of their sets doesn't
rule out are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.llm.common import listed, materialise, table
from textweave.llm.components import components
from textweave.llm.shingles import bin_codes, min_hashes, mixed, shingle_sets, text_groups

POSITIONS, CHUNK, BINS = 32, 4, 1024
#: Rows of a key that are compared in one task.
BLOCK = 1024


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set."""
    return np.array([[s.sum(dtype=np.uint64), mixed(s ^ np.uint64(99)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in text_groups(batch.column(1)):
                sets = list(shingle_sets(data, bounds, size))
                prints = _prints(sets)
                codes = min_hashes(sets, POSITIONS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints[:, 0]),
                        pa.array(prints[:, 1]),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ],
                    ["id", "n", "f1", "f2", "signature"],
                )

    return run


def _whole(one: np.ndarray) -> bytes:
    return one.tobytes()


def _sketched(one: np.ndarray) -> bytes:
    return bin_codes(one, BINS).tobytes() + min_hashes([one], POSITIONS).tobytes()


def _sets(size: int, form):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in text_groups(batch.column(1)):
                sets = list(shingle_sets(data, bounds, size))
                prints = _prints(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(map(form, sets), pa.binary())], ["id", "f1", "f2", "set"])

    return run


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class, each chunk and each position left out: the exact other three codes, chunk and position."""
    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, POSITIONS // CHUNK, CHUNK).astype(np.int64)
        n, keys = len(codes), []
        for chunk in range(POSITIONS // CHUNK):
            for out in range(CHUNK):
                key = np.full(n, chunk * CHUNK + out, np.int64)
                for place in range(CHUNK):
                    if place != out:
                        key = key << 16 | codes[:, chunk, place]
                keys.append(key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.tile(batch.column(0).to_numpy(), len(keys))), pa.array(np.tile(batch.column(1).to_numpy(), len(keys)))],
            ["key", "id", "n"],
        )


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _plausible(percent: int):
    """Pairs of a block that are in different components, agree in size, and whose bins differ little enough.

    The union's least hashes in its used bins are a sample without replacement from the union, so the
    bins that differ follow a hypergeometric law; 5 sigma above its mean at the least similarity, and one
    bin, is let pass. A first look takes an eighth of the bins and 6 sigma: its used bins are fewer, but are
    a sample of the same whole union. At the least similarity the law's tails lose at most 4 pairs in a
    million. A pair that meets under several keys is told under the first of them only.
    """
    share = 1 - percent / 100

    def most(union: np.ndarray, used: np.ndarray, sigmas: float) -> np.ndarray:
        spread = used * share * (1 - share) * np.maximum(union - used, 0) / np.maximum(union - 1, 1)
        return used * share + sigmas * np.sqrt(spread) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        ids, roots, n, home = (pdf[c].to_numpy() for c in ("id", "root", "n", "block"))
        sketches = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, BINS + 2 * POSITIONS)
        codes = np.ascontiguousarray(sketches[:, :BINS])
        signs = np.ascontiguousarray(sketches[:, BINS:]).view(np.uint16)
        number = int(pdf["key"].iloc[0]) >> 16 * (CHUNK - 1)
        look = np.ascontiguousarray(codes[:, : BINS // 8])
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        there = home == high
        found = []
        for i in np.flatnonzero(home == low):
            j = np.flatnonzero(there & (roots != roots[i]) & ((ids > ids[i]) | (low != high)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            for table, sigmas in ((look, 6), (codes, 5)):
                if len(j):
                    union = np.ceil((n[j] + n[i]) / (1 + percent / 100))
                    used = np.count_nonzero(table[j] | table[i], axis=1)
                    j = j[np.count_nonzero(table[j] != table[i], axis=1) <= most(union, used, sigmas)]
            if len(j):
                same = (signs[j] == signs[i]).reshape(len(j), -1, CHUNK)
                shared = same.sum(2, keepdims=True) - same == CHUNK - 1
                j = j[shared.reshape(len(j), -1).argmax(1) == number]
                found.append(np.stack([np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


class _Linker:
    """The classes of one corpus, their index and the components so far."""

    def __init__(self, texts: DataFrame, classes: DataFrame, size: int, percent: int, repeated: bool):
        self.texts, self.classes, self.size, self.percent, self.repeated = texts, classes, size, percent, repeated
        keys = materialise(classes.select("id", "n", "signature").mapInArrow(_index_keys, "key long, id long, n long"))
        # by partial sums: a key's rows never meet in one task; of keys with the same classes one is enough
        prints = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(7, id))").alias("y"))
        once = prints.filter("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
        self.keys = materialise(keys.join(listed(once), "key", "left_semi"))
        self.roots: DataFrame | None = None

    def rooted(self) -> DataFrame:
        if self.roots is None:
            return self.keys.withColumn("root", F.col("id"))
        known = self.roots.select(F.col("node").alias("id"), "root")
        return self.keys.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))

    def unsettled(self) -> tuple[DataFrame, DataFrame]:
        """The index without the keys whose classes are all in one component; and of each other key the least class and the number of classes."""
        rooted = self.rooted() if self.roots is None else materialise(self.rooted())
        told = rooted.groupBy("key").agg(F.min(F.struct("id", "n", "root")).alias("hub"), F.count(F.lit(1)).alias("m"), F.min("root").alias("l"), F.max("root").alias("h"))
        told = listed(told.filter("l < h").drop("l", "h"))
        return rooted, told

    def star(self) -> DataFrame:
        """Each key's classes paired with the least of them."""
        rooted, told = self.unsettled()
        fits = F.expr(f"100 * least(n, hub.n) >= {self.percent} * greatest(n, hub.n) AND root <> hub.root")
        return rooted.join(told, "key").filter(fits).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()

    def rest(self) -> DataFrame:
        """All plausible pairs between components under one key, by pairs of blocks of its classes."""
        rooted, told = self.unsettled()
        dealt = rooted.join(told, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", "id", "n", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        dealt = materialise(dealt)
        with_bins = dealt.join(self.formed(dealt.select("id").distinct(), _sketched), "id").withColumnRenamed("set", "bins")
        return with_bins.groupBy("key", "low", "high").applyInPandas(_plausible(self.percent), "a long, b long").distinct()

    def formed(self, ids: DataFrame, form) -> DataFrame:
        """The sets of the named classes, made again from the texts of their documents. Names of checked number are broadcast; more are joined."""
        made = self.texts.join(listed(ids), "id", "left_semi").mapInArrow(_sets(self.size, form), "id long, f1 long, f2 long, set binary")
        if self.repeated:
            made = made.join(self.classes.select("id", "f1", "f2"), ["id", "f1", "f2"], "left_semi")
        return made.drop("f1", "f2").dropDuplicates(["id"])

    def confirm(self, pairs: DataFrame) -> None:
        """Compare full sets and merge the components of pairs that are similar enough."""
        pairs = materialise(pairs)
        if not pairs.limit(1).count():
            return
        sets = self.formed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), _whole)
        x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        links = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(self.percent), "a long, b long")
        if self.roots is not None:
            for side in "ab":
                known = self.roots.select(F.col("node").alias(side), F.col("root").alias("_r"))
                links = links.join(known, side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
        step = components(links)
        if self.roots is None:
            self.roots = step
        else:
            moved = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            old = self.roots.join(moved, self.roots["root"] == moved["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
            self.roots = materialise(old.unionByName(step.join(old.select("node"), "node", "left_anti")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set holds its distinct ``size``-word shingles (A-Z lower-cased, words are runs of
    non-blanks); with fewer words, the whole sequence. Documents are linked if 100 * intersection >=
    ``percent`` * union; a component's id is its least document id, and that document is kept. A text
    that is null, empty or blank has an empty set, is linked with nothing and is kept. Rows with a null
    id take no part: their component is null and they are not kept. Rows repeating an id and a text are
    equal in the result; of different texts under one id the last by hash stands for it in comparisons, and
    the others take the component of an equal set, if any. Other columns are not read. An empty table gives
    an empty table.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(_signatures(size), "id long, n long, f1 long, f2 long, signature binary"))
    full = signed.filter("n > 0 AND id IS NOT NULL")
    repeated = materialise(full.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("id"))
    several = bool(repeated.limit(1).count())
    if several:  # of the texts under one id the one whose hashes come last
        again = listed(repeated)
        last = F.max(F.struct("f1", "f2", "n", "signature")).alias("s")
        single = full.join(again, "id", "left_semi").groupBy("id").agg(last).select("id", "s.n", "s.f1", "s.f2", "s.signature")
        full = materialise(full.join(again, "id", "left_anti").unionByName(single))
    classes = full.groupBy("n", "f1", "f2").agg(F.min("id").alias("class"))
    classes = materialise(classes)
    heads = materialise(full.join(classes.select("n", "f1", "f2", F.col("class").alias("id")), ["n", "f1", "f2", "id"], "left_semi").select("id", "n", "f1", "f2", "signature").dropDuplicates(["id"]))
    linker = _Linker(texts, heads, size, percent, several)
    linker.confirm(linker.star())
    linker.confirm(linker.rest())
    member = signed.select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    if linker.roots is not None:
        member = member.join(linker.roots.withColumnRenamed("node", "class"), "class", "left")
        member = member.withColumn("class", F.coalesce("root", "class"))
    component = F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return member.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component left, the one with the least id. Rows with a null id stay; of rows that repeat an id one stays."""
    lost = near_duplicates(docs, size, percent, id_col, text_col).filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    left = docs.join(listed(lost), id_col, "left_anti").select(*docs.columns)
    repeated = materialise(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(id_col))
    if not repeated.limit(1).count():
        return left
    again = listed(repeated)
    return left.join(again, id_col, "left_anti").unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col])).select(*docs.columns)


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document's component over links of 85 %, by shingles of three words; as ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
