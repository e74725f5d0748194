"""Toxicity by a weighted finite-state pattern grammar.

Word stems that toxic labels favour are learned as insult arcs; a fixed small grammar gives threats,
targets, negation and reported speech. Each of the five is a transducer over word classes with two kinds
of output: weight added and a factor on the weight. Their composition reads a clause once and scores it as
a whole: an insult counts more beside a target, less after a negation or in reported speech, and a threat
needs its target. A document's score is a logistic function of its matched clauses.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import materialise, table

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
WORDS = {
    THREAT: "kill hurt destroy beat burn shoot stab crush smash punish attack murder".split(),
    TARGET: "you your he she him her they them his their people tu vous toi ils elle du dich sie euch usted ellos".split(),
    NEGATION: "not no never isn't aren't wasn't don't nicht kein nie pas jamais nunca".split(),
    REPORT: "said says wrote writes called quoted quote claims claimed reported sagte schrieb dit dijo".split(),
}
CLASS_OF = {w: c for c, words in WORDS.items() for w in words}
CLAUSE_END = re.compile(r"[.!?;:\n]")
TOKEN = re.compile(r"[\w']+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: arcs map (state, word class) to (state, added weight, factor); without an arc the machine waits in its state."""

    arcs: dict[tuple[object, int], tuple[object, float, float]]
    start: object = 0

    def step(self, state: object, word: int) -> tuple[object, float, float]:
        return self.arcs.get((state, word), (state, 0.0, 1.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both machines at once: weights add up, factors multiply. Only states that can be reached are built."""
    arcs, todo, seen = {}, [(first.start, second.start)], set()
    while todo:
        pair = todo.pop()
        if pair in seen:
            continue
        seen.add(pair)
        for word in range(6):
            (a, wa, fa), (b, wb, fb) = first.step(pair[0], word), second.step(pair[1], word)
            arcs[pair, word] = ((a, b), wa + wb, fa * fb)
            todo.append((a, b))
    return Transducer(arcs, (first.start, second.start))


def _fading(opener: int, reach: int, on: dict[int, tuple[float, float]]) -> Transducer:
    """After ``opener``, for ``reach`` words, the classes in ``on`` give their (weight, factor)."""
    arcs: dict[tuple[object, int], tuple[object, float, float]] = {}
    for left in range(reach + 1):
        for word in range(6):
            weight, factor = on.get(word, (0.0, 1.0)) if left else (0.0, 1.0)
            arcs[left, word] = (reach if word == opener else max(0, left - 1), weight, factor)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Insults give their own weight, in ``clause_weight``; the machines add to it or scale it."""
    threat = _fading(THREAT, 3, {TARGET: (2.0, 1.0)})
    target = _fading(TARGET, 4, {INSULT: (0.5, 1.0)})
    negation = _fading(NEGATION, 3, {INSULT: (0.0, 0.4), THREAT: (0.0, 0.4)})
    report = _fading(REPORT, 12, {INSULT: (0.0, 0.6), THREAT: (0.0, 0.6)})
    return compose(compose(threat, target), compose(negation, report))


def clause_weight(machine: Transducer, stems: dict[str, float], clause: str, automaton) -> float:
    state, total = machine.start, 0.0
    for m in TOKEN.finditer(clause):
        word = m.group()
        weight, kind = 0.0, CLASS_OF.get(word, OTHER)
        if kind == OTHER:
            held = [stems[s] for end, s in automaton.iter(word) if end + 1 == len(s) and s in stems]
            if held:
                kind, weight = INSULT, max(held)
        state, added, factor = machine.step(state, kind)
        total += (weight + added) * factor
    return total


@dataclass
class Model:
    stems: dict[str, float]
    coefficients: list[float] = field(default_factory=list)


def _automaton(stems: dict[str, float]):
    a = ahocorasick.Automaton()
    for word in (*stems, *WORDS[THREAT]):
        a.add_word(word, word)
    a.make_automaton()
    return a


def features(text: str | None, machine: Transducer, stems: dict[str, float], automaton) -> list[float]:
    """Of the whole text: 1, matched weight, its rate in 100 words, best clause, matched clauses; damped by logarithms."""
    low = (text or "").lower()
    words = low.count(" ") + low.count("\n") + 1
    total = best = 0.0
    clauses, done = 0, 0
    for end, stem in automaton.iter(low):
        start = end - len(stem) + 1
        if start < done or (start and (low[start - 1].isalnum() or low[start - 1] == "_")):
            continue
        left = start
        while left > done and low[left - 1] not in ".!?;:\n":
            left -= 1
        close = CLAUSE_END.search(low, end + 1)
        done = close.end() if close else len(low)
        weight = clause_weight(machine, stems, low[left:done], automaton)
        if weight > 0:
            clauses, total, best = clauses + 1, total + weight, max(best, weight)
    return [1.0, math.log1p(total), math.log1p(100 * total / words), math.log1p(best), math.log1p(clauses)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, turns: int = 40) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step / max(1.0, float(np.abs(step).max()) / 2)
    return w


def learn(labelled: DataFrame, sample_rows: int = 20_000, least_documents: int = 4, most_stems: int = 400) -> Model:
    """A model from (id, text, label).

    The model is fitted on a bounded sample and has a bounded size; both bounds are parameters. The sample
    is the ``sample_rows`` rows that come first by a hash of the id (with all that share the last one's id);
    ids alone pass through one task, texts stay where they are. The model has the ``most_stems`` most
    telling stems, chosen among ten times as many. Stems are word beginnings of 4 to 9 letters (a shorter
    word counts as a whole) that toxic texts favour by a log-odds of 2 or more; of stems that begin alike
    the most telling is taken. Rows without a label or text, and copies of a text, don't count.
    """
    rows = labelled.filter("label IS NOT NULL AND text IS NOT NULL").select("id", "text", F.col("label").cast("int").alias("label"))
    chosen = materialise(rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    rows = materialise(rows.join(F.broadcast(chosen), "id")).dropDuplicates(["text"])
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)))
    said = rows.select("label", F.explode(words).alias("word")).groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    begins = F.transform(F.sequence(F.lit(4), F.least(F.lit(9), F.greatest(F.lit(4), F.length("word")))), lambda n: F.substring("word", F.lit(1), n))
    grams = said.select("bad", "good", F.explode(F.array_distinct(begins)).alias("stem")).groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = said.agg(F.sum("bad"), F.sum("good")).first()
    if not sums or not sums[0] or not sums[1]:
        return Model({}, [])
    odds = F.log((F.col("bad") + 0.5) / float(sums[0])) - F.log((F.col("good") + 0.5) / float(sums[1]))
    told = grams.filter(F.col("bad") >= least_documents).withColumn("odds", odds).filter("odds >= 2").withColumn("gain", F.col("bad") * F.col("odds"))
    stems: dict[str, float] = {}
    for r in told.orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").limit(most_stems * 10).collect():
        if len(stems) < most_stems and r["stem"] not in CLASS_OF and not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in stems):
            stems[r["stem"]] = min(6.0, r["odds"])
    scored = rows.select("text", "label").mapInPandas(_features_of(stems), "f array<double>, label int").toPandas()
    x, y = np.stack(scored["f"].to_numpy()), scored["label"].to_numpy().astype(float)
    return Model(stems, logistic(x, y).tolist())


def _features_of(stems: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, automaton = grammar(), _automaton(stems)
        for pdf in batches:
            yield pd.DataFrame({"f": [features(t, machine, stems, automaton) for t in pdf["text"]], "label": pdf["label"]})

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` in 0 to 1, in the place of a column of that name. Each whole text is read, null and empty ones too; only the text counts."""
    stems, w = model.stems, np.array(model.coefficients or [-6.0, 1.0, 1.0, 1.0, 0.0])

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, automaton = grammar(), _automaton(stems)
        for batch in texts:
            x = np.array([features(t if isinstance(t, str) else None, machine, stems, automaton) for t in batch]).reshape(-1, 5)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return docs.withColumn("score", scored(F.col(text_col)))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def train(spark, docs: DataFrame, sf_dir: str, sample_rows: int = 20_000) -> Model:
    """From the labels that aren't held out: ``sample_rows`` of their ids at most are broadcast to the texts."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    chosen = labels.filter("label IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    labels = materialise(labels.filter("label IS NOT NULL").join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label")))
    return learn(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(labels), "id"), sample_rows)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Each document's score by a model that hasn't seen the held-out labels; a null id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
