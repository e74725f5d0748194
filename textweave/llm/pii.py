"""Personal data: pattern matches, and terms that reveal them, by information theory.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. On top of it, corpus
co-occurrence estimates how strongly a term beside a protected value e gives it away: with n() the
documents of the whole corpus, PMI(t, e) = log2(n(t, e) N / (n(t) n(e))) is compared with the value's
information content IC(e) = log2(N / n(e)). Terms with PMI >= ``generalise`` IC are replaced by a
placeholder, those with PMI >= ``remove`` IC are removed, wherever they stand in a document that holds the
value. n(t, e) counts the documents in which t stands beside e, so PMI / IC tells how surely a document with
t has e beside it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import materialise
from textweave.llm.spans import SPAN, first_from, joined, let, matches, ordered, replaced, valued

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns; a run is entered at its start or right after the last match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def _is_card(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind an array of (start, end, value)."""
    found = {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": matches(text, CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){13}")),
        "phone": matches(text, PHONE, text.rlike(r"\+[0-9][ ().0-9-]+[0-9]")),
    }
    found["ip"] = F.filter(found["ip"], lambda s: _is_ip(s["value"]))
    found["card"] = F.filter(found["card"], lambda s: _is_card(s["value"]))
    found["phone"] = F.filter(found["phone"], lambda s: F.length(_digits(s["value"])).between(10, 15))
    return found


def _terms(text: Column, least: int) -> Column:
    """All words of at least ``least`` letters, case folded, by their place."""
    return F.transform(matches(text, rf"(?<!\p{{L}})\p{{L}}{{{least},}}+", F.lit(True)), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value")))


def _beside(terms: Column, starts: Column, span: Column, window: int) -> Column:
    """The distinct values of ``terms`` that stand wholly within ``window`` code points before or behind ``span``."""
    low, high = first_from(starts, span["start"] - window), first_from(starts, span["end"] + window)
    near = F.filter(F.slice(terms, low + 1, high - low), lambda t: (t["end"] <= span["start"]) | ((t["start"] >= span["end"]) & (t["end"] <= span["end"] + window)))
    return F.array_distinct(F.transform(near, lambda t: t["value"]))


def _entities(text: Column, window: int, least: int) -> Column:
    """(entity, terms) of each base span: the value in a plain form with its kind, and the terms beside it."""

    def tagged(kind: str) -> Column:
        plain = {"email": F.lower, "ip": lambda v: v}.get(kind, _digits)
        return F.transform(F.col(kind), lambda s: F.struct(F.concat(F.lit(f"{kind}:"), plain(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))

    def told(terms: Column, starts: Column) -> Column:
        return F.transform(F.concat(*[tagged(k) for k in KINDS]), lambda e: F.struct(e["entity"].alias("entity"), _beside(terms, starts, e, window).alias("terms")))

    return let(_terms(text, least), lambda terms: let(F.transform(terms, lambda t: t["start"]), lambda starts: told(terms, starts)))


def _found(docs: DataFrame, window: int = 64, least: int = 4, support: int = 3, generalise: float = 0.5, remove: float = 0.9, text_col: str = "text") -> DataFrame:
    """(row, found): each row as a struct, and its spans."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    based = rows.select("row", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    any_ = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    based = based.withColumns({"near": F.when(any_, _entities(F.col("text"), window, least)), "print": F.xxhash64("text"), "text": F.when(any_, F.col("text"))})
    based = materialise(based.withColumn("n", F.monotonically_increasing_id()))

    held = based.filter("near IS NOT NULL")
    near = held.select("n", "print", F.explode(F.col("near")).alias("e")).select("n", "print", "e.entity", "e.terms")
    by_entity = near.select("n", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    told = near.select("n", "print", "entity", F.explode("terms").alias("value")).distinct()
    # one row a document: how many documents, and how many different texts
    pairs = told.groupBy("entity", "value", "print").agg(F.count(F.lit(1)).alias("c")).groupBy("entity", "value").agg(F.sum("c").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    pairs = materialise(pairs.filter(F.col("texts") >= support).drop("texts").join(by_entity, "entity").withColumn("h", F.xxhash64("value")))

    words = F.transform(F.regexp_extract_all(F.lower(F.col("text")), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0)), lambda w: F.xxhash64(w))
    counted = rows.select(F.explode(F.array_distinct(words)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_t"))  # before the join: one row a word and task
    total = docs.count()
    shares = pairs.join(counted, "h").withColumn("ic", F.log2(F.lit(float(max(total, 1))) / F.col("n_e")))
    shares = shares.withColumn("pmi", F.col("ic") + F.log2(F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))))
    shares = shares.filter((F.col("ic") > 0) & (F.col("pmi") >= generalise * F.col("ic")))
    shares = shares.select("entity", "value", F.when(F.col("pmi") >= remove * F.col("ic"), "").otherwise("[TERM]").alias("instead"))
    reveal = told.select("n", "entity", "value").join(shares, ["entity", "value"]).groupBy("n", "value").agg(F.min("instead").alias("instead"))
    places = held.select("n", F.explode(_terms(F.col("text"), least)).alias("t")).select("n", "t.start", "t.end", "t.value")
    spans = places.join(reveal, ["n", "value"]).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("instead").alias("value")))).alias("term"))
    out = based.drop("near", "print", "text").join(spans, "n", "left").withColumn("term", F.coalesce("term", F.array().cast(f"array<{SPAN}>")))
    return out.select("row", F.struct(*KINDS, "term").alias("found"))


def find(docs: DataFrame, keep: list[str], text_col: str = "text", **options) -> DataFrame:
    """The columns ``keep`` of each row, with ``email``, ``ip``, ``card``, ``phone`` and ``term`` (arrays of (start, end, value)).

    A term is a word of ``least`` (4) letters or more (case folded) within ``window`` (64) code points of a
    protected value in at least ``support`` (3) different texts, whatever the number of copies; window and
    support are limits of the method, not of the data: terms farther off, and those of values that stand in
    one or two texts, aren't judged. A term that reveals a value is a span wherever it stands in a document
    with that value. All counts are over all rows of ``docs``. The value of a term span is what replaces
    it: "[TERM]" or, if removed, "". Null text is empty text; an empty table gives an empty table. Rows are
    never merged; repeated rows stay. A kept column that is named like one of the five gives way to it.
    """
    names = (*KINDS, "term")
    slim = docs.select(*dict.fromkeys([*keep, text_col]))
    return _found(slim, text_col=text_col, **options).select(*[F.col(f"row.`{c}`") for c in keep if c not in names], "found.*")


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with protected values replaced by "[KIND]", and revealing terms generalised or removed, in ``text_col``; null text becomes empty, other columns stay, whatever their names."""
    found = _found(docs, text_col=text_col, **options)
    spans = F.concat(*[valued(F.col(f"found.{k}"), f"[{k.upper()}]") for k in KINDS], F.col("found.term"))
    text = replaced(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), spans)
    return found.select("row", text.alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Each document's numbers of base spans, their digest, and all spans with those of terms; as ``find``."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    base = ordered(KINDS, [F.col(k) for k in KINDS])
    every = ordered((*KINDS, "term"), [F.col(k) for k in (*KINDS, "term")])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
