"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern. Their hashes are then counted over the whole corpus by distinct
repositories and owners: a value that many owners hold is a widely copied example, a value of one owner
with enough entropy looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import listed, materialise
from textweave.llm.spans import joined, matches, ordered

KINDS = ("assign", "access", "hex")
#: Possessive forms of the base patterns.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+ *+[:=] *+[\"']?+([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{16,}+"


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind an array of (start, end, value); the value of an assignment is what is assigned."""
    return {
        "assign": F.filter(matches(text, ASSIGN, text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?+ *+[:=]"), 1), lambda s: F.length(s["value"]) >= 12),
        "access": F.filter(matches(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["value"]) >= 18),
        "hex": matches(text, HEX, text.rlike("[0-9a-f]{16}")),
    }


def _entropy(value: Column) -> Column:
    """Bits a character."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))


def _looks_random(value: Column, bits: float) -> Column:
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (_entropy(value) >= bits)


def scan(
    docs: DataFrame, keep: list[str], repository: Column, owner: Column, copied_owners: int = 3, copied_repositories: int = 4, live_repositories: int = 2, live_bits: float = 2.5, text_col: str = "text"
) -> DataFrame:
    """The columns ``keep`` of each row, with arrays ``assign``, ``access``, ``hex``, ``copied`` and ``live`` of (start, end, value).

    A candidate is ``copied`` if its value is held by at least ``copied_owners`` distinct owners or in at
    least ``copied_repositories`` distinct repositories. It is ``live`` if exactly one owner holds it, in at
    most ``live_repositories`` of that owner's repositories, and it has letters, digits and at least
    ``live_bits`` bits of entropy a character. Others are neither. Null text is empty text; a null owner or
    repository counts as one of its own. Repeated rows stay rows of their own and count once. An empty table
    gives an empty table. A kept column that is named like one of the five gives way to it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"), F.coalesce(repository, F.lit("\0")).alias("repo"), F.coalesce(owner, F.lit("\0")).alias("owner"))
    found = rows.select("row", "repo", "owner", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    found = materialise(found.withColumn("n", F.monotonically_increasing_id()))
    each = found.select("n", "repo", "owner", F.explode(F.concat(*KINDS)).alias("s")).select("n", "repo", "owner", "s.*")
    each = each.withColumns({"a": F.xxhash64("value"), "b": F.xxhash64(F.lit(1), "value")})  # 128 bits stand for the value
    held = each.groupBy("a", "b", "owner", "repo").agg(F.first("value").alias("value")).groupBy("a", "b", "owner").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))
    held = held.groupBy("a", "b").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    live = (F.col("owners") == 1) & (F.col("repositories") <= live_repositories) & _looks_random(F.col("value"), live_bits)
    judged = held.withColumn("verdict", F.when(copied, "copied").when(live, "live")).filter("verdict IS NOT NULL").select("a", "b", "verdict")
    spans = each.join(listed(judged), ["a", "b"]).groupBy("n").agg(F.collect_set(F.struct("start", "end", "value", "verdict")).alias("spans"))
    told = found.join(spans, "n", "left")

    def of(verdict: str) -> Column:
        chosen = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,value:string,verdict:string>>")), lambda s: s["verdict"] == verdict)
        return F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    told = told.select("row", *KINDS, of("copied").alias("copied"), of("live").alias("live"))
    return told.select(*[F.col(f"row.`{c}`") for c in keep if c not in told.columns[1:]], *told.columns[1:])


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Each document's numbers of base spans, their digest, and all spans with verdicts; as ``scan``. A source is an owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    # a source is an owner, each of its languages a repository
    found = scan(docs, ["doc_id"], F.concat_ws("/", F.coalesce("source", F.lit("\0")), "lang"), F.col("source"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    names = (*KINDS, "copied", "live")
    return found.select(
        "doc_id", *counts, F.sha2(joined(ordered(KINDS, [F.col(k) for k in KINDS])), 256).alias("base_sha256"), joined(ordered(names, [F.col(k) for k in names])).alias("spans")
    )
