"""Index build: corpus records to documents and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.functions.portable import hashed_shingles
from textweave.functions.text import SHINGLE, normalize, shingle_keys, simhashes, token_hash, tokens, utf8_prefix, words
from textweave.plans.options import BuildOptions


def tasks(spark) -> int:
    """Partitions to deal rows into: those asked for, and at least one a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it comes in fewer partitions than there are cores, as one small file does; large inputs stay where they are."""
    return df.repartition(tasks(df.sparkSession)) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def named(records: DataFrame, segment: Column, ids: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """``documents``, without similarity hashes, of the records that ``ids`` (segment, did) tells of; no other text is touched.

    They are kept before short ones go: the optimizer would move that filter below the join and split every text of the corpus.
    """
    found = records.withColumn("segment", segment).join(ids, ["segment", "did"], "left_semi")
    if records.rdd.getNumPartitions() < records.sparkSession.sparkContext.defaultParallelism:
        found = found.repartition(tasks(records.sparkSession))
    return documents(tokenized(found, options), F.col("segment"), options, simhash=False).persist().filter(F.col("tok_len") >= SHINGLE)


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` bytes (0: all), cut between characters; of text to be normalised a broken last character would become a separator anyway."""
    return text if not most else F.when(F.octet_length(text) > most, utf8_prefix(text, most)).otherwise(text)


def tokenized(records: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """``records`` (doc_id, text, is_normalized, ...) with ``body`` and ``toks``, short documents too."""
    text = clipped(F.col("text"), options.max_text_bytes)
    out = records.withColumn("body", F.when(F.col("is_normalized"), text).otherwise(normalize(text)))
    toks = F.when(F.col("is_normalized"), tokens(text)).otherwise(words(text))
    return out.withColumn("toks", F.slice(toks, 1, options.max_tokens) if options.max_tokens else toks)


def prepare(records: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """``tokenized`` without documents of fewer than nine tokens."""
    return tokenized(records, options).filter(F.size("toks") >= SHINGLE)


def documents(prepared: DataFrame, segment: Column, options: BuildOptions = BuildOptions(), simhash: bool = True) -> DataFrame:
    """The document side of a segment; ``prepared`` has ``did``."""
    external = F.when(F.col("external_id") == "", F.col("doc_id")).otherwise(F.col("external_id"))
    out = prepared.withColumns({"segment": segment, "tok_len": F.size("toks"), "external_id": external, "preview_text": utf8_prefix(F.col("body"), options.preview_bytes)})
    out = out.withColumn("meta_path", F.concat("segment", F.lit("/")))
    columns = ["segment", "did", "tok_len", "doc_id", "organization_id", "external_id", "source_path", "source_name", "meta_path", "preview_text"]
    if simhash:
        out = out.withColumn("_s", simhashes(F.transform("toks", token_hash))).withColumns({"simhash_hi": F.col("_s.hi"), "simhash_lo": F.col("_s.lo")})
        columns[3:3] = ["simhash_hi", "simhash_lo"]
    return out.select(*columns)


def postings(prepared: DataFrame, segment: Column, options: BuildOptions = BuildOptions()) -> DataFrame:
    """(segment, h, did, pos); ``prepared`` may be ``tokenized`` rows, short documents have no postings. With ``exact_hashes`` h is the portable shingle hash, made of whole batches, else a faster one; both are 64 bits, for equality."""
    most = options.max_shingles or 2**31 - 1
    if options.exact_hashes:
        rows = prepared.select(segment.alias("segment"), "did", "toks")
        return rows.mapInArrow(hashed_shingles(options.shingle_stride, most), f"segment string, h bigint, did {rows.schema['did'].dataType.simpleString()}, pos int")
    return shingle_keys(prepared, F.col("toks"), segment.alias("segment"), "did", stride=options.shingle_stride, most=most).select("segment", "h", "did", "pos")
