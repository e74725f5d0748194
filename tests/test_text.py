import random

import model
import pyarrow as pa
from pyspark.sql import functions as F

from textweave.functions import text as T
from textweave.functions.portable import hashed_shingles
from textweave.plans.options import parse_bool
from textweave.sources.archive import safe_entry_name


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_normalize_follows_the_model(spark):
    rng = random.Random(1)
    alphabet = "aZ09 _.\t\néßЁІӘҒҚҢӨҰҮҺЀЃЎЅяЯ҃ԯ԰K 日😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)] + ["", " ", "déjà vu"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.normalize(F.col("x")).alias("y"), T.tokens(T.normalize(F.col("x"))).alias("t")).collect()
    assert all(r.y == model.normalize(r.x) and r.t == model.tokens(r.y) for r in rows)


def test_only_spaces_split_text_taken_as_it_is(spark):
    assert one(spark, T.tokens, "A b\tC  d.\n") == ["A", "b\tC", "d.\n"]


def test_hashes_are_bit_exact(spark):
    words = ["a", "слово", "x" * 300, "日本", "0"]
    rows = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", T.token_hash).alias("h"))
    rows = rows.select("h", T.shingle_hash(F.col("h")).alias("s"), T.simhashes(F.col("h")).alias("v")).first()
    want = [model.fnv(w) for w in words]
    assert [h % 2**64 for h in rows.h] == want
    assert rows.s % 2**64 == model.combined(want)
    low = T.SIMHASH_LOW_MASK % 2**64
    assert (rows.v.hi % 2**64, rows.v.lo % 2**64) == (model.simhash(want), model.simhash([h ^ low for h in want]))
    even = spark.createDataFrame([([1, 3, -1, 0], []), ([1, 2, 3], [7])], "a array<long>, b array<long>").select(T.simhashes(F.col("a")).alias("a"), T.simhashes(F.col("b")).alias("b")).collect()
    for r, (a, b) in zip(even, (([1, 3, 2**64 - 1, 0], []), ([1, 2, 3], [7])), strict=True):
        assert [x % 2**64 for x in (*r.a, *r.b)] == [model.simhash([h ^ m for h in hs]) for hs in (a, b) for m in (0, low)]


def test_prefix_ends_between_characters(spark):
    for last in ("a", "é", "日", "😀"):
        for n in range(236, 242):
            text = "x" * n + last * 3
            got = one(spark, lambda c: T.utf8_prefix(c, 240), text)
            want = text.encode()[:240].decode("utf-8", "ignore")
            assert got == want


def test_legacy_encoding(spark):
    data = bytes(range(0x20, 0x100))
    assert one(spark, T.decode_text, bytearray(data), "binary") == data.decode("cp1251", "replace").replace("�", "?")
    assert one(spark, T.decode_text, bytearray("﻿жé".encode()), "binary") == "﻿жé"


def test_entry_names():
    assert [safe_entry_name(n) for n in ("a/../b.txt", "a/b.TXT", "./a")] == [True] * 3
    assert not any(map(safe_entry_name, ("../x", "/x", "a\\b", "", "a/../../x", "a\0b", "..")))


def test_parse_bool():
    assert parse_bool(" YES ", False) and parse_bool("?", True) and not parse_bool("off", True) and not parse_bool(None, False)


def test_portable_hashes_of_batches_follow_the_model():
    rng = random.Random(3)
    words = ["".join(rng.choice("abя日0") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["x" * 3000, "y" * 500]
    texts = [[rng.choice(words) for _ in range(n)] for n in (0, 8, 9, 10, 40, 5, 100)] + [None, words]
    toks = pa.array(texts, pa.list_(pa.string()))
    for stride, most in ((1, 50_000), (3, 4)):
        for cut in (toks, toks.slice(2, 6)):
            batch = pa.RecordBatch.from_arrays([pa.array(["s"] * len(cut)), pa.array(range(len(cut)), pa.int64()), cut], ["segment", "did", "toks"])
            got = [tuple(r.values()) for out in hashed_shingles(stride, most)(iter([batch])) for r in out.to_pylist()]
            want = []
            for did, t in enumerate(cut.to_pylist()):
                h = [model.fnv(w) for w in t or []]
                want += [("s", model.combined(h[p : p + 9]), did, p) for p in list(range(0, len(h) - 8, stride))[:most]]
            assert [(s, h % 2**64, did, p) for s, h, did, p in got] == want


def test_every_shingle_of_a_long_text_is_hashed(spark, tmp_path):
    """Behind 50,000 shingles, 100,000 tokens and 8 MiB too."""
    from textweave.plans.queries import QUERIES

    words = {1: [f"a{i}" for i in range(60_000)], 2: [f"b{i % 997}" for i in range(110_000)], 3: [f"c{i}" for i in range(12)]}
    rows = [(i, ("." * (9 << 20) if i == 3 else "") + " ".join(w)) for i, w in words.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.pos): r.h for r in QUERIES["shingle_hash"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [(i, p) for i, w in words.items() for p in range(len(w) - 8)]
    for i, w in words.items():
        for p in {0, *range(max(0, len(w) - 30), len(w) - 8)}:
            assert got[i, p] == f"{model.combined(map(model.fnv, w[p : p + 9])):016x}"
