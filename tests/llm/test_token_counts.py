import random
import time

import pytest

from textweave.llm import token_counts
from textweave.llm.token_counts import PATTERN, RANKS, Counter, TokenTree, cleaning_edits, count_tokens, counter_of, merged, op8_token_counts


@pytest.fixture(scope="module")
def counter():
    return Counter()


def full(text, counter):
    return len(counter.encoding.encode_ordinary(text))


def test_edits_equal_a_full_recount(counter):
    rng = random.Random(3)
    parts = ["don't", " we'll", "  ", "\n", "word", " word", "12345", "!!", "'", "'l", " ", "\t\n ", "é", "日本", "😀", "x" * 40]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 300)))
        tree = TokenTree(text, counter)
        assert tree.total == full(text, counter)
        for _ in range(6):
            a = rng.randrange(0, len(tree.text) + 1)
            b = min(len(tree.text), a + rng.choice([0, 0, 1, 3, 200]))
            tree.replace(a, b, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 90]))))
            assert tree.total == full(tree.text, counter)


def test_only_the_edited_region_is_encoded(counter):
    tree = TokenTree("some words here " * 5000, counter)
    assert tree.replace(40_000, 40_003, "other") < 10
    assert tree.total == full(tree.text, counter)


def test_count_tokens_rows(spark, counter):
    texts = [None, "", "a 1234567890123456 b!!!! c", "x" * 100_000, "a 1234567890123456 b!!!! c"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in count_tokens(docs).collect():
        text = texts[r.doc_id] or ""
        assert r.n_tokens == full(text, counter)
        for a, b, new in reversed(cleaning_edits(text)):
            text = text[:a] + new + text[b:]
        assert r.n_tokens_edited == full(text, counter)
    assert count_tokens(docs.limit(0)).count() == 0


def test_long_text_in_bounded_memory_and_linear_time(counter):
    """Windows cut anywhere give the same counts; twice the text and edits take about twice the time, and integers are all that stays."""
    rng = random.Random(5)
    parts = ["word", " word", "12345", "!!", " ", "\n\n ", "é", "x" * 300]
    for width in (5, 64, 1000):
        token_counts.WINDOW, before = width, token_counts.WINDOW
        text = "".join(rng.choice(parts) for _ in range(2000))
        assert TokenTree(text, counter).total == full(text, counter)
        token_counts.WINDOW = before
    seconds = []
    for times in (20_000, 40_000):
        text = "some plain words here and then ===== " * times
        began = time.process_time()
        tree = TokenTree(text, counter)
        held = tree.lengths.itemsize * len(tree.lengths) + tree.counts.itemsize * len(tree.counts)
        edits = cleaning_edits(text)
        for start, end, new in reversed(merged(text, edits)):
            tree.replace(start, end, new)
        seconds.append(time.process_time() - began)
        assert len(edits) == times and held <= 2 * len(text)
    assert seconds[1] < 3.5 * seconds[0]


def test_merged_edits_give_the_same_text():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("ab !#-1") * rng.choice([1, 1, 2, 13]) for _ in range(60))
        one = two = text
        for start, end, new in reversed(cleaning_edits(text)):
            one = one[:start] + new + one[end:]
        for start, end, new in reversed(merged(text, cleaning_edits(text))):
            two = two[:start] + new + two[end:]
        assert one == two


def test_one_counter_a_process_however_many_partitions(spark):
    docs = spark.range(422).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(211)
    rows = count_tokens(docs).collect()
    assert len(rows) == 422 and all(r.n_tokens >= 2 for r in rows)
    assert counter_of(RANKS, PATTERN) is counter_of(RANKS, PATTERN)


def test_the_query_counts_every_document(spark, tmp_path, counter):
    texts = [None, "", "Some words, 1234567890123456 ==== here", "same", "same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited, r.n_edits) for r in op8_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: (full(t or "", counter), full((t or "").replace("1234567890123456", "0").replace("====", "="), counter), 2 * (i == 2)) for i, t in enumerate(texts)}
