import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_hand_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()
    single = corpus_pipeline.near_dedup(spark, docs, SF)
    assert single.columns == docs.columns and single.groupBy("text").count().filter("count > 1").count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns) and out.filter("shard NOT BETWEEN 0 AND 7").count() == 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() > 0


def test_odd_tables_pass_through(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "some clean words", None, "s", 16)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert set(odd.columns) <= set(out.columns) and 2 in [r.doc_id for r in out.collect()], name
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_what_the_operator_calls_toxic_is_rejected(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", 0.29), (2, "b", 0.3), (3, "c", 0.4), (4, "d", 0.6)], "doc_id long, text string, score double")
    monkeypatch.setattr(corpus_pipeline, "train", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "score", lambda docs, _: docs)
    assert [r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SF).collect()] == [1]
