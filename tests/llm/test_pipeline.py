import corpus_pipeline
from lernwerk.llm import exact, mixing, near, pieces, queries
from lernwerk.llm.common import table
from llm_helpers import awkward, empty
from oracle import SMALL
from pyspark.sql import functions as F


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "tokenize"]
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
    ids = {r["doc_id"] for r in table(spark, SMALL, "documents").select("doc_id").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids


def test_stages_keep_columns_and_decide(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
    one = corpus_pipeline.exact_dedup(spark, docs, SMALL)
    lower = F.lower("text")
    assert one.count() == docs.select(lower).distinct().count()
    grouped = near.near_copies(one)
    left = corpus_pipeline.near_dedup(spark, one, SMALL)
    assert left.count() == grouped.select("component_id").distinct().count()
    mixed = corpus_pipeline.mix(spark, left, SMALL)
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    total = left.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert 1.2 < words / total < 1.8


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward(spark), empty(spark)):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{docs.count()}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
        assert now.count() == 0 if docs.isEmpty() else now.count() > 0


def test_operators_have_plain_interfaces(spark):
    docs = table(spark, SMALL, "documents").limit(20)
    assert exact.exact_dedup(docs).columns == [*docs.columns, *exact.RESULTS]
    assert pieces.encode_documents(docs, queries.tokenizer_model()).columns == [*docs.columns, "ids"]
    assert mixing.mixed_documents(docs).columns == docs.columns
