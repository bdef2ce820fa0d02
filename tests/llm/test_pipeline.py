import corpus_pipeline
from pyspark.sql import functions as F

from storyloom.llm._common import cut


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] == seen[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == seen[-1]


def test_awkward_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some plain words in here", None, "s", 24), (3, "some plain words in here", "en", "s", 24), (3, "some plain words in here", "en", "s", 24), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("print", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
    assert [r.doc_id for r in docs.collect()] == [3]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
    assert docs.count() == 0
