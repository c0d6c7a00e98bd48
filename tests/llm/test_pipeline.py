import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import nearcopy, quality
from lexigrid.llm._io import stored

from .test_dedup import brute_removed


def test_stages_in_turn(spark, put, docs):
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct()
    folder = put(documents=docs, labels=labels)
    at = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        at = stored(stage(spark, at, folder), "test-stage")
        steps.append(at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    first, second, third, fourth, last = steps
    assert first.count() == quality.keep_good(docs, labels).count()
    groups = nearcopy.near_copies(first).select("root").distinct().count()
    assert second.count() == groups
    want = brute_removed([(r["doc_id"], r["text"]) for r in second.collect()], 50)
    words = lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before = {r["doc_id"]: words(r["text"]) for r in second.collect()}
    assert all(list(words(r["text"])) == want[r["doc_id"], before[r["doc_id"]]] for r in third.collect())
    copies = {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 2 and last.count() == fourth.count()
    assert corpus_pipeline.run(spark, folder).count() == last.count()


def test_stages_on_an_empty_table(spark, put, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, put(documents=empty, labels=labels)).count() == 0
