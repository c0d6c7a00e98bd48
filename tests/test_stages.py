import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.lexicon import Lexicon
from lexigrid.operators import evaluate, hierarchy
from lexigrid.plans import stages
from lexigrid.sources import tables as sources


def test_preprocess(spark):
    q = spark.createDataFrame([("a", "left BLA neurons excluding x"), ("b", "neurons"), ("c", None)], "query_id string, query string")
    rows = {r["query_id"]: r for r in stages.preprocess(q, Lexicon()).collect()}
    assert rows["a"]["roi_query"] == "left BLA" and {x["text"] for x in rows["a"]["removed"]} == {"neurons", "excluding", "x"}
    assert rows["b"]["roi_query"] == "neurons" and rows["b"]["removed"] == [] == rows["c"]["removed"]


def test_postprocess(spark):
    terms = spark.createDataFrame([("r", ""), ("m", "r"), ("k", "m"), ("z", "")], "term_id string, parent_id string")
    ranked = spark.createDataFrame([("q", "m", 1, 0.97), ("q", "r", 2, 0.5), ("q", "k", 3, 0.4), ("q", "z", 4, 0.3)], "query_id string, term_id string, rank int, score double")
    queries = spark.createDataFrame([("q", "the MX, here"), ("p", "mx")], "query_id string, query string")
    hints = stages.dictionary_hints(queries, spark.createDataFrame([("MX", "m")], "abbrev string, term_id string"))
    assert [(r["query_id"], r["term_id"]) for r in hints.collect()] == [("q", "m")]
    out = {r["term_id"]: r["relation"] for r in stages.postprocess(ranked, hints, hierarchy.ancestors(terms)).collect()}
    assert out == {"m": "'=", "r": ">", "k": "<"}


def test_reviews_and_migration(spark):
    df = spark.createDataFrame([("a", "t1", "one"), ("b", "t3", "big three")], "k string, term_id string, name string")
    accept = spark.createDataFrame([("a", "t1")], "k string, term_id string")
    reject = spark.createDataFrame([("b", "t2", "Three")], "k string, term_id string, target string")
    assert evaluate.reviewed(df, accept, reject, ["k"]).first().asDict() == {"accept_same": 1, "accept_changed": 0, "reject_changed": 1, "target_matched": 1}
    src = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, label string")
    left, right = evaluate.migrated(src, src.limit(0), spark.createDataFrame([("b",)], "k string"), ["k"], "moved")
    assert [r["k"] for r in left.collect()] == ["a"] and [(r["k"], r["label"]) for r in right.collect()] == [("b", "moved")]
    with pytest.raises(ValueError, match="missing"):
        evaluate.migrated(src, src, spark.createDataFrame([("z",)], "k string"), ["k"], "moved")
    order = spark.createDataFrame([("d", "low", 1.0, "B"), ("d", "high", 2.0, "a"), ("d", None, 0.0, "c")], "dataset string, flag string, score double, query string")
    assert [r["query"] for r in evaluate.review_order(order, ["high", "low"]).collect()] == ["a", "B", "c"]


def test_class_majority(spark):
    v = spark.createDataFrame([("k", 1, "a", "suitable", True), ("k", 2, "a", "unsuitable", True), ("m", 1, "a", "suitable", True), ("m", 2, "b", "suitable", False), ("m", 3, "b", "suitable", False)], "key string, pass int, label string, suitability string, class_ok boolean")
    v = v.withColumn("certainty", F.lit("medium")).withColumn("confidence", F.lit(0.9))
    got = {r["key"]: r for r in evaluate.class_majority(v, ["key"]).collect()}
    assert (got["k"]["label"], got["k"]["suitability"], got["k"]["class_ok"]) == ("a", "unsuitable", True)
    assert (got["m"]["label"], got["m"]["suitability"], got["m"]["class_ok"]) == ("b", "suitable", False)


def test_small_forms(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert [value(T.relation_mark(F.lit(x))) for x in ("=", " '=", "<", "~")] == ["'=", "'=", "<", None]
    assert [value(T.prefixed_id(F.lit(x), "C:")) for x in ("12", "AA7", "C:3", "x")] == ["C:12", "C:AA7", "C:3", "x"]
    items = F.array(F.struct(F.lit(" a ").alias("text"), F.lit("Side").alias("kind")), F.struct(F.lit("").alias("text"), F.lit("x").alias("kind")), F.struct(F.lit("b").alias("text"), F.lit("x").alias("kind")))
    assert [tuple(x) for x in value(T.removed_items(items, ["side"]))] == [("a", "side"), ("b", "noise")]
    with pytest.raises(ValueError, match="missing"):
        sources.required(one, ["id", "other"])
    r = sources.ranked_sink(spark.createDataFrame([("a",), ("b",)], "query_id string"), spark.createDataFrame([("a", 1, "t")], "query_id string, rank int, term_id string"))
    assert {tuple(x) for x in r.collect()} == {("a", "1", "t"), ("b", "0", "")}
