import pytest
from pyspark.sql import functions as F

from lexigrid.operators import corpus, evaluate, hierarchy, project, rank
from lexigrid.operators.catalog import build_index
from lexigrid.sources import tables as sources
from lexigrid.streaming import batches


def votes(spark, *labels, conf=0.9):
    rows = [("k", i + 1, x, "medium", conf) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "key string, pass int, label string, certainty string, confidence double")


@pytest.mark.parametrize(
    ("labels", "label", "certainty", "split"),
    [(("a", "a", "b"), "a", "medium", "2-1"), (("a", "a", "a"), "a", "high", "3-0"), (("a", "b", "c"), "no_consensus", "low", "1-1-1"), (("a", "a", None), "a", "high", "2-0"), (("a", None, None), "no_consensus", "low", "1-0"), ((None, None, None), "no_consensus", "low", "missing"), (("a", "b", None), "no_consensus", "low", "1-1")],
)
def test_majority(spark, labels, label, certainty, split):
    r = evaluate.majority(votes(spark, *labels), ["key"]).first()
    assert (r["label"], r["certainty"], r["vote_split_pattern"]) == (label, certainty, split)


def test_low_certainty_demotes(spark):
    v = votes(spark, "a", "a", "a").withColumn("certainty", F.lit("low"))
    r = evaluate.majority(v, ["key"]).first()
    assert (r["certainty"], r["uncertainty_tag"], r["agreement"]) == ("medium", "stable+low_certainty", "3/3")


def test_several_majorities_and_escalation(spark):
    v = spark.createDataFrame([("k", 1, "a", "x", 0.9), ("k", 2, "a", "y", 0.9), ("k", 3, "b", "y", 0.9), ("m", 1, "a", "x", 0.9), ("m", 2, "b", "y", 0.9), ("m", 3, "c", "y", 0.9)], "key string, pass int, p string, q string, confidence double")
    got = {r["key"]: r for r in evaluate.majorities(v, ["key"], ["p", "q"]).collect()}
    assert (got["k"]["p"], got["k"]["q"], got["k"]["certainty"]) == ("a", "y", "medium") and got["m"]["p"] == "needs_human_review" == got["m"]["certainty"]
    tier = lambda *rows: spark.createDataFrame(rows, "key string, label string")
    out = {r["key"]: (r["label"], r["tier"]) for r in evaluate.escalated(tier(("a", "x"), ("b", "no_consensus")), tier(("b", "y")), tier(("a", "p"), ("b", "p"), ("c", "p")), ["key"]).collect()}
    assert out == {"a": ("x", "first"), "b": ("y", "second"), "c": ("p", "prior")}


def test_run_comparisons(spark):
    run = lambda *rows: spark.createDataFrame(rows, "k string, v string, s double")
    diff = evaluate.run_diff(run(("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 1.0)), run(("a", "x", 0.0), ("b", "y", 2.0), ("d", "x", 1.0)), ["k"], "v", "s")
    assert {r["k"]: r["status"] for r in diff.collect()} == {"a": "same", "b": "improved", "c": "lost", "d": "new"}
    assert {(r["from"], r["to"]): r["n"] for r in evaluate.transitions(diff).collect()}["x", "y"] == 1
    right = lambda *rows: spark.createDataFrame(rows, "k string, right boolean")
    assert evaluate.flips(right(("a", True), ("b", False)), right(("a", False), ("b", True)), ["k"]).first()["wrong_to_right"] == 1
    problems = evaluate.valid_batch(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",), ("a",), ("z",)], "k string"), "k")
    assert {(r["k"], r["problem"]) for r in problems.collect()} == {("b", "missing"), ("z", "unknown"), ("a", "duplicate")}


def test_guarded_answers(spark):
    answers = spark.createDataFrame([("q", "t1", "'=", 1), ("q", "t1", "<", 2), ("q", "t9", "<", 3), ("q", "t2", "?", 4)], "query_id string, term_id string, relation string, ord int")
    cands = spark.createDataFrame([("q", "t1"), ("q", "t2")], "query_id string, term_id string")
    assert [(r["term_id"], r["relation"]) for r in evaluate.guarded(answers, cands).collect()] == [("t1", "'=")]


def test_percentile_by_place(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(20)], "g string, v double")
    assert evaluate.index_percentile(df, "v", 0.95, ["g"]).first()["p95"] == 19.0


def test_hierarchy(spark):
    t = spark.createDataFrame([("a", ""), ("b", "a"), ("c", "b"), ("x", None)], "term_id string, parent_id string")
    up = hierarchy.ancestors(t)
    assert {(r["term_id"], r["tree_depth"]) for r in hierarchy.tree_depth(up).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", 0)}
    pairs = spark.createDataFrame([("a", "a"), ("c", "a"), ("a", "b"), ("a", "x")], "a string, b string")
    assert {(r["a"], r["b"]): r["relation"] for r in hierarchy.relation(up, pairs).collect()} == {("a", "a"): "'=", ("c", "a"): "<", ("a", "b"): ">", ("a", "x"): None}
    with pytest.raises(ValueError, match="parent"):
        hierarchy.with_extension(t, spark.createDataFrame([("n", "nowhere")], "term_id string, parent_id string"))


def test_corpus_aggregates(spark):
    m = spark.createDataFrame([(1, "A", "", "s1", "p1"), (2, "a", "full", "s2", "p1"), (3, "a", "full", "s2", "p2"), (4, "B", "", "", "")], "o int, name string, fullname string, species string, paper string")
    got = {r["name_key"]: r for r in corpus.name_aggregate(m, ["o"]).collect()}
    assert (got["a"]["display"], got["a"]["fullname"], got["a"]["n_mentions"], got["a"]["n_papers"]) == ("a", "full", 3, 2) and got["b"]["species"] == ""
    e = spark.createDataFrame([("k", "id1", "n1", 1), ("k", "", "n2", 2), ("k", "id2", "n1", 3)], "k string, id string, note string, o int")
    r = corpus.merged_entries(e, ["k"], ["id"], ["note"], "o").first()
    assert (r["id"], r["note"]) == ("id2", "n1 | n2")
    s = spark.createDataFrame([("k", "long surface", False, "x", 1), ("k", "seed", True, "y", 2)], "k string, surface string, seed boolean, source string, o int")
    r = corpus.surface_merge(s, ["k"], "surface", "seed", "source", "o").first()
    assert (r["surface"], r["sources"]) == ("seed", "x; y")
    with pytest.raises(ValueError, match="missing"):
        corpus.must_contain(e, s.withColumn("k", F.lit("other")), ["k"])


def test_species_rows(spark):
    df = spark.createDataFrame([("", ""), ("Mus", "mouse"), ("Danio", "zebrafish"), ("X y", "tree shrew mammal")], "taxon string, common string")
    keep = corpus.allowed_row(F.col("taxon"), F.col("common"), ["fish"], ["mouse"], ["mammal"])
    assert [r["k"] for r in df.select(keep.alias("k")).collect()] == [True, True, False, True]
    names = spark.createDataFrame([("mouse", "Mouse"), ("danio", "Fish")], "key string, value string")
    assert {r["taxon"]: r["out"] for r in corpus.canonical(df, names, "common", "taxon", "out").collect()} == {"": "", "Mus": "Mouse", "Danio": "Fish", "X y": "Tree Shrew Mammal"}


def test_projection(spark):
    hits = spark.createDataFrame([("q", 1, "n1", 0.97, "exact", "other", "n1"), ("q", 2, "n2", 0.96, "exact+fuzzy", "n2", "n2"), ("q", 3, "n3", 0.5, "fuzzy", "n3", "n3")], "query_id string, rank int, name string, score double, methods string, matched_alias string, matched_query string")
    best = project.preferred_hits(hits, 5)
    assert [r["name"] for r in best.collect()] == ["n2"]
    dist = spark.createDataFrame([("n2", 1, "L1", 0.6), ("n2", 2, "L2", 0.4), ("n3", 1, "L1", 0.9)], "lit_name string, rank int, label string, p_raw double")
    out = project.projected(hits.where("rank > 1").withColumnRenamed("name", "lit_name"), dist, "label", 5).orderBy("rank").collect()
    assert [(r["label"], round(r["score"], 3), r["lit_name"]) for r in out] == [("L1", 0.576, "n2"), ("L2", 0.384, "n2")]


def test_ranks_and_quotas(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "g string, v int")
    assert sorted(r["v"] for r in rank.quota_pick(df, "g", {"a": 1, "b": 5}, [F.desc("v")]).collect()) == [2, 3]
    assert [r["v"] for r in rank.diversified(df, F.col("g"), [F.col("v")], 4).collect()] == [1, 3, 4, 2]
    assert [r["id"] for r in rank.sequential_ids(df, [F.col("v")], "AB-%03d").orderBy("v").collect()] == ["AB-001", "AB-002", "AB-003", "AB-004"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿id,name,hierarchy1,hierarchy2,parent\n1,Alpha,x,,\n2,,y,,\n3,Beta,,z,7\n", encoding="utf-8")
    df = sources.read_csv(spark, str(tmp_path / "c.csv"))
    assert df.columns[0] == "id"
    rows = {r["term_id"]: r for r in sources.catalog_rows(df, {"term_id": "id", "name": "name"}).collect()}
    assert set(rows) == {"1", "3"} and rows["1"]["depth"] == 0 and rows["3"]["depth"] == 8 and rows["3"]["more_aliases"] == ["", "z"]
    lex = sources.lexicon_from(spark.createDataFrame([("The", "stopword"), ("left", "laterality"), ("x", "odd")], "term string, kind string"))
    assert lex.stopwords == ("the",) and lex.laterality == ("left",) and lex.weak == ()
    (tmp_path / "l.label").write_text('0 0 "Clear Label"\n1 5 "field one"\n2 6 "Field two"\n3 7 "field one"\nno name\n')
    assert [r["name"] for r in sources.label_file(spark, str(tmp_path / "l.label")).orderBy("ord").collect()] == ["Field one", "Field two"]
    q = spark.createDataFrame([("NAc", "nucleus x"), ("nac", "NAC"), ("", "y")], "structure_name string, fullname string")
    assert {(r["kind"], r["key"]) for r in sources.two_kind_queries(q).collect()} == {("abbrev", "nac"), ("fullname", "nucleus x")}
    assert spark.range(1).select(sources.key_table_name(F.lit("12: area_of_x (AX)")).alias("n")).first()["n"] == "Area of X"


def test_stream_equals_batch(spark, tmp_path):
    from lexigrid.plans.matcher import search

    index = build_index(spark.createDataFrame([("t1", "red ring"), ("t2", "blue bolt")], "term_id string, name string"))
    q = spark.createDataFrame([("a", "red rings"), ("b", "bolt")], "query_id string, query string")
    q.write.parquet(f"{tmp_path}/in")
    batches.match_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in"), index, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["query_id"], r["rank"], r["term_id"], r["score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r["query_id"], r["rank"], r["term_id"], r["score"]) for r in search(q, index).collect()} and got
    assert batches.unseen(q, q.limit(1), ["query_id"]).count() == 1


def test_ancestors_of_a_long_chain_and_a_wide_tree(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}" if i < 199 else "") for i in range(200)], "term_id string, parent_id string")
    up = hierarchy.ancestors(chain)
    assert up.count() == 200 * 201 // 2 and up.where("term_id = 'c0' AND ancestor_id = 'c199'").first()["distance"] == 199
    wide = spark.range(1_200_000).selectExpr("CAST(id AS STRING) AS term_id", "IF(id = 0, '', '0') AS parent_id")
    assert hierarchy.ancestors(wide).count() == 2 * 1_200_000 - 1
    with pytest.raises(ValueError, match="lead back"):
        hierarchy.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "")], "term_id string, parent_id string"))


def test_names_meet_in_nfkc(spark):
    from lexigrid.plans.matcher import search

    index = build_index(spark.createDataFrame([("t", "ﬁber tract²")], "term_id string, name string"))
    out = search(spark.createDataFrame([("q", "fiber tract2"), ("r", "ｆiber ﬁeld")], "query_id string, query string"), index, top_k=1, unanswered=True)
    assert {(r["query_id"], r["term_id"]) for r in out.collect()} >= {("q", "t")}
