import pytest
from pyspark.sql import functions as F

from lexigrid.lexicon import Lexicon
from lexigrid.operators import expand, retrieve, score
from lexigrid.operators.catalog import build_index
from lexigrid.plans.matcher import candidates, scored_pool, search
from lexigrid.sources import snapshot
from lexigrid.sources import tables as sources

TERMS = [
    ("t1", "nucleus of alpha (core, area 5)", "NA", "", "", "p", "1", 2), ("t2", "alpha tract", "AT", "alt alpha", "", "p", "2", 2), ("t3", "beta cortex, lateral part", "BC", "second", "", "p", "3", 3),
    ("p", "alpha beta region", "ABR", "", "", "", "0", 1), ("t4", "precuneiform field", "PF", "", "", "p", "4", 2), ("t5", "cuneiform field", "CP", "", "", "p", "5", 2), ("t6", "   ", "ZZ", "", "", "", "", 0),
    ("t7", "gamma nucleus", "GN", None, None, "p", "6", 2), ("t8", "visual zone v3a", "VZ", "", "", "p", "7", 2),
]
SCHEMA = "term_id string, name string, acronym string, alt_name string, alt_acronym string, parent_id string, sort_order string, depth int"


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, SCHEMA)


@pytest.fixture(scope="module")
def index(terms):
    return build_index(terms)


@pytest.fixture(scope="module")
def abbrevs(spark):
    return sources.abbreviation_rules(spark.createDataFrame([("cp", "beta cortex"), ("dcn", "deep thing"), ("ec", "outer thing"), ("iii", "third thing")], "abbrev string, expansion string"))


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


def forms(spark, text):
    df = spark.createDataFrame([(text,)], "a string").select(F.posexplode(expand.alias_forms(F.col("a"))).alias("i", "text")).select(F.array("i").alias("ord"), "text")
    return [r["norm"] for r in expand.first_of_each(df.withColumn("k", F.lit(1)), ["k"]).orderBy("ord").collect()]


def test_alias_forms(spark):
    assert forms(spark, "polar cortex (FP, area 10)") == ["polar cortex fp area 10", "polar cortex", "fp", "polar cortex fp", "area 10", "polar cortex area 10", "area 10 polar cortex fp"]
    assert forms(spark, "field (12)") == ["field 12", "field", "12"]
    assert forms(spark, "cortex, upper") == ["cortex upper", "upper cortex"]


def test_aliases_keep_what_tells(index):
    rows = [r["norm"] for r in index.aliases.where("term_id = 't3'").orderBy("alias_ord").collect()]
    assert rows == ["beta cortex lateral part", "lateral part beta cortex", "bc", "second"]
    assert index.aliases.where("term_id = 't6'").count() == 0


def test_abbreviations_in_harmless_company_only(spark, abbrevs):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["caudal cp", "dcn interpositus", "ec iii", "iii", "CP"])], "i int, text string").withColumn("ord", F.array(F.lit(0)))
    out = {}
    for r in expand.abbreviations_expanded(texts, ["i"], abbrevs, Lexicon()).collect():
        out.setdefault(r["i"], set()).add(r["text"])
    assert out == {0: {"caudal cp", "caudal beta cortex"}, 1: {"dcn interpositus"}, 2: {"ec iii"}, 3: {"iii", "third thing"}, 4: {"CP", "beta cortex"}}


def test_rules_do_not_chain(spark):
    rules = sources.alias_rules(spark.createDataFrame([("a", "b", "no"), ("b", "c", "yes"), ("x", "x", "")], "source string, target string, bidirectional string"))
    df = spark.createDataFrame([("a z",)], "text string").withColumn("ord", F.array(F.lit(0))).withColumn("k", F.lit(1))
    assert {r["text"] for r in expand.rewritten(df, ["k"], rules).collect()} == {"a z", "b z"}


def test_variants_are_ordered_and_distinct(spark):
    rows = expand.query_variants(asked(spark, "left Alpha (core) neurons"), Lexicon()).orderBy("variant_ord").collect()
    assert [r["variant_ord"] for r in rows] == list(range(1, len(rows) + 1)) and len({r["norm"] for r in rows}) == len(rows)
    assert rows[0]["variant"] == "left Alpha (core) neurons" and "alpha core" in {r["norm"] for r in rows}


def test_search_end_to_end(spark, index, abbrevs):
    rules = sources.alias_rules(spark.createDataFrame([("alpha nucleus", "nucleus of alpha", "")], "source string, target string, bidirectional string"))
    out = {}
    for r in search(asked(spark, "alpha nucleus", "left beta cortex (lateral)", "precuneiform", "zzz", "cuneiform feild", "", "v3a zone"), index, rules, abbrevs, top_k=3, unanswered=True).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r
    assert out["q0"][1]["term_id"] == "t1" and out["q0"][1]["score"] == 1.0 and "exact" in out["q0"][1]["methods"]
    assert out["q1"][1]["term_id"] == "t3" and out["q1"][1]["modifier_terms"] == "lateral"
    assert out["q2"][1]["term_id"] == "t4"
    assert list(out["q3"]) == [0] == list(out["q5"]) and out["q3"][0]["term_id"] is None
    assert out["q4"][1]["term_id"] == "t5" and out["q4"][2]["score"] < out["q4"][1]["score"]
    assert out["q6"][1]["term_id"] == "t8"
    assert all(sorted(k) == list(range(1, len(k) + 1)) for k in out.values() if 0 not in k)


def test_abbreviation_beats_a_colliding_acronym(spark, index, abbrevs):
    rows = {r["term_id"]: r for r in search(asked(spark, "CP"), index, None, abbrevs).collect()}
    assert rows["t5"]["score"] <= 0.48 and rows["t3"]["score"] > rows["t5"]["score"]


def test_exact_base_and_coverage(spark, index):
    assert search(asked(spark, "alpha tract"), index, coverage="with").select("term_id").collect()[0][0] == "t2"
    assert "t2" not in {r["term_id"] for r in search(asked(spark, "alpha tract"), index, coverage="without").collect()}


def test_candidates_of_each_method(spark, index):
    rows = candidates(asked(spark, "gamma nucleus"), index).collect()
    assert {r["method"] for r in rows if r["term_id"] == "t7"} == {"exact", "fuzzy", "bm25"}
    assert all(r["score"] >= retrieve.THRESHOLD for r in rows if r["method"] == "fuzzy") and all(0 < r["score"] < 1 for r in rows if r["method"] == "bm25")


def test_structure_conflict_is_demoted(spark, index):
    pool = scored_pool(q := asked(spark, "gamma tracts nucleus"), index, candidates(q, index)).where("term_id = 't2'").collect()
    assert not pool or pool[0]["score"] < 0.3


def test_merge_prefers_the_first_of_the_highest(spark):
    rows = [("q", "t", "bm25", 0.9, "b", "mb", 1), ("q", "t", "fuzzy", 0.9, "f", "mf", 2), ("q", "t", "fuzzy", 0.9, "g", "mg", 1)]
    got = score.merged(spark.createDataFrame(rows, "query_id string, term_id string, method string, score double, alias string, matched_query string, variant_ord int")).first()
    assert (got["methods"], got["matched_alias"], got["fuzzy"], got["exact"]) == ("bm25+fuzzy", "g", 0.9, 0.0)


def test_snapshot_round_trip(spark, index, terms, tmp_path):
    of = snapshot.fingerprint(terms)
    snapshot.save(index, f"{tmp_path}/i", of)
    back = snapshot.load(spark, f"{tmp_path}/i", of)
    assert back.entries == index.entries and back.lexicon == index.lexicon
    assert search(asked(spark, "alpha tract"), back).select("term_id", "score").collect() == search(asked(spark, "alpha tract"), index).select("term_id", "score").collect()
    assert snapshot.load(spark, f"{tmp_path}/i", "other") is None
    assert snapshot.fingerprint(terms.orderBy(F.rand())) == of != snapshot.fingerprint(terms.limit(3))


def test_empty_catalog_and_queries(spark, index):
    none = build_index(spark.createDataFrame([], SCHEMA))
    assert search(asked(spark, "x"), none).count() == 0
    assert search(spark.createDataFrame([], "query_id string, query string"), index).count() == 0
