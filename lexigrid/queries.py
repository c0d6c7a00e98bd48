"""Queries over the driver's tables that show the operators, each with the same query in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .lexicon import Lexicon
from .operators import corpus, evaluate, expand, hierarchy, project, rank, retrieve, score
from .operators.catalog import Index, build_index, frequencies_of, postings_of, term_aliases, with_defaults
from .plans import matcher
from .session import ready, shared_dir, stored
from .sources import tables as sources

LEX = Lexicon()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL


def norm(x: str) -> str:
    return f"""lower(trim(regexp_replace(regexp_replace(replace(replace(coalesce({x}, ''), '&', ' and '), '/', ' '), '[''`´]', '', 'g'), '[^0-9A-Za-z]+', ' ', 'g')))"""


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def listed(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def tokens(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: NOT list_contains({listed(LEX.stopwords)}, t))"


def grams(x: str, n: int) -> str:
    t = f"replace({norm(x)}, ' ', '')"
    return f"CASE WHEN length({t}) <= {n} THEN list_filter([{t}], lambda g: g <> '') ELSE list_distinct(list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n}))) END"


_NAMES = "(SELECT DISTINCT p_name FROM part)"
#: Aliases of documents: one a document, its whole text.
_POSTINGS = f"""
  docs AS (SELECT doc_id, {tokens("text")} AS toks FROM documents),
  post AS (SELECT doc_id, len(toks) AS dl, t AS token, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS t FROM docs) GROUP BY doc_id, len(toks), t),
  freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
  stat AS (SELECT count(*) AS n, avg(len(toks)) AS m FROM docs),
  asked AS (SELECT item_id, t AS token, min(i) AS pos, count(*) AS qf FROM (SELECT item_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT item_id, {tokens("text")} AS toks FROM benchmark)) GROUP BY item_id, t)"""


def documents_index(spark: SparkSession, sf_dir: str, keep: bool = True) -> Index:
    """Documents as terms with one alias each, their whole text. ``keep``: the tokens are read several times, so they
    are written once."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("term_id"), F.lit(1).alias("alias_ord"), F.col("text").alias("alias"))
    aliases = docs.select("term_id", "alias_ord", T.without(T.split_words(T.normalize(F.col("alias"))), LEX.stopwords).alias("tokens"))
    if keep:
        aliases = stored(aliases, "document-tokens")
    return Index(docs, aliases, postings_of(aliases), frequencies_of(aliases), LEX)


def benchmark_tokens(spark: SparkSession, sf_dir: str, index: Index) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("variant_ord"), F.col("text").alias("variant"), T.normalize(F.col("text")).alias("norm"))
    return retrieve.variant_tokens(b, index)


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_name").distinct()


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as a catalog with parents by their noun."""
    name = F.col("p_name")
    noun = F.element_at(F.split(name, " "), -1)
    leaf = part_names(spark, sf_dir).select(name.alias("term_id"), F.concat(name, F.lit(" ("), F.element_at(F.split(name, " "), 1), F.lit(", part)")).alias("name"), F.upper(F.substring(name, 1, 3)).alias("acronym"), noun.alias("parent_id"))
    top = leaf.select(F.col("parent_id").alias("term_id"), F.col("parent_id").alias("name"), F.lit("").alias("acronym"), F.lit("").alias("parent_id")).distinct()
    return leaf.unionByName(top)


# --- retrieval


@query(f"""WITH {_POSTINGS},
  hit AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) * qf) AS raw
          FROM asked JOIN freq USING (token) JOIN post USING (token), stat GROUP BY item_id, doc_id),
  best AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS doc_id, round(raw / (raw + 4), 9) AS score FROM hit)
  SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 3""")
def q_bm25_topk(spark, sf_dir):
    """The three best documents for each benchmark passage by BM25."""
    index = documents_index(spark, sf_dir)
    hits = retrieve.bm25_hits(benchmark_tokens(spark, sf_dir, index), index).withColumn("score", F.round("score", 9))
    best = rank.top_per_group(hits, ["query_id"], [F.desc("score"), F.col("term_id")], 3)
    return best.select(F.col("query_id").alias("item_id"), F.col("term_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_POSTINGS} SELECT token, CAST(df AS BIGINT) AS df FROM freq""")
def q_doc_freq(spark, sf_dir):
    return documents_index(spark, sf_dir, keep=False).frequencies


@query(f"""WITH {_POSTINGS} SELECT CAST(n AS BIGINT) AS entries, round(m, 6) AS mean_length FROM stat""")
def q_avg_len(spark, sf_dir):
    index = documents_index(spark, sf_dir, keep=False)
    return spark.createDataFrame([(index.entries, round(index.mean_length, 6))], "entries long, mean_length double")


_RAREST = """
  few AS (SELECT * FROM (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), pos) AS r FROM asked LEFT JOIN freq USING (token)) WHERE r <= 2),
  need AS (SELECT item_id, count(*) AS k FROM few GROUP BY item_id),
  inter AS (SELECT item_id, doc_id FROM few JOIN post USING (token) JOIN need USING (item_id) GROUP BY item_id, doc_id, k HAVING count(*) = k)"""


@query(f"""WITH {_POSTINGS}, {_RAREST} SELECT item_id, CAST(doc_id AS VARCHAR) AS doc_id FROM inter""")
def q_rarest2_intersection(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    pairs = retrieve.intersection(retrieve.rarest(benchmark_tokens(spark, sf_dir, index), index.frequencies), index.postings)
    return pairs.select(F.col("query_id").alias("item_id"), F.col("term_id").alias("doc_id"))


@query(f"""WITH {_POSTINGS}, {_RAREST},
  lost AS (SELECT item_id, {norm("text")} AS q FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM inter))
  SELECT item_id, p_name, round(list_aggregate(list_transform({grams("p_name", 2)}, lambda g: CASE WHEN list_contains({grams("q", 2)}, g) THEN 1.0 ELSE 0.0 END), 'avg'), 6) AS shared
  FROM lost, {_NAMES} WHERE len(list_intersect({grams("p_name", 2)}, {grams("q", 2)})) > 0""")
def q_fallback_anti_cross(spark, sf_dir):
    """Passages without an intersection, against the part names that share a bigram."""
    index = documents_index(spark, sf_dir)
    asked = benchmark_tokens(spark, sf_dir, index)
    found = retrieve.intersection(retrieve.rarest(asked, index.frequencies), index.postings).select("query_id").distinct()
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("variant_ord"), F.col("text").alias("variant"), T.normalize(F.col("text")).alias("norm"))
    lost = b.join(found, "query_id", "left_anti")
    pairs = retrieve.gram_pairs(lost, build_index(part_names(spark, sf_dir).select(F.col("p_name").alias("term_id"), F.col("p_name").alias("name"))))
    shared = F.col("shared") / F.size(S.grams(T.normalize(F.col("term_id")), 2))
    return pairs.select(F.col("query_id").alias("item_id"), F.col("term_id").alias("p_name"), F.round(shared, 6).alias("shared"))


@query(f"""WITH {_POSTINGS}, {_RAREST},
  pair AS (SELECT DISTINCT item_id, doc_id FROM few JOIN post USING (token)),
  b AS (SELECT item_id, list_distinct({tokens("text")}) AS bt FROM benchmark), d AS (SELECT doc_id, list_distinct(toks) AS dt FROM docs)
  SELECT item_id, CAST(doc_id AS VARCHAR) AS doc_id, round(len(list_intersect(bt, dt)) / len(list_distinct(list_concat(bt, dt))), 6) AS jaccard FROM pair JOIN b USING (item_id) JOIN d USING (doc_id)""")
def q_token_jaccard(spark, sf_dir):
    """Token Jaccard of passages and the documents that hold one of their two rarest tokens, however frequent."""
    index = documents_index(spark, sf_dir)
    few = retrieve.rarest(benchmark_tokens(spark, sf_dir, index), index.frequencies)
    shared = few.join(index.postings, "token").select("query_id", "term_id").distinct()
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokenize(F.col("text"), LEX)).alias("bt"))
    d = index.aliases.select("term_id", F.array_distinct("tokens").alias("dt"))
    return shared.join(b, "query_id").join(d, "term_id").select(F.col("query_id").alias("item_id"), F.col("term_id").alias("doc_id"), F.round(S.jaccard(F.col("bt"), F.col("dt")), 6).alias("jaccard"))


# --- scalars


@query(f"""SELECT doc_id, md5({norm("text")}) AS digest, CAST(length({norm("text")}) AS BIGINT) AS n FROM documents""")
def q_normalize_text(spark, sf_dir):
    n = T.normalize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"))


@query(f"""SELECT doc_id, CAST(len({tokens("text")}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({tokens("text")})) AS BIGINT) AS n_distinct FROM documents""")
def q_tokenize_stop(spark, sf_dir):
    t = T.tokenize(F.col("text"), LEX)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""SELECT a.p_name AS a, b.p_name AS b, round(2.0 * len(list_intersect({grams("a.p_name", 2)}, {grams("b.p_name", 2)})) / (len({grams("a.p_name", 2)}) + len({grams("b.p_name", 2)})), 6) AS dice
  FROM {_NAMES} a, {_NAMES} b WHERE a.p_name < b.p_name AND len(list_intersect({grams("a.p_name", 2)}, {grams("b.p_name", 2)})) > 0""")
def q_ngrams_dice(spark, sf_dir):
    """Dice of pairs of part names that share a bigram."""
    n = part_names(spark, sf_dir).select("p_name", F.explode(T.ngrams(F.col("p_name"), 2)).alias("gram"))
    pairs = n.toDF("a", "gram").join(n.toDF("b", "gram"), "gram").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("dice", F.round(S.dice(T.ngrams(F.col("a"), 2), T.ngrams(F.col("b"), 2)), 6))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
  SELECT w AS word, p_name, round(least(0.92, length(w) / length(p_name) + 0.25), 6) AS bonus FROM w, {_NAMES} WHERE length(w) >= 4 AND ' ' || p_name || ' ' LIKE '% ' || w || ' %'""")
def q_boundary_contains(spark, sf_dir):
    """Containment bonus of words in part names."""
    names = part_names(spark, sf_dir)
    pairs = names.select("p_name", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    pairs = pairs.withColumn("bonus", F.round(S.containment(F.col("word"), T.normalize(F.col("p_name"))), 6))
    return pairs.where((F.col("bonus") > 0) & S.boundary_contains(F.col("p_name"), F.col("word")))


def _similar_names(spark, sf_dir):
    n = part_names(spark, sf_dir).select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    return n.toDF("a", "w").join(n.toDF("b", "w"), "w").where("a <> b").select("a", "b").distinct()


@query()
def q_sequence_ratio(spark, sf_dir):
    """Ratcliff-Obershelp ratio of part names that share a word."""
    return _similar_names(spark, sf_dir).withColumn("ratio", S.sequence_ratio("a", "b"))


@query()
def q_string_similarity_topk(spark, sf_dir):
    """The three most similar names of each part name."""
    pairs = _similar_names(spark, sf_dir).withColumn("score", F.round(S.string_similarity(F.col("a"), F.col("b"), LEX), 6))
    return rank.top_per_group(pairs, ["a"], [F.desc("score"), F.col("b")], 3)


@query(r"""SELECT conv_id, turn, CAST(len(list_distinct(list_filter(WORDS, lambda t: regexp_full_match(t, '[a-z]{0,3}[0-9]+[a-z]{0,3}')))) AS BIGINT) AS n_ids FROM conversations""".replace("WORDS", words("text")))
def q_area_ids(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.area_ids(F.col("text"))).cast("long").alias("n_ids"))


@query(f"""WITH t AS (SELECT conv_id, turn, {words("text")} AS w FROM conversations),
  f AS (SELECT conv_id, turn, len(list_intersect(w, ['left','l','lh','lt','ipsilateral'])) > 0 AS l, len(list_intersect(w, ['right','r','rh','rt','contralateral'])) > 0 AS r, len(list_intersect(w, ['bilateral','both','b','bl','bilat'])) > 0 AS b FROM t)
  SELECT conv_id, turn, CASE WHEN b AND NOT l AND NOT r THEN 'bilateral' WHEN l AND NOT r THEN 'left' WHEN r AND NOT l THEN 'right' ELSE 'unknown' END AS side FROM f""")
def q_laterality(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.laterality(F.col("text")).alias("side"))


@query(f"""WITH w AS (SELECT DISTINCT t AS w FROM (SELECT unnest({words("text")}) AS t FROM benchmark) WHERE length(t) >= 5)
  SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON left(a.w, 5) = left(b.w, 5) AND a.w < b.w
  WHERE (CASE WHEN length(a.w) <= length(b.w) THEN starts_with(b.w, a.w) ELSE starts_with(a.w, b.w) END) OR (least(length(a.w), length(b.w)) >= 6 AND left(a.w, greatest(6, least(length(a.w), length(b.w)) - 2)) = left(b.w, greatest(6, least(length(a.w), length(b.w)) - 2)))""")
def q_prefix_range_stem(spark, sf_dir):
    """Words of the benchmark that match by stem; such words share their first five letters."""
    w = read(spark, sf_dir, "benchmark").select(F.explode(T.split_words(T.normalize(F.col("text")))).alias("w")).distinct().where(F.length("w") >= 5).withColumn("head", F.left("w", F.lit(5)))
    a, b = w.toDF("a", "head"), w.toDF("b", "head")
    return a.join(b, "head").where("a < b").where(S.stem_match(F.col("a"), F.col("b"))).select("a", "b")


@query("""SELECT event_id, CAST(json_extract_string(regexp_extract(props, '\\{.*\\}'), '$.k') AS BIGINT) AS k FROM events""")
def q_json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json(T.json_object(F.col("props")), "k long")["k"].alias("k"))


# --- expansion and lookup


@query(f"""WITH a AS (SELECT DISTINCT p_name || ' (' || p_type || ', ' || p_brand || ')' AS alias, p_name AS n, p_type AS t, p_brand AS b FROM part),
  f AS (SELECT alias, unnest([alias, n || '  ', t, n || ' ' || t, b, n || ' ' || b, b || ') ' || n || ' (' || t]) AS form FROM a)
  SELECT DISTINCT alias, {norm("form")} AS form FROM f""")
def q_alias_expand(spark, sf_dir):
    """Forms of aliases with a parenthesis of two parts."""
    a = read(spark, sf_dir, "part").select(F.format_string("%s (%s, %s)", "p_name", "p_type", "p_brand").alias("alias")).distinct()
    a = a.select("alias", F.posexplode(expand.alias_forms(F.col("alias"))).alias("i", "text")).select("alias", F.array("i").alias("ord"), "text")
    return expand.first_of_each(a, ["alias"]).select("alias", F.col("norm").alias("form"))


_RULES = [("red", "crimson", "no"), ("large", "big", "yes"), ("ring", "band", "yes"), ("old plate", "antique dish", "no"), ("big", "huge", "yes")]


@query(f"""WITH r(s, t) AS (VALUES ('red', 'crimson'), ('large', 'big'), ('big', 'large'), ('ring', 'band'), ('band', 'ring'), ('old plate', 'antique dish'), ('big', 'huge'), ('huge', 'big'))
  SELECT DISTINCT p_name, v FROM (SELECT p_name, p_name AS v FROM {_NAMES} UNION ALL SELECT p_name, trim(replace(' ' || p_name || ' ', ' ' || s || ' ', ' ' || t || ' ')) FROM {_NAMES}, r WHERE contains(' ' || p_name || ' ', ' ' || s || ' '))""")
def q_rule_theta_join(spark, sf_dir):
    """Part names and what each rule alone makes of them."""
    rules = sources.alias_rules(spark.createDataFrame([(*r, i) for i, r in enumerate(_RULES)], "source string, target string, bidirectional string, o int"), order="o")
    df = part_names(spark, sf_dir).select("p_name", F.array(F.lit(0)).alias("ord"), F.col("p_name").alias("text"))
    return expand.first_of_each(expand.rewritten(df, ["p_name"], rules), ["p_name"]).select("p_name", F.col("norm").alias("v"))


@query(f"""WITH v(q) AS (VALUES ('1 urgent'), ('Not-Specified 4'), ('4/NOT specified'), ('2_high'), ('low'), ('5 LOW'))
  SELECT q, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM v JOIN orders ON {norm("q")} = {norm("o_orderpriority")} GROUP BY q, o_orderpriority""")
def q_exact_lookup(spark, sf_dir):
    """Counts by spellings of a priority that normalize alike."""
    v = spark.createDataFrame([(x, x, 1) for x in ("1 urgent", "Not-Specified 4", "4/NOT specified", "2_high", "low", "5 LOW")], "query_id string, variant string, variant_ord int").withColumn("norm", T.normalize(F.col("variant")))
    n = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    index = build_index(n.select(F.col("o_orderpriority").alias("term_id"), F.col("o_orderpriority").alias("name")))
    return retrieve.exact(v, index).join(n, F.col("term_id") == F.col("o_orderpriority")).select(F.col("query_id").alias("q"), "o_orderpriority", "n")


_ASKED = ["red ring", "large gear", "hot bolt cold", "blue gizmo old", "widget", "zebra crossing"]


@query(f"""WITH v(q) AS (SELECT unnest({listed(_ASKED)})), d AS (SELECT p_name, string_split(p_name, ' ') AS t FROM {_NAMES}),
  s AS (SELECT q, p_name, CASE WHEN q = p_name THEN 1.0 END AS exact, len(list_intersect(string_split(q, ' '), t)) / len(list_distinct(list_concat(string_split(q, ' '), t))) AS jac FROM v, d)
  SELECT q, p_name, CASE WHEN exact IS NULL THEN 'fuzzy' ELSE 'exact+fuzzy' END AS methods, round(greatest(coalesce(exact, 0), jac), 6) AS best FROM s WHERE jac > 0""")
def q_candidate_merge(spark, sf_dir):
    """Exact and token candidates merged: methods and the best score of each pair."""
    names = part_names(spark, sf_dir).select(F.col("p_name").alias("term_id"), F.split("p_name", " ").alias("t"))
    v = spark.createDataFrame([(q,) for q in _ASKED], "query_id string").withColumn("w", F.split("query_id", " "))
    cand = lambda d, m, s: d.select("query_id", "term_id", F.lit(m).alias("method"), s.alias("score"), F.col("term_id").alias("alias"), F.col("query_id").alias("matched_query"), F.lit(1).alias("variant_ord"))
    exact = cand(v.join(names, F.col("query_id") == F.col("term_id")), "exact", F.lit(1.0))
    shared = v.select("query_id", "w", F.explode("w").alias("x")).join(names.select("term_id", "t", F.explode("t").alias("x")), "x").drop("x").distinct()
    both = exact.unionByName(cand(shared, "fuzzy", S.jaccard(F.array_distinct("w"), F.array_distinct("t"))))
    return score.merged(both).select(F.col("query_id").alias("q"), F.col("term_id").alias("p_name"), "methods", F.round("best", 6).alias("best"))


@query()
def q_match_parts(spark, sf_dir):
    """The whole matcher over part names: exact, fuzzy and BM25 candidates, scored and ranked."""
    v = spark.createDataFrame([(q, q) for q in [*_ASKED, "smal rign", "old (gear)"]], "query_id string, query string")
    return matcher.search(v, build_index(part_terms(spark, sf_dir)), top_k=3, unanswered=True)


@query()
def q_aliases_of_parts(spark, sf_dir):
    return term_aliases(with_defaults(part_terms(spark, sf_dir)), LEX).drop("tokens")


@query(f"""WITH v(q) AS (SELECT unnest({listed(_ASKED)})),
  hit AS (SELECT q, p_name, row_number() OVER (PARTITION BY q ORDER BY p_name) AS rank FROM v, {_NAMES} WHERE contains(p_name, q))
  SELECT q, p_name, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM v LEFT JOIN hit USING (q)""")
def q_no_match_left_outer(spark, sf_dir):
    """Part names that contain a query; queries without one have a row of rank 0."""
    v = spark.createDataFrame([(q,) for q in _ASKED], "query_id string")
    hits = part_names(spark, sf_dir).join(F.broadcast(v), F.contains(F.col("p_name"), F.col("query_id")))  # the queries are six
    hits = rank.top_per_group(hits, ["query_id"], [F.col("p_name")], 1 << 30)
    return rank.with_unanswered(v, hits).select(F.col("query_id").alias("q"), "p_name", "rank")


# --- scoring, ranking, picking


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 'no_result' WHEN (p_size - 1) / 49.0 >= 0.9 THEN 'high' WHEN (p_size - 1) / 49.0 >= 0.6 THEN 'review' ELSE 'low' END AS band FROM part""")
def q_score_bands(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", evaluate.score_band((F.col("p_size") - 1) / 49.0).alias("band"))


@query("""SELECT c_nationkey, c_custkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -3) DESC, length(c_mktsegment) DESC, c_custkey % 7 DESC, lower(c_name), c_custkey) AS rank FROM customer) WHERE rank <= 3""")
def q_rank_5key(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("*", F.round("c_acctbal", -3).alias("score"), F.length("c_mktsegment").alias("name_jaccard"), (F.col("c_custkey") % 7).alias("depth"), F.col("c_name").alias("name"), F.col("c_custkey").alias("term_id"))
    return rank.ranked(c, 3, ("c_nationkey",)).select("c_nationkey", "c_custkey", "rank")


@query("""SELECT s_nationkey, s_suppkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, length(s_name) DESC, lower(s_name), s_suppkey) AS rank FROM supplier WHERE s_acctbal > 0) WHERE rank <= 2""")
def q_filter_after_rank(spark, sf_dir):
    """Ranked rows filtered before the limit: the first two suppliers of each nation that are not in debt."""
    s = read(spark, sf_dir, "supplier").select("*", F.col("s_acctbal").alias("score"), F.length("s_name").alias("name_jaccard"), F.lit(0).alias("depth"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("term_id"))
    return rank.ranked(s, 2, ("s_nationkey",), where="s_acctbal > 0").select("s_nationkey", "s_suppkey", "rank")


@query("""SELECT c_mktsegment, c_custkey, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS pick FROM customer)
  WHERE pick <= CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 3 WHEN 'HOUSEHOLD' THEN 8 ELSE 0 END""")
def q_stratified_pick(spark, sf_dir):
    return rank.quota_pick(read(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": 5, "MACHINERY": 3, "HOUSEHOLD": 8}, [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "pick")


@query(f"""SELECT p_name FROM (SELECT p_name, row_number() OVER (PARTITION BY left(lower(p_name), 2) ORDER BY p_name DESC) AS nth FROM {_NAMES}) ORDER BY nth > 1, p_name DESC LIMIT 12""")
def q_diversified_sample(spark, sf_dir):
    """Twelve names: one of each two-letter prefix, then the rest in order."""
    return rank.diversified(part_names(spark, sf_dir), F.left(F.lower("p_name"), F.lit(2)), [F.desc("p_name")], 12)


# --- distributions and indexes


@query(f"""WITH d AS (SELECT p_name, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, p_brand),
  p AS (SELECT p_name, p_brand, q / sum(q) OVER (PARTITION BY p_name) AS p_raw FROM d), v(query_id, noun) AS (VALUES ('q1', 'ring'), ('q2', 'gizmo')),
  h AS (SELECT query_id, p_name, 1.0 / row_number() OVER (PARTITION BY query_id ORDER BY p_name) AS score FROM v JOIN {_NAMES} ON ends_with(p_name, ' ' || noun)),
  m AS (SELECT query_id, p_brand, max(score * p_raw) AS score FROM h JOIN p USING (p_name) GROUP BY query_id, p_brand)
  SELECT query_id, p_brand, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_brand) AS rank FROM m) WHERE rank <= 5""")
def q_distribution_join(spark, sf_dir):
    """Brands of the names that a query hits, by match score times the brand's share of the name's quantity."""
    from pyspark.sql.window import Window

    sold = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name", "p_brand").agg(F.sum("l_quantity").alias("q"))
    dist = sold.select(F.col("p_name").alias("lit_name"), "p_brand", (F.col("q") / F.sum("q").over(Window.partitionBy("p_name"))).alias("p_raw"))
    v = spark.createDataFrame([("q1", "ring"), ("q2", "gizmo")], "query_id string, noun string")
    hits = part_names(spark, sf_dir).withColumn("noun", F.element_at(F.split("p_name", " "), -1)).join(v, "noun").withColumnRenamed("p_name", "lit_name")
    hits = rank.top_per_group(hits, ["query_id"], [F.col("lit_name")], 1 << 30).withColumn("score", 1.0 / F.col("rank"))
    return project.projected(hits.select("query_id", "rank", "lit_name", "score"), dist, "p_brand", 5).select("query_id", "p_brand", F.round("score", 6).alias("score"), "rank")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS r FROM events) WHERE r = 1""")
def q_hemi_prefer(spark, sf_dir):
    """A user's first purchase, else the first event."""
    return project.prefer_value(read(spark, sf_dir, "events"), ["user_id"], "event_type", "purchase", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1)
  SELECT c_custkey, coalesce(CAST(o_orderkey AS VARCHAR), '') AS top_order, coalesce(n_name, '') AS nation FROM customer LEFT JOIN t ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def q_rank1_left_joins(spark, sf_dir):
    top = rank.first_row(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    out = read(spark, sf_dir, "customer").join(top, F.col("o_custkey") == F.col("c_custkey"), "left").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("c_custkey", F.coalesce(F.col("o_orderkey").cast("string"), F.lit("")).alias("top_order"), F.coalesce("n_name", F.lit("")).alias("nation"))


# --- corpus


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id, event_type)) WHERE r = 1""")
def q_mode_first_seen(spark, sf_dir):
    return corpus.first_seen_mode(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["event_id"])


@query("""SELECT side, name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM (SELECT o_custkey, 0 AS side, o_orderstatus AS name FROM orders UNION ALL SELECT o_custkey, 1, o_orderpriority FROM orders) GROUP BY side, name""")
def q_unpivot_agg(spark, sf_dir):
    m = corpus.mentions(read(spark, sf_dir, "orders"), [("o_orderstatus", "o_orderpriority"), ("o_orderpriority", "o_orderstatus")], ["o_custkey"])
    return m.groupBy("side", "name").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""WITH f AS (SELECT doc_id, regexp_matches(text, '[0-9]{3}\\.[0-9]{3}\\.[0-9]{3}\\.[0-9]{3}') AS ip, contains(text, ' | ') AS tab, regexp_matches(text, '!!') AS loud, length(text) < 300 AS short FROM documents)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN ip THEN 'ip' END, CASE WHEN tab THEN 'table' END, CASE WHEN loud THEN 'loud' END, CASE WHEN short THEN 'short' END], lambda x: x IS NOT NULL), '+') AS flags,
    CASE WHEN loud OR tab THEN 'unsuitable' WHEN ip THEN 'review' ELSE 'suitable' END AS label, CASE WHEN loud OR tab THEN 'noise' WHEN ip THEN 'private' ELSE '' END AS reason FROM f""")
def q_rule_flags(spark, sf_dir):
    """Flags of documents, and the label of the first rule that holds."""
    t = F.col("text")
    found = corpus.flags([("ip", t.rlike(r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}\.[0-9]{3}")), ("table", F.contains(t, F.lit(" | "))), ("loud", t.rlike("!!")), ("short", F.length(t) < 300)])
    df = read(spark, sf_dir, "documents").select("doc_id", found.alias("f"))
    c = corpus.cascade(F.col("f"), [(["loud", "table"], "unsuitable", "noise"), (["ip"], "review", "private")], ("suitable", ""))
    return df.select("doc_id", F.array_join("f", "+").alias("flags"), c["label"].alias("label"), c["reason"].alias("reason"))


@query("""SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, NULL AS is_region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, true FROM region""")
def q_overlay_union(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(True).alias("is_region"))
    return corpus.overlay(n, r)


@query(f"""WITH e AS (SELECT DISTINCT unnest({words("text")}) AS w FROM documents), f AS (SELECT DISTINCT unnest({words("text")}) AS w FROM benchmark)
  SELECT 'both' AS side, CAST(count(*) AS BIGINT) AS n FROM (SELECT w FROM e INTERSECT SELECT w FROM f) UNION ALL SELECT 'documents', count(*) FROM (SELECT w FROM e EXCEPT SELECT w FROM f) UNION ALL SELECT 'benchmark', count(*) FROM (SELECT w FROM f EXCEPT SELECT w FROM e)""")
def q_set_ops(spark, sf_dir):
    """Words of documents and of benchmark passages: in both, and in one alone."""
    w = lambda name: read(spark, sf_dir, name).select(F.explode(F.array_distinct(T.split_words(T.normalize(F.col("text"))))).alias("w"))
    n = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    e, f = w("documents"), w("benchmark")
    return n(e.intersect(f), "both").unionByName(n(e.subtract(f), "documents")).unionByName(n(f.subtract(e), "benchmark"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def q_semi_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).unionAll(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("has_orders")))


# --- hierarchy


def _tree(spark, sf_dir):
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("term_id"), F.lit("").alias("parent_id"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("term_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("term_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return r.unionAll(n).unionAll(c)


_TREE = """t AS (SELECT 'r' || r_regionkey AS id, '' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT id AS term_id, id AS ancestor_id, 0 AS distance FROM t UNION ALL SELECT up.term_id, t.parent, up.distance + 1 FROM up JOIN t ON t.id = up.ancestor_id WHERE t.parent <> '')
  SELECT term_id, ancestor_id, CAST(distance AS INTEGER) AS distance FROM up""")
def q_hierarchy_recursive(spark, sf_dir):
    return hierarchy.ancestors(_tree(spark, sf_dir))


@query("""WITH h AS (SELECT c_custkey, c_nationkey, least(1.0, c_acctbal / 10000) AS score, 'q' || c_custkey % 3 AS query_id FROM customer)
  SELECT query_id, c_nationkey AS nation, CAST(count(*) AS BIGINT) AS children, round(CASE WHEN max(score) >= 0.62 AND max(score) < 0.82 THEN max(score) - 0.03 ELSE least(max(score) + 0.08, 0.97) END, 6) AS score FROM h GROUP BY query_id, c_nationkey HAVING count(*) >= 2""")
def q_parent_promotion(spark, sf_dir):
    """Nations that several of a query's customers share, scored from the best of them."""
    c = read(spark, sf_dir, "customer")
    hits = c.select(F.concat(F.lit("q"), F.col("c_custkey") % 3).alias("query_id"), F.lit("nation").alias("query"), F.concat(F.lit("c"), "c_custkey").alias("term_id"), F.least(F.lit(1.0), F.col("c_acctbal") / 10000).alias("score"))
    terms = _tree(spark, sf_dir).withColumn("name", F.lit("nation"))
    up = hierarchy.common_parents(hits, terms, S.jaccard(F.split("query", " "), F.split("name", " ")))
    return up.select("query_id", F.expr("substring(term_id, 2)").cast("int").alias("nation"), "children", F.round("score", 6).alias("score"))


# --- votes and runs


_VOTES = """v AS (SELECT user_id, event_type AS label, 4 - r AS pass, round(value / 100, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3)"""


def _votes(spark, sf_dir, first=1):
    e = rank.top_per_group(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], first + 2, "r").where(F.col("r") >= first)
    return e.select("user_id", F.col("event_type").alias("label"), (3 + first - F.col("r")).alias("pass"), F.round(F.col("value") / 100, 4).alias("confidence"), F.lit("medium").alias("certainty"))


@query(f"""WITH {_VOTES}, l AS (SELECT user_id, label, count(*) AS n, min(pass) AS f FROM v GROUP BY user_id, label),
  m AS (SELECT user_id, sum(n) AS n, max(n) AS c, arg_min(label, -n * 10 + f) AS lead, count(*) AS labels FROM l GROUP BY user_id)
  SELECT user_id, CASE WHEN n >= 2 AND c >= 2 THEN lead ELSE 'no_consensus' END AS label, CASE WHEN n >= 3 THEN CASE WHEN c = 3 THEN '3-0' WHEN c = 2 THEN '2-1' ELSE '1-1-1' END WHEN n = 2 THEN CASE WHEN c = 2 THEN '2-0' ELSE '1-1' END ELSE '1-0' END AS split, labels > 1 AS disagreement FROM m""")
def q_vote_majority(spark, sf_dir):
    """A user's last three event types as votes."""
    return evaluate.majority(_votes(spark, sf_dir), ["user_id"]).select("user_id", "label", F.col("vote_split_pattern").alias("split"), F.col("has_disagreement").alias("disagreement"))


_TIER = """(SELECT user_id, CASE WHEN max(n) >= 2 THEN arg_max(label, n) END AS label FROM (SELECT user_id, label, count(*) AS n FROM (SELECT user_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r BETWEEN {} AND {} GROUP BY user_id, label) GROUP BY user_id)"""


@query(f"""WITH a AS {_TIER.format(1, 3)}, b AS {_TIER.format(4, 6)}, c AS (SELECT user_id, min(event_type) AS label FROM events GROUP BY user_id)
  SELECT c.user_id, coalesce(a.label, b.label, c.label) AS label, CASE WHEN a.label IS NOT NULL THEN 'first' WHEN b.label IS NOT NULL THEN 'second' ELSE 'prior' END AS tier FROM c LEFT JOIN a ON a.user_id = c.user_id LEFT JOIN b ON b.user_id = c.user_id""")
def q_vote_escalation(spark, sf_dir):
    """The last three votes decide, else the three before, else the least event type."""
    prior = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("label"))
    return evaluate.escalated(evaluate.majority(_votes(spark, sf_dir), ["user_id"]), evaluate.majority(_votes(spark, sf_dir, 4), ["user_id"]), prior, ["user_id"])


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'all' END AS level, o_orderstatus AS label, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""")
def q_label_rollup(spark, sf_dir):
    return evaluate.label_counts(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "label"), ["o_orderpriority"])


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS good, round(CASE WHEN count(CASE WHEN quality = 1 THEN 1 END) = 0 THEN 0.0 ELSE count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) / count(CASE WHEN quality = 1 THEN 1 END) END, 6) AS toxic_of_good FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def q_hit_rates(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.round(evaluate.rate(good), 6).alias("good"), F.round(evaluate.rate(toxic, good), 6).alias("toxic_of_good"))


_RUN = "(SELECT user_id, arg_max(event_type, ts) AS v, count(*) AS s FROM events, half WHERE epoch_us(ts) {} cut GROUP BY user_id)"


@query(f"""WITH half AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS cut FROM events)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS old_value, b.v AS new_value, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'lost' WHEN a.v = b.v THEN 'same' WHEN b.s > a.s THEN 'improved' WHEN b.s < a.s THEN 'regressed' ELSE 'changed' END AS status FROM {_RUN.format('<')} a FULL JOIN {_RUN.format('>=')} b ON a.user_id = b.user_id""")
def q_run_diff_full_outer(spark, sf_dir):
    """Two runs, over the events of the first and the second half of the time, compared by user."""
    events = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    cut = events.agg(F.expr("(min(t) + max(t)) div 2").alias("cut"))  # one row
    sides = events.join(F.broadcast(cut))
    run = lambda d: d.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("v"), F.count("*").alias("s"))
    return evaluate.run_diff(run(sides.where("t < cut")), run(sides.where("t >= cut")), ["user_id"], "v", "s").select("user_id", "old_value", "new_value", "status")


@query("""SELECT l_returnflag AS flag, round(sum(l_quantity * a / 1e6 + l_extendedprice * b / 1e6), 4) AS cost FROM lineitem JOIN (VALUES ('A', 120.0, 2.5), ('N', 80.0, 1.5), ('R', 200.0, 0.5)) r(f, a, b) ON l_returnflag = f GROUP BY l_returnflag""")
def q_cost_weighted_sum(spark, sf_dir):
    prices = spark.createDataFrame([("A", 120.0, 2.5), ("N", 80.0, 1.5), ("R", 200.0, 0.5)], "flag string, price_l_quantity double, price_l_extendedprice double")
    out = evaluate.weighted_cost(read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), prices, "flag", ["l_quantity", "l_extendedprice"])
    return out.select("flag", F.round("cost", 4).alias("cost"))


@query("""SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = CAST(floor(n * 0.95) AS BIGINT) + 1""")
def q_index_percentile(spark, sf_dir):
    return evaluate.index_percentile(read(spark, sf_dir, "events"), "value", 0.95, ["event_type"])


@query("""SELECT p_type, CAST(sum(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS BIGINT) AS "Brand#1", CAST(sum(CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END) AS BIGINT) AS "Brand#2", CAST(sum(CASE WHEN p_brand = 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM part GROUP BY p_type""")
def q_contingency(spark, sf_dir):
    return evaluate.contingency(read(spark, sf_dir, "part"), "p_type", "p_brand", ["Brand#1", "Brand#2"])


@query(f"""WITH v AS (SELECT DISTINCT p_name AS q FROM part), w AS (SELECT p_name, string_split(p_name, ' ') AS t FROM {_NAMES}),
  p AS (SELECT q, p_name, len(list_intersect(string_split(q, ' '), t)) / len(list_distinct(list_concat(string_split(q, ' '), t))) AS overlap FROM v, w)
  SELECT q, p_name, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, p_name) AS r FROM p WHERE overlap > 0) WHERE r <= 6""")
def q_nearest_by_tokens(spark, sf_dir):
    names = part_names(spark, sf_dir)
    out = evaluate.nearest_by_tokens(names.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")), names.select(F.col("p_name").alias("term_id"), F.col("p_name").alias("name")))
    return out.select(F.col("query_id").alias("q"), F.col("term_id").alias("p_name"), F.round("overlap", 6).alias("overlap"))


_SEEN = "e AS (SELECT event_id AS o, event_type AS name, 'f' || user_id % 3 AS fullname, 's' || user_id % 2 AS species, 'p' || user_id % 7 AS paper FROM events)"


def _mode(c: str) -> str:
    return f"(SELECT name, arg_min({c}, -n * 1000000000 + f) AS {c} FROM (SELECT name, {c}, count(*) AS n, min(o) AS f FROM e GROUP BY name, {c}) GROUP BY name)"


@query(f"""WITH {_SEEN} SELECT a.name AS name_key, a.name AS display, m1.fullname, m2.species, m3.paper, CAST(n AS BIGINT) AS n_mentions, CAST(k AS BIGINT) AS n_papers
  FROM (SELECT name, count(*) AS n, count(DISTINCT paper) AS k FROM e GROUP BY name) a JOIN {_mode("fullname")} m1 ON m1.name = a.name JOIN {_mode("species")} m2 ON m2.name = a.name JOIN {_mode("paper")} m3 ON m3.name = a.name""")
def q_name_aggregate(spark, sf_dir):
    """Counts and first-seen modes by name."""
    u = F.col("user_id")
    tag = lambda c, n: F.concat(F.lit(c), u % n)
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("o"), F.col("event_type").alias("name"), tag("f", 3).alias("fullname"), tag("s", 2).alias("species"), tag("p", 7).alias("paper"))
    return corpus.name_aggregate(e, ["o"])


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(hot|cold) ') THEN 'temperature' WHEN regexp_matches(p_name, 'ing$') THEN 'ring' WHEN regexp_matches(p_name, '^[a-m]') THEN 'early' ELSE 'other' END AS bucket FROM part""")
def q_problem_bucket(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", evaluate.bucket(F.col("p_name"), [("^(hot|cold) ", "temperature"), ("ing$", "ring"), ("^[a-m]", "early")], "other").alias("bucket"))


@query("""SELECT 'c' || c_custkey AS a, 'n' || c_custkey % 25 AS b, CASE WHEN c_nationkey = c_custkey % 25 THEN '<' END AS relation FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, '>' FROM nation""")
def q_relation(spark, sf_dir):
    """Relation of pairs in the tree of regions, nations and customers."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), F.col("c_custkey") % 25).alias("b"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return hierarchy.relation(hierarchy.ancestors(_tree(spark, sf_dir)), c.unionAll(n))


@query("""SELECT c_mktsegment, c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 40 AS INTEGER) AS batch FROM customer""")
def q_batching(spark, sf_dir):
    return corpus.batches(read(spark, sf_dir, "customer"), [F.col("c_custkey")], 40, ["c_mktsegment"]).select("c_mktsegment", "c_custkey", "batch")


@query("""WITH a AS (SELECT user_id, arg_max(event_type, ts) AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, arg_max(event_type, ts) AS v FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
  SELECT a.v AS "from", b.v AS "to", CAST(count(*) AS BIGINT) AS n FROM a JOIN b USING (user_id) GROUP BY a.v, b.v""")
def q_transitions(spark, sf_dir):
    """Label transitions between two runs."""
    run = lambda half: read(spark, sf_dir, "events").where(f"event_id % 2 = {half}").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("v"))
    return evaluate.transitions(evaluate.run_diff(run(0), run(1), ["user_id"], "v").where("status IN ('same', 'changed')"))


@query("""SELECT o_orderpriority AS key, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'accept' WHEN o_orderpriority = '3-MEDIUM' THEN 'review' ELSE 'reject' END AS route, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority""")
def q_routed(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "key")
    k = F.col("key")
    return evaluate.routed(o, [("accept", k.isin("1-URGENT", "2-HIGH")), ("review", k == "3-MEDIUM")], "reject").groupBy("key", "route").agg(F.count("*").alias("n"))


@query(f"""SELECT lower(host) AS key, CAST(min(page_id) AS BIGINT) AS page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) WHERE host <> '' GROUP BY lower(host)""")
def q_surface_list(spark, sf_dir):
    """Hosts of pages, case-folded, with the first page of each."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    return sources.surface_list(p, "host", "page_id").select("key", "page_id")


@query()
def q_stream_foreach_batch(spark, sf_dir):
    """Part names as a stream of queries through the matcher, read back."""
    import uuid

    from .streaming.batches import match_stream

    base = f"{shared_dir(ready(spark))}/stream-{uuid.uuid4().hex}"
    part_names(spark, sf_dir).select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("query_id string, query string").parquet(f"{base}/in")
    match_stream(stream, build_index(part_terms(spark, sf_dir)), f"{base}/out", f"{base}/state", top_k=1).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
