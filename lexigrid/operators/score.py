"""From candidates of several methods to one scored row per query and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as S
from ..functions import text as T
from ..lexicon import GROUP_CUES, POSITIONAL, REGION_ANCHORS, Lexicon

METHODS = ("exact", "fuzzy", "bm25")


def merged(candidates: DataFrame) -> DataFrame:
    """(query_id, term_id, methods, exact, fuzzy, bm25, best, matched_alias, matched_query, seen_queries).

    The best row is the first of the highest score, methods in the order exact, fuzzy, bm25.
    """
    place = F.array_position(T.words_array(METHODS), F.col("method"))
    first = F.min(F.struct((-F.col("score")).alias("s"), place.alias("m"), "variant_ord", "alias", "matched_query"))
    top = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("score"))), F.lit(0.0)).alias(m)
    out = candidates.groupBy("query_id", "term_id").agg(
        F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"), *map(top, METHODS), first.alias("b"), F.collect_set(T.normalize(F.col("matched_query"))).alias("seen_queries")
    )
    return out.select("query_id", "term_id", "methods", *METHODS, (-F.col("b.s")).alias("best"), F.col("b.alias").alias("matched_alias"), F.col("b.matched_query").alias("matched_query"), "seen_queries")


def with_flags(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Whether a row came by the bare abbreviation (via_raw), or by its expansion and not bare (via_expansion)."""
    overlap = S.content_overlap(F.col("expansion_content"), F.col("alias_content"))
    raw = F.coalesce("raw_abbrev", F.lit(""))
    bare = lambda q: (raw != "") & ((q == raw) | (F.array_contains(T.split_words(q), raw) & ~overlap))
    spelled = lambda q: (raw != "") & (F.size("expansions") > 0) & (q != "") & (q != raw) & overlap & ~bare(q)
    return df.withColumn("via_raw", F.exists("seen_queries", bare)).withColumn("via_expansion", F.exists("seen_queries", spelled))


def with_pool(df: DataFrame) -> DataFrame:
    """What all candidates of a query decide together: support for the expansion, and the directions that resolve."""
    pool = Window.partitionBy("query_id")
    strong = (F.col("best") >= 0.96) | (F.col("exact") > 0)
    df = df.withColumn("expansion_exact", F.bool_or(F.col("via_expansion") & strong).over(pool))
    df = df.withColumn("expansion_soft", F.bool_or(F.col("via_expansion") & ~strong & (F.col("best") >= 0.45)).over(pool))
    own = F.when(S.content_overlap(F.col("query_content"), F.col("alias_content")), F.array_intersect("positional", "alias_tokens_all")).otherwise(F.array().cast("array<string>"))
    return df.withColumn("resolvable", F.array_distinct(F.flatten(F.collect_set(own).over(pool))))


def scored(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds ``score`` and ``modifier_match_score``. Steps follow one another; each changes the score so far."""
    q, mq = F.col("score_query"), T.text_of(F.col("matched_query"))
    s = F.col("s")
    inexact = F.col("exact") == 0
    step = lambda d, e: d.withColumn("s", e)
    df = df.withColumn("score_query", F.when(F.col("via_expansion") & (T.stripped(F.col("matched_query")) != ""), T.stripped(F.col("matched_query"))).otherwise(T.text_of(F.col("query"))))
    df = df.withColumn("q_tokens", F.array_distinct(T.tokenize(q, lexicon))).withColumn("m_tokens", F.array_distinct(T.tokenize(mq, lexicon)))
    df = df.withColumn("token_score", F.coalesce(F.array_max(F.transform("alias_tokens", lambda t: S.jaccard(F.col("q_tokens"), t))), F.lit(0.0)))
    t, f, b = F.col("token_score"), F.col("fuzzy"), F.col("bm25")
    base = F.greatest(F.col("exact"), 0.5 * f + 0.3 * b + 0.2 * t, 0.75 * f + 0.25 * t)
    df = step(df, F.when(F.col("exact") > 0, F.greatest(base, F.lit(0.96))).otherwise(base))
    noncontent = T.words_array(lexicon.noncontent)
    df = df.withColumn("both_content", F.array_union(T.content_tokens(q, lexicon), T.content_tokens(mq, lexicon)))
    df = df.withColumn("shared_tokens", F.array_intersect(F.array_union("q_tokens", "m_tokens"), F.col("alias_tokens_all")))
    weak = inexact & (F.size("both_content") > 0) & ~S.content_overlap(F.col("both_content"), F.col("alias_content"))
    weak = weak & (F.size("shared_tokens") > 0) & F.forall("shared_tokens", lambda x: F.array_contains(noncontent, x))
    df = df.withColumn("weak_only", weak)
    positional = T.words_array(POSITIONAL)

    def effective(term: Column) -> Column:
        words = T.split_words(T.normalize(term))
        return F.exists(words, lambda x: ~F.array_contains(positional, x)) | ((F.size(words) > 0) & F.forall(words, lambda x: F.array_contains(F.col("resolvable"), x)))

    df = df.withColumn("effective", F.filter("modifier_terms", effective))
    df = df.withColumn("eff", S.modifier_match(F.col("effective"), F.col("alias_text")))
    df = step(df, F.when(F.size("effective") == 0, s).when(F.col("eff") > 0, F.least(s + 0.12 * F.col("eff"), F.lit(1.0))).otherwise(F.least(0.88 * s, F.lit(0.88))))
    extra = F.size(F.array_except("alias_specific", T.specificity_terms(q, lexicon))) > 0
    df = step(df, F.when(inexact & (F.size("effective") == 0) & (F.col("parent_id") != "") & extra, 0.86 * s).otherwise(s))
    df = df.withColumn("q_areas", T.area_keys(F.array_union(T.area_ids(q), T.area_ids(mq)))).withColumn("c_areas", T.area_keys(F.col("alias_areas")))
    shared = F.array_intersect("q_areas", "c_areas")
    both = inexact & (F.size("q_areas") > 0) & (F.size("c_areas") > 0)
    coded = F.exists(shared, lambda k: ~F.startswith(k, F.lit(":")))
    df = step(df, F.when(both & (F.size(shared) == 0), 0.40 * s).when(both & coded, F.least(s + 0.08, F.lit(1.0))).otherwise(s))
    own_head = T.structure_head(T.split_words(T.normalize(F.when(mq != "", mq).otherwise(q))))
    df = df.withColumn("own_head", own_head).withColumn("term_head", T.structure_head(T.split_words(T.normalize(F.col("name")))))
    df = step(df, F.when(inexact & F.coalesce(F.col("own_head") != F.col("term_head"), F.lit(False)), 0.50 * s).otherwise(s))
    df = step(df, F.when(inexact & S.affix_mismatch(F.col("both_content"), F.col("alias_content")), 0.62 * s).otherwise(s))
    anchors = F.array_intersect(F.array_union("q_tokens", "m_tokens"), T.words_array(REGION_ANCHORS))
    missing = F.exists(anchors, lambda a: ~F.array_contains(F.col("alias_tokens_all"), a) & ~F.contains(F.col("alias_text"), a))
    df = step(df, F.when(inexact & missing, 0.48 * s).otherwise(s))
    name = T.normalize(F.col("name"))
    grouped = F.lit(False)
    for cue in GROUP_CUES:
        grouped = grouped | F.contains(name, F.lit(cue))
    plural = F.array_contains(T.split_words(T.normalize(q)), "nuclei") & ~grouped & F.array_contains(T.split_words(name), "nucleus")
    df = step(df, F.when(inexact & plural, 0.72 * s).otherwise(s))
    df = step(df, F.when(F.col("weak_only"), F.least(s, F.lit(0.38))).otherwise(s))
    raw = F.coalesce("raw_abbrev", F.lit(""))
    embedded = F.array_contains(T.split_words(name), raw) & ~S.boundary_contains(name, F.concat(F.lit("area "), raw))
    collides = (T.normalize(F.col("acronym")) == raw) | F.array_contains(T.split_words(T.normalize(mq)), raw)
    demoted = F.col("via_raw") & ~F.col("via_expansion") & (raw != "") & ~embedded & (F.col("expansion_exact") | (F.col("expansion_soft") & collides))
    df = step(df, F.when(demoted, 0.48 * s).otherwise(s))
    df = df.withColumn("score", F.round(F.least(s, F.lit(1.0)), 6)).withColumn("modifier_match_score", F.round(S.modifier_match(F.col("modifier_terms"), F.col("alias_text")), 6))
    return df.withColumn("name_jaccard", S.jaccard(F.array_distinct(T.tokenize(F.col("query"), lexicon)), F.array_distinct(T.tokenize(T.strip_parenthetical(F.col("name")), lexicon))))
