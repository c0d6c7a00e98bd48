"""The whole way from queries to ranked terms, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import composed
from ..lexicon import POSITIONAL
from ..operators import expand, rank, retrieve, score
from ..operators.catalog import Index

RESULT = (
    "query_id", "rank", "term_id", "name", "acronym", "alt_name", "alt_acronym", "parent_id", "sort_order", "depth", "score", "methods",
    "matched_alias", "matched_query", "best_method_score", "modifier_terms", "modifier_match_score", "hierarchy_reason",
)


def composed_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) with queries in NFKC."""
    return queries.select("query_id", composed(F.col("query")).alias("query"))


def candidates(queries: DataFrame, index: Index, rules: DataFrame | None = None, abbrevs: DataFrame | None = None, per_method: int = 40) -> DataFrame:
    variants = expand.query_variants(composed_queries(queries), index.lexicon, rules, abbrevs)
    return retrieve.exact(variants, index).unionByName(retrieve.fuzzy(variants, index, per_method)).unionByName(retrieve.bm25(variants, index, per_method))


def scored_pool(queries: DataFrame, index: Index, found: DataFrame, abbrevs: DataFrame | None = None) -> DataFrame:
    lexicon = index.lexicon
    queries = composed_queries(queries)
    q = F.col("query")
    modifiers = T.modifier_terms(q, lexicon)
    facts = queries.select("query_id", "query", modifiers.alias("modifier_terms"), T.content_tokens(q, lexicon).alias("query_content"))
    words = F.array_distinct(F.flatten(F.transform("modifier_terms", lambda t: T.split_words(T.normalize(t)))))
    facts = facts.withColumn("positional", F.array_intersect(words, T.words_array(POSITIONAL)))
    probes = expand.abbreviation_probes(queries, lexicon, abbrevs)
    content = F.array_distinct(F.flatten(F.transform("expansions", lambda e: T.content_tokens(e, lexicon))))
    none = F.array().cast("array<string>")
    facts = facts.join(probes.withColumn("expansion_content", content), "query_id", "left").withColumns({c: F.coalesce(c, none) for c in ("expansions", "expansion_content")})
    df = score.merged(found).join(facts, "query_id").join(index.terms, "term_id")
    df = df.withColumn("alias_tokens_all", F.array_distinct(F.flatten("alias_tokens")))
    return score.scored(score.with_pool(score.with_flags(df, lexicon)), lexicon)


def search(queries: DataFrame, index: Index, rules: DataFrame | None = None, abbrevs: DataFrame | None = None, top_k: int = 10, per_method: int = 40, coverage: str = "both", unanswered: bool = False) -> DataFrame:
    """Ranked terms for queries (query_id, query).

    ``rules``: (rule_ord, source, target, bidirectional), ``abbrevs``: (rule_ord, abbrev, expansion), both normalized.
    """
    pool = scored_pool(queries, index, candidates(queries, index, rules, abbrevs, per_method), abbrevs)
    out = rank.ranked(pool, top_k, where=rank.coverage_filter(coverage))
    out = out.withColumn("best_method_score", F.round("best", 6)).withColumn("modifier_terms", F.array_join("modifier_terms", ";")).withColumn("hierarchy_reason", F.lit("")).select(*RESULT)
    return rank.with_unanswered(queries.select("query_id", "query"), out) if unanswered else out
