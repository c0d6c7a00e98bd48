"""Stages before and behind the matcher: any function of these shapes can take their place.

The versions here need no model: the first strips what is no name, the second turns hints and the tree
into relations. A stage that fails should return its input, as these do for what they cannot use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..lexicon import Lexicon
from ..operators.evaluate import guarded


def preprocess(queries: DataFrame, lexicon: Lexicon) -> DataFrame:
    """queries (query_id, query) with roi_query, removed array<struct<text,kind>> and reason."""
    q = T.text_of(F.col("query"))
    bare = T.strip_markers(q)
    roi = F.trim(T.cut_exclusion(bare))
    tokens, left = T.split_words(T.normalize(q)), T.split_words(T.normalize(roi))
    sides = T.words_array(lexicon.laterality)
    kind = lambda t: F.when(F.array_contains(sides, t), "laterality").otherwise("marker")
    gone = F.filter(F.array_distinct(tokens), lambda t: ~F.array_contains(left, t))
    removed = F.transform(gone, lambda t: F.struct(t.alias("text"), kind(t).alias("kind")))
    out = queries.withColumn("roi_query", F.when(T.normalize(roi) == "", q).otherwise(roi))
    return out.withColumn("removed", removed).withColumn("reason", F.when(F.size(removed) > 0, "stripped").otherwise(""))


def dictionary_hints(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, term_id, ord) for entries (abbrev, term_id) of a curated dictionary in the query's text, case
    kept, once per case-folded abbreviation. Words of the text meet the entries, then the whole is checked."""
    words = queries.select("query_id", "query", F.explode(F.array_distinct(F.filter(F.split("query", r"[^A-Za-z0-9]+"), lambda w: w != ""))).alias("_w"))
    entries = dictionary.withColumn("_w", F.element_at(F.filter(F.split("abbrev", r"[^A-Za-z0-9]+"), lambda w: w != ""), 1))
    hits = words.join(entries, "_w").where(T.dictionary_hit(F.col("query"), F.col("abbrev")))
    first = hits.groupBy("query_id", F.lower("abbrev").alias("_k")).agg(F.min(F.struct("abbrev", "term_id")).alias("x"))
    return first.select("query_id", "x.term_id", F.row_number().over(Window.partitionBy("query_id").orderBy("x.abbrev")).alias("ord"))


def postprocess(ranked: DataFrame, hints: DataFrame, up: DataFrame, most: int = 4, sure: float = 0.9) -> DataFrame:
    """(query_id, term_id, relation, ord), at most ``most`` a query: hints and sure candidates as the same ('=),
    then candidates above (>) and below (<) the first of those. ``up``: ancestors (term_id, ancestor_id, distance)."""
    known = ranked.select("query_id", "term_id", "rank", "score")
    same = hints.select("query_id", "term_id", F.lit("'=").alias("relation"), F.col("ord").cast("int").alias("ord"))
    same = same.unionByName(known.where(F.col("score") >= sure).select("query_id", "term_id", F.lit("'=").alias("relation"), (F.col("rank") + 100).cast("int").alias("ord")))
    lead = same.groupBy("query_id").agg(F.min_by("term_id", "ord").alias("lead"))
    others = known.join(lead, "query_id").where("term_id <> lead")
    links = up.where("distance > 0").select(F.col("term_id").alias("below"), F.col("ancestor_id").alias("above"))
    over = others.join(links, (F.col("lead") == F.col("below")) & (F.col("term_id") == F.col("above")), "left_semi").withColumn("relation", F.lit(">"))
    under = others.join(links, (F.col("lead") == F.col("above")) & (F.col("term_id") == F.col("below")), "left_semi").withColumn("relation", F.lit("<"))
    rest = over.unionByName(under).select("query_id", "term_id", "relation", (F.col("rank") + 1000).cast("int").alias("ord"))
    candidates = known.select("query_id", "term_id").unionByName(hints.select("query_id", "term_id"))
    return guarded(same.unionByName(rest), candidates, k=most)
