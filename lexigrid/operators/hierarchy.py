"""The tree that parent ids make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def ancestors(terms: DataFrame) -> DataFrame:
    """(term_id, ancestor_id, distance) of all ancestors, a term itself at distance 0.

    Distances double: who is known up to 2^k steps up, joined with the ancestors that lie 2^k steps up. A tree of
    any depth takes the logarithm of its depth in rounds, each stored. A parent that is not in the catalog is an
    ancestor without ancestors. A cycle of parents is an error, as soon as a round goes all the way around.
    """
    up = terms.select(F.col("term_id").cast("string").alias("term_id"), F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("parent_id"))
    jump = stored(up.where("parent_id <> ''").select("term_id", F.col("parent_id").alias("far")).distinct(), "tree-jumps")
    found = up.select("term_id", F.col("term_id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct()
    # Parents without a row of their own are reached as well.
    own = jump.select(F.col("far").alias("term_id")).join(up, "term_id", "left_anti").distinct()
    reach, step = found.unionByName(own.select("term_id", F.col("term_id").alias("ancestor_id"), F.lit(0).alias("distance"))), 1
    while not jump.isEmpty():
        more = jump.join(reach.withColumnRenamed("term_id", "far"), "far").select("term_id", "ancestor_id", (F.col("distance") + step).alias("distance"))
        reach = stored(reach.unionByName(more), "tree-reach")
        around = reach.where("term_id = ancestor_id AND distance > 0").first()
        if around:
            raise ValueError(f"the parents of {around['term_id']} lead back to it")
        jump = stored(jump.alias("a").join(jump.alias("b"), F.col("a.far") == F.col("b.term_id")).select("a.term_id", "b.far"), "tree-jumps")
        step *= 2
    return reach.join(own, "term_id", "left_anti")


def tree_depth(up: DataFrame) -> DataFrame:
    return up.groupBy("term_id").agg(F.max("distance").alias("tree_depth"))


def relation(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with relation: '= the same, < a below b, > a above b, else null."""
    below = up.where("distance > 0").select(F.col("term_id").alias("a"), F.col("ancestor_id").alias("b"), F.lit(True).alias("_below")).distinct()
    above = below.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_above"))
    out = pairs.join(below, ["a", "b"], "left").join(above, ["a", "b"], "left")
    return out.withColumn("relation", F.when(F.col("a") == F.col("b"), "'=").when(F.col("_below"), "<").when(F.col("_above"), ">")).drop("_below", "_above")


def common_parents(candidates: DataFrame, terms: DataFrame, likeness) -> DataFrame:
    """Parents that two or more of a query's candidates share, with a score from the best child.

    ``candidates``: (query_id, term_id, score); ``likeness``: a column over query_id's ``query`` and the
    parent's ``name``; parents of likeness 0 are left out. Best child b in [.62, .82): b - .03; else min(b + .08, .97).
    """
    child = candidates.join(terms.select("term_id", "parent_id"), "term_id").where("parent_id <> ''")
    best = child.groupBy("query_id", "query", "parent_id").agg(F.count("*").alias("children"), F.max("score").alias("best")).where("children >= 2")
    up = best.join(terms.select(F.col("term_id").alias("parent_id"), "name"), "parent_id").where(likeness > 0)
    between = (F.col("best") >= 0.62) & (F.col("best") < 0.82)
    return up.select("query_id", F.col("parent_id").alias("term_id"), "name", "children", F.when(between, F.col("best") - 0.03).otherwise(F.least(F.col("best") + 0.08, F.lit(0.97))).alias("score"))


def with_extension(terms: DataFrame, extra: DataFrame) -> DataFrame:
    """Catalog with extension terms below its own; an extension without a parent in it is an error."""
    lost = extra.join(terms, extra["parent_id"] == terms["term_id"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("extension terms without a parent in the catalog")
    return terms.unionByName(extra, allowMissingColumns=True)
