"""From matched names to distributions over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .rank import first_row


def preferred_hits(hits: DataFrame, name_top_k: int) -> DataFrame:
    """Ranked name hits: exact ones alone if a query has any (score .95 and more), of those the ones matched by
    their own name if there are any; then the first ``name_top_k``."""
    pool = Window.partitionBy("query_id")
    exact = F.contains("methods", F.lit("exact")) & (F.col("score") >= 0.95)
    own = exact & (T.normalize(F.col("name")) == T.normalize(F.coalesce(F.nullif(F.col("matched_alias"), F.lit("")), F.col("matched_query"))))
    tier = F.when(own, 0).when(exact, 1).otherwise(2)
    hits = hits.withColumn("_tier", tier).withColumn("_best", F.min("_tier").over(pool)).where("_tier = _best")
    return hits.withColumn("_n", F.row_number().over(pool.orderBy("rank"))).where(F.col("_n") <= name_top_k).drop("_tier", "_best", "_n")


def with_literature_name(hits: DataFrame, names: DataFrame, prefix: str = "LIT:") -> DataFrame:
    """Adds lit_name: the hit's name if ``names`` has it, else its id without the prefix, normalized; others go."""
    known = names.select(F.col("lit_name").alias("_known")).distinct()
    one = hits.join(known, T.stripped(F.col("name")) == F.col("_known"), "left")
    fallback = T.normalize(F.regexp_replace("term_id", f"^{prefix}", ""))
    one = one.withColumn("lit_name", F.coalesce("_known", fallback)).drop("_known")
    return one.join(names.select("lit_name").distinct(), "lit_name", "left_semi")


def projected(hits: DataFrame, distribution: DataFrame, label: str, top_k: int, abbr: str | None = None) -> DataFrame:
    """Labels of a query's names by match score times share, the best row of each label, ranked.

    ``hits``: (query_id, rank, lit_name, score, laterality, ...), ``distribution``: (lit_name, label, p_raw, ...).
    Of equal scores the better ranked name counts, then the lower rank in the name.
    """
    abbr = abbr or label
    own = [c for c in distribution.columns if c != "lit_name"]
    df = hits.withColumnsRenamed({"score": "match_score", "rank": "name_rank"}).join(distribution.withColumn("p_raw", F.coalesce(F.col("p_raw").cast("double"), F.lit(0.0))), "lit_name")
    df = df.withColumn("score", F.col("match_score") * F.col("p_raw"))
    inner = [F.col("rank").cast("int")] if "rank" in own else []
    df = first_row(df, ["query_id", label], [F.desc("score"), F.col("name_rank"), *inner, F.col("lit_name")])
    if "rank" in own:
        df = df.withColumnRenamed("rank", "rank_in_name")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(abbr), F.col(label))
    return df.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= max(1, top_k))


def side_label(side, left, right):
    """The label of the side, nothing for unknown and both."""
    return F.when(side == "left", left).when(side == "right", right).otherwise("")


def prefer_value(df: DataFrame, key: list[str], column: str, value: str, order: list) -> DataFrame:
    """Per key the first row with the value, else the first row."""
    return first_row(df, key, [F.when(F.col(column) == value, 0).otherwise(1), *order])


def name_index(names: DataFrame, coarse: DataFrame, sides: DataFrame) -> DataFrame:
    """names with their rank-1 coarse label and their side row, empty where there is none."""
    top = first_row(coarse.where(F.col("rank").cast("int") == 1), ["lit_name"], [F.desc("label")]).select("lit_name", F.col("label").alias("top_label"), F.col("p_raw").alias("top_p_raw"))
    side = prefer_value(sides, ["lit_name"], "side", "U", [F.col("ord")]).drop("ord")
    out = names.join(top, "lit_name", "left").join(side, "lit_name", "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in out.columns if c not in names.columns})


def synthetic_catalog(names: DataFrame, prefix: str = "LIT:") -> DataFrame:
    """A name index as catalog rows, without parents, so that the matcher can search it."""
    return names.select(F.concat(F.lit(prefix), "lit_name").alias("term_id"), F.col("lit_name").alias("name"), F.lit("").alias("acronym"), F.col("surface").alias("alt_name"), F.lit("").alias("alt_acronym"), F.lit("").alias("parent_id"))
