"""Ranking, filters behind it, and rows for queries without an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, top_k: int, partition: tuple[str, ...] = ("query_id",), where: str | None = None) -> DataFrame:
    """The first ``top_k`` rows by score, name likeness, depth, name and id; ``where`` filters before the limit."""
    if where:
        df = df.where(where)
    order = Window.partitionBy(*partition).orderBy(F.desc("score"), F.desc("name_jaccard"), F.desc("depth"), F.lower("name"), "term_id")
    return df.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top_k)


def coverage_filter(mode: str) -> str | None:
    """Rows "with" a secondary name, "without" one, or "both"."""
    return {"both": None, "with": "alt_name <> ''", "without": "alt_name = ''"}[mode]


def with_unanswered(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Every query; those without a result have one row of rank 0."""
    return queries.join(results, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int")).where(F.col(name) <= k)


def first_row(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in the given order."""
    return top_per_group(df, key, order, 1, "_first").drop("_first")


def quota_pick(df: DataFrame, stratum: str, quotas: dict, order: list) -> DataFrame:
    """Up to a quota of rows from each stratum; strata without one give none."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    ranked_ = df.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).cast("int"))
    # The largest quota is a plain limit, which Spark applies before the shuffle.
    return ranked_.where((F.col("pick") <= max(quotas.values(), default=0)) & (F.col("pick") <= F.coalesce(limit, F.lit(0))))


def diversified(df: DataFrame, group, order: list, n: int) -> DataFrame:
    """n rows, first at most one of each group, then the rest in order."""
    df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return df.orderBy(F.col("_nth") > 1, *order).limit(n).drop("_nth")


def sequential_ids(df: DataFrame, order: list, pattern: str) -> DataFrame:
    """Numbered by a pattern over the whole (small) result."""
    return df.withColumn("id", F.format_string(pattern, F.row_number().over(Window.orderBy(*order))))
