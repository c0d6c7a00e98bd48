"""Building a corpus of names: unpivoting, modes, merges, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def mentions(df: DataFrame, sides: list[tuple[str, str]], carry: list[str]) -> DataFrame:
    """Each row once a side: (name, fullname) pairs of columns become (side, name, fullname)."""
    parts = [F.struct(F.lit(i).alias("side"), T.stripped(F.col(n)).alias("name"), T.stripped(F.col(f)).alias("fullname")) for i, (n, f) in enumerate(sides)]
    return df.select(*carry, F.explode(F.array(*parts)).alias("x")).select(*carry, "x.side", "x.name", "x.fullname")


def first_seen_mode(df: DataFrame, key: list[str], column: str, order: list[str]) -> DataFrame:
    """(key, column): the most frequent value that is not empty, the first seen on ties."""
    counts = df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(*key, column).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("o"))
    return counts.groupBy(*key).agg(F.min_by(column, F.struct(-F.col("n"), "o")).alias(column))


def name_aggregate(df: DataFrame, order: list[str]) -> DataFrame:
    """(name_key, display, fullname, species, paper, n_mentions, n_papers) from mentions with those columns."""
    df = df.withColumn("name_key", F.lower("name")).withColumnRenamed("name", "display")
    out = df.groupBy("name_key").agg(F.count("*").alias("n_mentions"), F.count_distinct(F.nullif("paper", F.lit(""))).alias("n_papers"))
    for c in ("display", "fullname", "species", "paper"):
        out = out.join(first_seen_mode(df, ["name_key"], c, order), "name_key", "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out.select("name_key", "display", "fullname", "species", "paper", "n_mentions", "n_papers")


def kept_and_skipped(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """df with ``skip``: the first reason that holds, null for what is kept. Count by it for the skip counters."""
    return df.withColumn("skip", reduce(lambda acc, r: acc.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0])))


def allowed_row(taxon: Column, common: Column, deny: list[str], known: list[str], allow: list[str]) -> Column:
    """Blank rows stay; a denied word drops; a known name stays; an allowed word stays; the rest drops."""
    text = F.lower(F.concat_ws(" ", T.text_of(taxon), T.text_of(common)))
    has = lambda words: reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))
    return F.when(F.trim(text) == "", True).when(has(deny), False).when(F.lower(T.stripped(common)).isin(*known) | F.lower(T.stripped(taxon)).isin(*known), True).otherwise(has(allow))


def canonical(df: DataFrame, names: DataFrame, common: str, taxon: str, out: str) -> DataFrame:
    """Dictionary name (key, value) of the common name, else of the taxon, else the common name in title case, else the taxon."""
    by = lambda n: names.select(F.col("key").alias(f"_{n}"), F.col("value").alias(f"_{n}_value"))
    df = df.join(by("c"), F.lower(T.stripped(F.col(common))) == F.col("_c"), "left").join(by("t"), F.lower(T.stripped(F.col(taxon))) == F.col("_t"), "left")
    own = F.nullif(T.title_case(T.stripped(F.col(common))), F.lit(""))
    return df.withColumn(out, F.coalesce("_c_value", "_t_value", own, T.stripped(F.col(taxon)))).drop("_c", "_c_value", "_t", "_t_value")


def flags(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def cascade(found: Column, steps: list[tuple[list[str], str, str]], otherwise: tuple[str, str]) -> Column:
    """Struct (label, reason) of the first step one of whose flags was found."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("label"), F.lit("").alias("reason")))
    for names, label, reason in steps:
        out = out.when(F.arrays_overlap(found, T.words_array(names)), F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit(otherwise[0]).alias("label"), F.lit(otherwise[1]).alias("reason")))


def merged_entries(df: DataFrame, key: list[str], last: list[str], union: list[str], order: str) -> DataFrame:
    """One row a key: of ``last`` columns the last that is not empty, of ``union`` columns all values once, in order."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.coalesce(F.max_by(c, F.when(filled(c), F.col(order))), F.lit("")).alias(c) for c in last])
    for c in union:
        out = out.join(_in_order(df.where(filled(c)), key, c, order, " | "), key, "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out.select(*key, *last, *union)


def _in_order(df: DataFrame, key: list[str], column: str, order: str, sep: str) -> DataFrame:
    """(key, column): each value once, by its first place. Repeats are gone before a key's values are gathered."""
    once = df.groupBy(*key, column).agg(F.min(order).alias("_o"))
    return once.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", column))), lambda x: x[column]), sep).alias(column))


def surface_merge(df: DataFrame, key: list[str], surface: str, seed: str, source: str, order: str) -> DataFrame:
    """The seed's surface, else the longest (first on ties), and all sources once, in order."""
    best = F.max_by(surface, F.struct(F.col(seed).cast("int"), F.length(surface), -F.col(order)))
    return df.groupBy(*key).agg(best.alias(surface)).join(_in_order(df, key, source, order, "; ").withColumnRenamed(source, "sources"), key)


def coalesced_lookup(df: DataFrame, truth: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """``value`` from the first of several key pairs (column of df, column of truth) that finds one."""
    found = []
    for i, (own, other) in enumerate(keys):
        side = truth.where(T.stripped(F.col(other)) != "").groupBy(F.lower(T.stripped(F.col(other))).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        df = df.join(side, F.lower(T.stripped(F.col(own))) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return df.withColumn(value, F.coalesce(*found)).drop(*found)


def must_contain(whole: DataFrame, part: DataFrame, key: list[str]) -> DataFrame:
    """``whole``, if every key of ``part`` is in it; else an error."""
    if not part.join(whole, key, "left_anti").isEmpty():
        raise ValueError(f"keys missing by {key}")
    return whole


def overlay(*tables: DataFrame) -> DataFrame:
    """All rows under the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def upsert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old, key, "left_anti"), allowMissingColumns=True)


def batches(df: DataFrame, order: list, size: int, group: list[str]) -> DataFrame:
    """Number of the batch of ``size`` rows within each group."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))
