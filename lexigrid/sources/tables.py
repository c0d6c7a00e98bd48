"""Scans, rule tables and sinks. Everything is read as strings; missing cells are empty."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..lexicon import CLEAR_LABEL, KEY_LINE, LABEL_LINE, Lexicon


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as strings, a byte order mark before the first name removed, nulls as empty strings.

    ``multiline``: cells may hold line ends; then a file is read by one task, else files are split.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"')
    df = df.toDF(*[re.sub("^﻿", "", c) for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The named columns alone, with a header."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def catalog_rows(df: DataFrame, names: dict[str, str], level_prefixes: tuple[str, ...] = ("hierarchy", "Unnamed:"), parent_row: str = "parent") -> DataFrame:
    """Catalog columns from a file's; ``names`` maps ours to theirs. Level columns become further aliases and the depth."""
    from ..operators.catalog import inferred_depth

    levels = [F.col(f"`{c}`") for c in df.columns if c.startswith(level_prefixes)]
    depth = inferred_depth(F.col(parent_row) if parent_row in df.columns else F.lit(""), levels)
    cols = [F.trim(F.col(f"`{theirs}`")).alias(ours) for ours, theirs in names.items() if theirs in df.columns]
    return df.select(*cols, depth.cast("int").alias("depth"), (F.array(*levels) if levels else F.array().cast("array<string>")).alias("more_aliases")).where("name <> ''")


def lexicon_from(rules: DataFrame) -> Lexicon:
    """From (term, kind): kinds stopword, laterality, weak, modifier; others are ignored. A few rows a kind."""
    rows = rules.select(T.normalize(F.col("term")).alias("t"), T.normalize(F.col("kind")).alias("k")).where("t <> ''").distinct().collect()
    of = lambda k: tuple(sorted(r["t"] for r in rows if r["k"] == k))
    return Lexicon(of("stopword"), of("laterality"), of("weak"), of("modifier"))


def alias_rules(df: DataFrame, source: str = "source", target: str = "target", bidirectional: str = "bidirectional", order: str | None = None) -> DataFrame:
    """(rule_ord, source, target, bidirectional): both directions of two-way rules; empty and idle rules left out."""
    two = ~F.lower(T.stripped(F.col(bidirectional))).isin("no", "false", "0", "n", "one-way", "oneway") if bidirectional in df.columns else F.lit(True)
    df = df.select(T.normalize(F.col(source)).alias("source"), T.normalize(F.col(target)).alias("target"), two.alias("bidirectional"), *([F.col(order).alias("_o")] if order else []))
    df = df.where("source <> '' AND target <> '' AND source <> target")
    df = df.withColumn("i", F.row_number().over(Window.orderBy(*(["_o"] if order else ["source", "target"]))))  # a user's table of rules
    there = df.select((F.col("i") * 2).alias("rule_ord"), "source", "target", "bidirectional")
    back = df.where("bidirectional").select((F.col("i") * 2 + 1).alias("rule_ord"), F.col("target").alias("source"), F.col("source").alias("target"), "bidirectional")
    return there.unionByName(back)


def abbreviation_rules(df: DataFrame, order: str | None = None) -> DataFrame:
    """(rule_ord, abbrev, expansion) from (abbrev, expansion)."""
    df = df.select(T.normalize(F.col("abbrev")).alias("abbrev"), T.normalize(F.col("expansion")).alias("expansion"), *([F.col(order).alias("_o")] if order else []))
    df = df.where("abbrev <> '' AND expansion <> '' AND abbrev <> expansion")
    return df.withColumn("rule_ord", F.row_number().over(Window.orderBy(*(["_o"] if order else ["abbrev", "expansion"])))).drop("_o")


def query_rows(df: DataFrame, unique: bool = False) -> DataFrame:
    """(query_id, query) from the first column; blanks left out. Ids are a hash of the text, so reruns agree."""
    q = df.select(T.stripped(F.col(f"`{df.columns[0]}`")).alias("query")).where("query <> ''")
    q = q.distinct() if unique else q
    return q.withColumn("query_id", F.xxhash64("query"))


def label_file(spark: SparkSession, path: str, drop: str = CLEAR_LABEL) -> DataFrame:
    """(ord, name) from lines that end in a quoted name; first letter upper case; repeats left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_extract("value", LABEL_LINE, 1).alias("name"))
    lines = lines.where((F.col("name") != "") & (F.col("name") != drop)).withColumn("name", F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")))
    return lines.groupBy("name").agg(F.min("ord").alias("ord")).select("ord", "name")


def key_table_name(c) -> object:
    """``12: some_name (SN)`` to ``Some Name``: number, parenthesis and underscores removed."""
    inner = F.regexp_extract(T.text_of(c), KEY_LINE, 1)
    return T.humanize(F.when(inner == "", T.text_of(c)).otherwise(inner))


def key_table(df: DataFrame, column: str = "Level 6") -> DataFrame:
    """(name) from a key table: its column of that name, else its last one; each name once."""
    name = key_table_name(F.col(f"`{column if column in df.columns else df.columns[-1]}`"))
    return df.select(name.alias("name")).where("name <> ''").distinct()


def write_by(df: DataFrame, path: str, column: str) -> None:
    """Rows of each value of a column in a folder of their own, as CSV with a header."""
    df.write.mode("overwrite").partitionBy(column).csv(path, header=True, quote='"', escape='"')


def two_kind_queries(df: DataFrame, abbrev: str = "structure_name", full: str = "fullname", order: str | None = None, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """An abbrev row for each structure and a fullname row where it differs but for case; once per kind and text case
    aside, the first by ``order`` (without one the smallest). ``allowed``: values that pass, by column; rows without
    a structure give nothing."""
    for column, values in (allowed or {}).items():
        df = df.where(T.stripped(F.col(column)).isin("", *values))
    df = df.where(T.stripped(F.col(abbrev)) != "")
    a, f = T.stripped(F.col(abbrev)), T.stripped(F.col(full))
    rows = df.select(F.explode(F.array(F.struct(F.lit("abbrev").alias("kind"), a.alias("query")), F.struct(F.lit("fullname").alias("kind"), F.when(F.lower(f) != F.lower(a), f).otherwise("").alias("query")))).alias("x"), *([F.col(order).alias("_o")] if order else []))
    rows = rows.select("x.kind", "x.query", *(["_o"] if order else [])).where("query <> ''")
    first = F.min_by("query", F.struct("_o", "query")) if order else F.min("query")
    return rows.groupBy("kind", F.lower("query").alias("key")).agg(first.alias("query"))


def suitable(df: DataFrame, column: str = "suitability", good: tuple[str, ...] = ("", "suitable")) -> DataFrame:
    return df.where(F.lower(T.stripped(F.col(column))).isin(*good))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, trimmed, nulls as empty strings; a missing one is an error. For rows that came from a
    workbook (no Spark reader) as much as for any table."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"columns missing: {lost}")
    return df.select(*[T.stripped(F.col(f"`{c}`").cast("string")).alias(c) for c in columns])


def ranked_sink(inputs: DataFrame, results: DataFrame, prefix: str = "match_") -> DataFrame:
    """Input rows with the ranked columns under a prefix; without a result one row of rank 0 and empty cells."""
    named = results.select("query_id", *[F.col(c).cast("string").alias(f"{prefix}{c}") for c in results.columns if c != "query_id"])
    out = inputs.join(named, "query_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("0" if c == f"{prefix}rank" else "")) for c in named.columns if c != "query_id"})


def surface_list(df: DataFrame, column: str, order: str) -> DataFrame:
    """Case-folded distinct values, the first surface of each kept, in order."""
    t = T.stripped(F.col(column))
    out = df.where(t != "").groupBy(F.lower(t).alias("key")).agg(F.min(F.struct(order, t.alias("s"))).alias("x"))
    return out.select("key", F.col("x.s").alias(column), F.col(f"x.{order}").alias(order))
