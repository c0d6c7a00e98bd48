"""An index written as Parquet tables with a manifest, and checked against its sources when it is read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lexicon import Lexicon
from ..operators.catalog import Index

FORMAT = 1


def fingerprint(*tables: DataFrame) -> str:
    """sha256 over the rows of tables, in any order, and their column names; rows are hashed where they are."""
    import hashlib

    out = hashlib.sha256()
    for t in tables:
        row = F.sha2(F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}), 256)
        got = t.select(row.alias("r")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("r", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]).first()
        out.update(json.dumps([t.columns, *map(str, got)]).encode())
    return out.hexdigest()


def save(index: Index, path: str, of: str) -> None:
    """``of``: fingerprint of the tables that the index was built from."""
    for name in ("terms", "aliases", "postings", "frequencies"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    lex = index.lexicon
    about = {"format": FORMAT, "fingerprint": of, "entries": index.entries, "mean_length": index.mean_length, "lexicon": [lex.stopwords, lex.laterality, lex.weak, lex.modifiers]}
    spark = index.terms.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, of: str | None = None) -> Index | None:
    """The index, or None if it has another format or was built from other tables."""
    about = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if about["format"] != FORMAT or (of is not None and about["fingerprint"] != of):
        return None
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("terms", "aliases", "postings", "frequencies")]
    return Index(*tables, Lexicon(*map(tuple, about["lexicon"])), (about["entries"], about["mean_length"]))
