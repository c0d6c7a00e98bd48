"""From raw documents to token ids: five stages, each one operator of ``lexigrid.llm``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
``run`` writes it as Parquet and reads it again as the next stage's documents. All but the last return
the columns of ``documents``. A stage's own tables are deleted when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import bpe, mixing, nearcopy, quality, substring
from lexigrid.llm._io import stored, table
from lexigrid.session import own_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    with own_folder(spark, docs):
        return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Near copies are what the SimHash operator links, and texts that share four fifths of their five-word shingles.
    """
    with own_folder(spark, docs):
        return nearcopy.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 50 words and more that a document with a smaller doc_id has as well are cut."""
    with own_folder(spark, docs):
        return substring.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their token targets."""
    with own_folder(spark, docs):
        return mixing.repeat_by_copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and what they decode to."""
    with own_folder(spark, docs):
        return bpe.encode_decode(docs, ids=True, keep=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mix),
    ("bpe encoding", tokenize),
]

#: Stages learn a model, hash and solve iteratively, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
