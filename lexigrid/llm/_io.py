"""Reading tables, and tables written to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import session

#: Rows of an Arrow batch at most: a batch of documents should stay small beside a worker's memory.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, and let its workers find the package."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return session.ready(spark)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``session.stored`` with bounded Arrow batches."""
    small_batches(df.sparkSession)
    return session.stored(df, name, by)
