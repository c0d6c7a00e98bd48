"""Queries as a stream: each micro-batch goes through the matcher, which is stateless per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import Index
from ..plans.matcher import search


def match_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Write ranked rows of a stream (query_id, query) as Parquet, a folder for each batch, so that a batch
    that runs again replaces its own rows."""
    return each_batch(queries, lambda df: search(df, index, **options), path, checkpoint, available_now)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    def write(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def unseen(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key was not handled yet: a pass that is run again goes on where it stopped."""
    return df.join(done, key, "left_anti")
