"""Folds by a checksum of doc_id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_fold(remainder: int = 1, modulus: int = 3) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder``; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
