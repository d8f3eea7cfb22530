"""Physical layout along a key: neighbours in space become neighbours on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cluster_by(df: DataFrame, *keys: str | Column, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted, so that a written table's row groups hold narrow key ranges."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def density(df: DataFrame, cell: Column) -> DataFrame:
    """``(cell, n)``: rows per cell, summed before the exchange."""
    return df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
