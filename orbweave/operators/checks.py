"""Checks over whole tables, each one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of rows, and per BIGINT column the xor and the exact sum of its values; order doesn't matter."""
    parts = [F.count("*").alias("n")]
    for c in columns:
        parts += [F.bit_xor(c).alias(f"{c}_xor"), F.sum(F.col(c).cast("decimal(38,0)")).alias(f"{c}_sum")]
    return df.agg(*parts)


def first_failing(df: DataFrame, order: str, error: Column) -> DataFrame:
    """The row of least ``order`` whose ``error`` isn't null, as ``(order, error)``; no row if there is none.

    Unlike an exception from a task, it is the same for any partitioning.
    """
    wrong = df.select(F.col(order), error.alias("error")).where("error is not null")
    least = wrong.agg(F.min(F.struct(order, "error")).alias("e")).where("e is not null")
    return least.select("e.*")


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """``df``, or an error where it has no row; the test reads one row."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df
