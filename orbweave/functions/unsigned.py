"""Unsigned 64-bit numbers in Spark: a BIGINT holds the bit pattern, these give sortable forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = -(2**63)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sortable(c) -> Column:
    """A BIGINT whose signed order is the unsigned order of ``c``."""
    return as_col(c).bitwiseXOR(F.lit(TOP))


def unsigned_decimal(c) -> Column:
    """DECIMAL(20, 0) of the unsigned value."""
    return F.conv(F.hex(as_col(c)), 16, 10).cast("decimal(20,0)")


def hex16(c) -> Column:
    """16 lower-case hex digits, which sort as the unsigned value."""
    return F.lower(F.lpad(F.hex(as_col(c)), 16, "0"))


def from_hex16(c) -> Column:
    """The BIGINT bit pattern of up to 16 hex digits."""
    return F.conv(as_col(c), 16, -10).cast("long")
