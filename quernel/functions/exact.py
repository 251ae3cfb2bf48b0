"""Exact sums of 64-bit integers.

ANSI `sum(bigint)` raises on overflow and a decimal sum leaves the long fast
path for every row. Here a bigint is summed as three limbs of at most 22 bits,
each within a long for 2^41 rows; the limbs meet in one decimal per result row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = T.DecimalType(38, 0)
LIMB_BITS = 22
#: Result types by mode: must fit / exact / modulo 2^64.
NUMERIC = ("bigint", "exact", "wrap64")


def exact_sum(value: Column, kind: T.DataType) -> Column:
    """DECIMAL(38,0) sum of a bigint or wide decimal column; null over no rows."""
    if isinstance(kind, T.DecimalType):
        return F.sum(value.cast(WIDE)).cast(WIDE)
    mask = (1 << LIMB_BITS) - 1
    low = F.sum(value.bitwiseAND(F.lit(mask)))
    mid = F.sum(F.shiftright(value, LIMB_BITS).bitwiseAND(F.lit(mask)))
    high = F.sum(F.shiftright(value, 2 * LIMB_BITS))
    step = F.lit(1 << LIMB_BITS).cast(T.DecimalType(10, 0))
    total = high.cast(T.DecimalType(20, 0))
    for limb in (mid, low):
        total = (total * step).cast(WIDE) + limb.cast(T.DecimalType(20, 0))
        total = total.cast(WIDE)
    return total


def product(a: Column, b: Column) -> Column:
    """DECIMAL(38,0) product of multiplicities: no bigint of theirs overflows, only what has over 38 digits."""
    return (a.cast(WIDE) * b.cast(WIDE)).cast(WIDE)


def weighted_sum(value: Column, weight: Column) -> Column:
    """DECIMAL(38,0) sum of value times multiplicity, exact up to 38 digits."""
    return F.sum(product(value, weight)).cast(WIDE)


def finish(total: Column, numeric: str) -> Column:
    """The result type, with zero as null."""
    if numeric == "wrap64":
        total = F.pmod(total, F.lit(str(1 << 64)).cast(T.DecimalType(20, 0))).cast(T.DecimalType(20, 0))
    total = F.nullif(total, F.lit(0).cast(total_type(numeric)))
    return total.cast("bigint") if numeric == "bigint" else total


def total_type(numeric: str) -> T.DataType:
    return T.DecimalType(20, 0) if numeric == "wrap64" else WIDE
