"""The engine's operators one by one, as DataFrame to DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.exact import exact_sum, finish, product, weighted_sum

COUNT = "__n"
_COMPARE = {"<": Column.__lt__, ">": Column.__gt__, "=": Column.__eq__}


def constant(value: int) -> Column:
    """A literal that is exact for every unsigned 64-bit value."""
    return F.lit(value) if value < 2**63 else F.lit(str(value)).cast("decimal(20,0)")


def condition(column: str, op: str, value: int) -> Column:
    return _COMPARE[op](F.col(column), constant(value))


def scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns asked for; pruning reaches the file reader."""
    return df.select(*columns)


def filter_scan(df: DataFrame, filters: Sequence[tuple[str, str, int]], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet all (column, comparison, constant); filter columns need not be output."""
    kept = df.filter(reduce(Column.__and__, [condition(*f) for f in filters])) if filters else df
    return kept.select(*columns) if columns is not None else kept


def equi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Inner join on equal columns, bag semantics. Names must not clash."""
    return left.join(right, [F.col(a) == F.col(b) for a, b in pairs], "inner")


def residual_equality(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) == F.col(b))


def group_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values with their multiplicity in __n; multiplicities already there add up, as DECIMAL(38,0) if they are."""
    n = F.sum(COUNT) if COUNT in df.columns else F.count(F.lit(1))
    return df.groupBy(*columns).agg(n.alias(COUNT))


def counted_filter(df: DataFrame, column: str, filters: Sequence[tuple[str, int]]) -> DataFrame:
    """One column filtered by itself, as (value, multiplicity)."""
    return group_count(filter_scan(df, [(column, op, k) for op, k in filters], [column]), [column])


def counted_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], output: Sequence[str]) -> DataFrame:
    """Join of counted inputs: multiplicities multiply, then equal output rows merge."""
    right = right.withColumnRenamed(COUNT, "__n_right")
    both = equi_join(left, right, pairs).withColumn(COUNT, product(F.col(COUNT), F.col("__n_right")))
    return group_count(both, output)


def checksum(df: DataFrame, columns: Sequence[str], numeric: str = "exact") -> DataFrame:
    """One row: the sum of each column as s0, s1, ...; zero and empty are null."""
    totals = []
    for i, name in enumerate(columns):
        total = weighted_sum(F.col(name), F.col(COUNT)) if COUNT in df.columns else exact_sum(F.col(name), df.schema[name].dataType)
        totals.append(finish(total, numeric).alias(f"s{i}"))
    return df.agg(*totals)
