"""Relations by id, with the statistics that the planner asks for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a statistics sample, and the rows per distinct value from which grouping pays.
SAMPLE_ROWS = 20_000
DUPLICATED = 2


@dataclass(frozen=True)
class Statistics:
    """Number of rows, and every stride-th of them: columns by number."""

    rows: int
    sample: dict[int, np.ndarray]

    def keys(self, columns: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """The different values of these columns in the sample, and how often each is there."""
        picked = [self.sample[c] for c in columns]
        return np.unique(np.rec.fromarrays(picked) if len(picked) > 1 else picked[0], return_counts=True)


class Catalog:
    """An ordered list of relations; a relation's id is its place in it.

    Each is registered as the temp view r<id> with columns c0, c1, ... of
    BIGINT, or DECIMAL(20,0) where values need all 64 unsigned bits. A lazy
    relation is opened when a query first names it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._relations: list[DataFrame | None] = []
        self._openers: list[Callable[[], DataFrame] | None] = []
        self._arities: list[int] = []
        self._statistics: dict[int, Statistics] = {}

    def add(self, df: DataFrame, columns: Iterable[str] | None = None) -> int:
        """Register the named columns (all by default) and return the new id."""
        names = list(columns) if columns is not None else df.columns
        rel = self.add_lazy(lambda: df, names)
        self.get(rel)
        return rel

    def add_lazy(self, opener: Callable[[], DataFrame], columns: Iterable[str]) -> int:
        names = list(columns)
        self._relations.append(None)
        self._openers.append(lambda: _relation(opener(), names))
        self._arities.append(len(names))
        return len(self._relations) - 1

    def get(self, rel: int) -> DataFrame:
        if not 0 <= rel < len(self._relations):
            raise ValueError(f"unknown relation {rel}; there are {len(self._relations)}")
        if self._relations[rel] is None:
            self._relations[rel] = self._openers[rel]()
            self.show(rel)
        return self._relations[rel]

    def show(self, rel: int) -> None:
        """(Re)register the view r<rel>, which the last catalog to do so owns."""
        self.get(rel).createOrReplaceTempView(f"r{rel}")

    def __len__(self) -> int:
        return len(self._relations)

    @property
    def arities(self) -> dict[int, int]:
        return dict(enumerate(self._arities))

    def statistics(self, rel: int) -> Statistics:
        """Rows and a sample of one relation, taken once: by two jobs, of which the second reads integers only.

        The stride is rows / SAMPLE_ROWS, whole, within each partition: below
        twice SAMPLE_ROWS all rows, else so many to twice as many. It steers
        the plan, never the result.
        """
        if rel not in self._statistics:
            df = self.get(rel)
            rows = df.count() if df.columns else 0
            stride = max(1, rows // SAMPLE_ROWS)
            picked = [F.col(c).cast("string").alias(c) if isinstance(df.schema[c].dataType, T.DecimalType) else F.col(c) for c in df.columns]
            table = df.where(F.monotonically_increasing_id() % stride == 0).select(*picked).toArrow() if rows else None
            # nulls join with nothing, but count as a value of their own here
            columns = {i: table.column(i).to_pandas().astype(str).to_numpy(str) if table.column(i).null_count else table.column(i).to_numpy() for i in range(len(df.columns))} if rows else {}
            self._statistics[rel] = Statistics(rows, {i: c.astype(str) if c.dtype == object else c for i, c in columns.items()})
        return self._statistics[rel]

    def analyze(self) -> None:
        """Take the statistics of all relations now; else a query's plan takes those of the relations that it names."""
        for rel in range(len(self)):
            self.statistics(rel)

    def duplication(self, rel: int, columns: Iterable[int]) -> float:
        """Rows per different value of these columns in the sample; 0 if empty."""
        found = self.statistics(rel)
        if not found.rows:
            return 0.0
        counts = found.keys(sorted(set(columns)))[1]
        return float(counts.sum() / len(counts))

    def duplicated(self, rel: int, columns: Iterable[int]) -> bool:
        return int(self.duplication(rel, columns)) >= DUPLICATED

    def pairs(self, left: int, left_columns: Sequence[int], right: int, right_columns: Sequence[int]) -> float:
        """How many rows the join of two relations on these columns has, as their samples tell."""
        a, b = self.statistics(left), self.statistics(right)
        if not a.rows or not b.rows:
            return 0.0
        (left_keys, left_n), (right_keys, right_n) = a.keys(left_columns), b.keys(right_columns)
        if left_keys.dtype.fields:
            left_keys, right_keys = (np.array([repr(x) for x in keys.tolist()]) for keys in (left_keys, right_keys))
        elif left_keys.dtype.kind != right_keys.dtype.kind:
            left_keys, right_keys = left_keys.astype(str), right_keys.astype(str)
        _, i, j = np.intersect1d(left_keys, right_keys, assume_unique=True, return_indices=True)
        met = float((left_n[i].astype(float) * right_n[j]).sum())
        return met * a.rows / left_n.sum() * b.rows / right_n.sum()


def testdata_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The integer columns of the generated tables, in a fixed order of ids.

    One catalog per application and folder: relations are opened, and their
    statistics taken, once for all queries.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _OPEN:
        return _OPEN[key]
    catalog = _OPEN[key] = Catalog(spark)
    for table, columns in TESTDATA_RELATIONS.items():
        catalog.add_lazy(lambda table=table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), columns)
    return catalog


def _relation(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns as c0, c1, ...: whole decimals as 20 digits, all else as longs."""
    casts = []
    for i, name in enumerate(names):
        kind = df.schema[name].dataType
        wide = isinstance(kind, T.DecimalType) and kind.scale == 0
        casts.append(F.col(f"`{name}`").cast(T.DecimalType(20, 0) if wide else T.LongType()).alias(f"c{i}"))
    return df.select(*casts)


_OPEN: dict[tuple[str, str], Catalog] = {}

TESTDATA_RELATIONS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"],
    "orders": ["o_orderkey", "o_custkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"],
    "nation": ["n_nationkey", "n_regionkey"],
    "region": ["r_regionkey"],
    "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id", "label"],
}
