"""The engine: a catalog, and queries against it."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.ir import Query
from quernel.plans.planner import Plan, plan
from quernel.plans.rewrite import canonicalize, rewrite
from quernel.plans.sqlgen import to_sql
from quernel.plans.textql import parse, validate
from quernel.sources.catalog import Catalog
from quernel.sources.tables import load_relation
from quernel.streaming.monitor import Counters

NULL_TEXT = "NULL"
CONCURRENT_QUERIES = 8


def result_line(df: DataFrame) -> DataFrame:
    """A row of sums as one text column `line`."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)) for c in df.columns]
    return df.select(F.concat_ws(" ", *values).alias("line"))


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, mode: str = "auto", numeric: str = "exact"):
        self.spark = spark
        self.catalog = catalog if catalog is not None else Catalog(spark)
        self.mode, self.numeric = mode, numeric
        self.counters = Counters()

    def load(self, path: str) -> int:
        """Add the relation at a path, by name Parquet, text or binary, of any unsigned 64-bit values; its id."""
        return self.catalog.add(load_relation(self.spark, path))

    def plan(self, query: str | Query, mode: str | None = None) -> Plan:
        parsed = parse(query) if isinstance(query, str) else query
        made = plan(parsed, self.catalog, mode or self.mode, self.numeric)
        self.counters.add(queries=1, scans=len(made.steps), joins=len(made.steps) - 1, counted_scans=len(made.counted))
        return made

    def query(self, query: str | Query, mode: str | None = None) -> DataFrame:
        """One row of sums s0, s1, ...; lazy."""
        return self.plan(query, mode).df

    def sql(self, query: str | Query, rewritten: bool = True) -> DataFrame:
        """The same result by way of generated SQL, an independent path for comparison."""
        parsed = validate(parse(query) if isinstance(query, str) else query, self.catalog.arities)
        for rel in set(parsed.relations):
            self.catalog.show(rel)  # another catalog may have taken the name
        return self.spark.sql(to_sql(rewrite(parsed) if rewritten else canonicalize(parsed), "spark", result=True))

    def explain(self, query: str | Query, mode: str | None = None) -> str:
        return self.plan(query, mode).describe()

    def batch(self, lines: Iterable[str], mode: str | None = None) -> DataFrame:
        """A batch as one plan: (query_no, line) for each query, submission order in query_no."""
        parts = [result_line(self.query(q, mode)).select(F.lit(i).cast("bigint").alias("query_no"), "line") for i, q in enumerate(lines)]
        if not parts:
            return self.spark.createDataFrame([], "query_no bigint, line string")
        return reduce(DataFrame.unionAll, parts)

    def run(self, lines: Iterable[str], mode: str | None = None) -> list[str]:
        """Result lines in submission order; the queries run side by side."""

        def one(text: str) -> str:
            began = time.monotonic()
            line = result_line(self.query(text, mode)).first()[0]
            self.counters.add(results=1, null_results=int(NULL_TEXT in line.split()), milliseconds=int(1000 * (time.monotonic() - began)))
            return line

        with ThreadPoolExecutor(CONCURRENT_QUERIES) as pool:
            run_one = inheritable_thread_target(self.spark)(one)
            return [f.result() for f in [pool.submit(run_one, q) for q in lines]]
