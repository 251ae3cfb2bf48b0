"""Query to DataFrame.

Filters and columns are declared at the scans, joins fold left-deep in the
order of rewrite.join_steps, and one global aggregate ends the plan. Strategy
and build sides are Spark's to choose.

Multiplicities: Catalyst places no aggregate below a join. Where a relation
repeats the values a query needs, its scan becomes (values, count); joins
multiply counts and the root sums value * count. Inner equi-joins under bag
semantics keep their result under this, cycles and self-joins included. Where
two bindings alone meet on keys that both repeat, each side becomes one row a
key with its sums and count, so that a hot key's pairs are never made. The
automatic choice asks the catalog's samples: a relation is counted if its
values repeat and a join's key repeats on both of its sides; one row a key
pays if the pairs would be many more than the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.exact import exact_sum, finish, product, weighted_sum
from quernel.operators.relational import COUNT, checksum, equi_join, filter_scan, group_count, residual_equality
from quernel.plans.ir import EquiPred, Query
from quernel.plans.rewrite import join_steps, rewrite
from quernel.plans.textql import validate
from quernel.sources.catalog import Catalog

MODES = ("auto", "on", "off")
#: A join by key pays from so many pairs, and so many for each row of either side, on.
LEAST_PAIRS = 20_000_000
PAIRS_A_ROW = 8


@dataclass(frozen=True)
class Plan:
    """The result's DataFrame, and what was decided on the way."""

    df: DataFrame
    query: Query
    steps: tuple[tuple[int, tuple[str, ...]], ...]
    counted: tuple[int, ...]

    def describe(self) -> str:
        lines = [f"binding {b} (r{self.query.relations[b]}{', counted' if b in self.counted else ''}): {' and '.join(on) or 'scan'}" for b, on in self.steps]
        return "\n".join(lines)


def _needed(query: Query, binding: int) -> list[int]:
    """Columns that joins or sums use; columns only filtered end at the scan."""
    used = [c for p in query.predicates for c in p.sides] + list(query.sums)
    return sorted({c.col for c in used if c.binding == binding})


def _leaf(query: Query, catalog: Catalog, binding: int, mode: str) -> tuple[DataFrame, bool]:
    rel = query.relations[binding]
    needed = _needed(query, binding)
    filters = [(f"c{f.column.col}", f.op, f.value) for f in query.filters if f.column.binding == binding]
    df = filter_scan(catalog.get(rel), filters, [f"c{i}" for i in needed])
    counted = bool(needed) and (mode == "on" or mode == "auto" and catalog.duplicated(rel, needed) and _meets_repeated(query, catalog, binding))
    if counted:
        df = group_count(df, df.columns)
    names = [F.col(f"c{i}").alias(f"b{binding}_c{i}") for i in needed]
    return df.select(*names, *([F.col(COUNT)] if counted else [])), counted


def _meets_repeated(query: Query, catalog: Catalog, binding: int) -> bool:
    """Whether a join of this binding has a key that repeats on both sides."""
    between = [p for p in query.predicates if len({c.binding for c in p.sides}) == 2 and binding in {c.binding for c in p.sides}]
    return any(all(catalog.duplicated(query.relations[c.binding], [c.col]) for c in p.sides) for p in between)


def _join(left: DataFrame, right: DataFrame, binding: int, on: list[EquiPred]) -> DataFrame:
    if COUNT in left.columns and COUNT in right.columns:
        right = right.withColumnRenamed(COUNT, "__m")
    here = [p.sides if p.right.binding == binding else p.sides[::-1] for p in on if p.left.binding != p.right.binding]
    df = equi_join(left, right, [(a.flat, b.flat) for a, b in here])
    if "__m" in df.columns:
        df = df.withColumn(COUNT, product(F.col(COUNT), F.col("__m"))).drop("__m")
    for p in on:
        if p.left.binding == p.right.binding:
            df = residual_equality(df, p.left.flat, p.right.flat)
    return df


def _keys(query: Query, binding: int) -> list[int]:
    return sorted({c.col for p in query.predicates for c in p.sides if c.binding == binding})


def _meets_by_key(query: Query, catalog: Catalog, mode: str) -> bool:
    """Whether both sides of the only join become one row a key: always if on, where pairs are many if auto."""
    if mode == "off" or len(query.relations) != 2 or any(p.left.binding == p.right.binding for p in query.predicates):
        return False
    if mode == "on":
        return True
    sides = [[c.col for p in query.predicates for c in p.sides if c.binding == b] for b in (0, 1)]
    pairs = catalog.pairs(query.relations[0], sides[0], query.relations[1], sides[1])
    return pairs >= max(LEAST_PAIRS, PAIRS_A_ROW * sum(catalog.statistics(rel).rows for rel in query.relations))


def _sums_by_key(query: Query, catalog: Catalog, on: list[EquiPred], numeric: str) -> DataFrame:
    """A side's sums times the other's count, key by key."""
    sides = []
    for binding in (0, 1):
        leaf, _ = _leaf(query, catalog, binding, "off")
        keys = [f"b{binding}_c{i}" for i in _keys(query, binding)]
        sums = dict.fromkeys(c.flat for c in query.sums if c.binding == binding)
        totals = [exact_sum(F.col(c), leaf.schema[c].dataType).alias(f"sum_{c}") for c in sums]
        sides.append(leaf.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{binding}"), *totals))
    pairs = [p.sides if p.left.binding == 0 else p.sides[::-1] for p in on]
    met = equi_join(*sides, [(a.flat, b.flat) for a, b in pairs])
    totals = [weighted_sum(F.col(f"sum_{c.flat}"), F.col(f"n{1 - c.binding}")) for c in query.sums]
    return met.agg(*[finish(t, numeric).alias(f"s{i}") for i, t in enumerate(totals)])


def plan(query: Query, catalog: Catalog, mode: str = "auto", numeric: str = "exact", optimize: bool = True) -> Plan:
    """mode: count multiplicities where statistics say so (auto), everywhere (on) or nowhere (off)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    query = validate(query, catalog.arities)
    query = rewrite(query) if optimize else query
    # a single join against a relation of unique keys gains nothing; two relations must meet for counts to pay
    steps = join_steps(query)
    if _meets_by_key(query, catalog, mode):
        result = _sums_by_key(query, catalog, steps[1][1], numeric)
        weighing = tuple(sorted({1 - c.binding for c in query.sums}))  # whose counts the other side's sums are taken by
        return Plan(result, query, tuple((b, tuple(map(str, on))) for b, on in steps), weighing)
    mode = "off" if len(steps) == 1 and mode == "auto" else mode
    counted: list[int] = []
    df = None
    for at, (binding, on) in enumerate(steps):
        leaf, is_counted = _leaf(query, catalog, binding, mode)
        counted += [binding] * is_counted
        if df is None:
            df = leaf
            for p in on:
                df = residual_equality(df, p.left.flat, p.right.flat)
            continue
        df = _join(df, leaf, binding, on)
        later = {c.flat for _, ps in steps[at + 1 :] for p in ps for c in p.sides} | {c.flat for c in query.sums}
        live = [c for c in df.columns if c in later]
        more = at + 1 < len(steps)
        if more and COUNT in df.columns and len(live) == 1:
            df = group_count(df, live)  # a lone live column repeats a lot: merge before the next join
        else:
            df = df.select(*live, *([COUNT] if COUNT in df.columns else []))
    result = checksum(df, [c.flat for c in query.sums], numeric)
    return Plan(result, query, tuple((b, tuple(map(str, on))) for b, on in steps), tuple(counted))
