import itertools
import random

import pytest
from pyspark.sql import functions as F

from quernel.engine import Engine
from quernel.operators.relational import checksum, filter_scan, group_count, residual_equality
from quernel.plans.ir import QueryError
from quernel.sources.catalog import Catalog
from quernel.sources.tables import synthetic
from quernel.streaming.batches import serve
from quernel.streaming.monitor import Monitor


#: Relations of different widths and lengths: a key, keys that repeat, and values that no other relation has.
TABLES = [
    [(i, 3 * i, i % 2) for i in range(13)],
    [(i % 5, i) for i in range(1, 18)],
    [(2 * i, i % 3, 40 - i, i) for i in range(7)],
    [(9,), (4,), (4,)],
]
#: Every shape of query: chains, stars, cycles, self-joins, four and five bindings, filters on joined and on other columns, one relation.
CASES = [
    "1 0|0.0=1.0|1.1 0.1", "2 1 0|0.3=1.0&1.1=2.0|0.2 2.1 1.1", "0 1 2|0.0=1.1&0.2=2.1|1.0 2.2",
    "0 1 2 3|0.0=1.1&0.0=2.0&0.0=3.0|0.1 1.0 2.2 3.0", "1 1|0.0=1.0|0.1", "1 1 1|0.0=1.0&1.1=2.1|2.0 0.1", "3 3 3|0.0=1.0&1.0=2.0|2.0",
    "0 1 2|0.0=1.0&1.1=2.3&2.1=0.2|0.1", "2 0 1 3|0.3=1.0&1.0=2.1&2.1=3.0&3.0=0.2|3.0 2.0", "1 2 0 1 3|0.0=1.1&1.3=2.0&2.2=3.0&3.1=4.0|4.0 0.1",
    "0 1|0.0=1.1&0.2=1|0.1 1.1", "0 1 2|0.0=1.1&1.0=2.3&2.2>36&0.1<30|2.2 0.1", "1 0|0.1=1.0&1.1=12|0.0 1.1", "1 0|0.0=1.0&0.1>3&0.1<9&1.2=0|0.1 1.1 1.1",
    "1 2|0.0=1.1&0.0<2&1.1>1|0.1", "0 3|0.0=1.0&0.0>20|0.1 1.0", "2|0.2>36|0.0", "1||0.1 0.0", "0 0|0.0=1.0&0.1=1.1&1.2=1|1.1", "2 1|0.0=0.3&0.1=1.0|1.1",
]


@pytest.fixture(scope="module")
def own(spark):
    catalog = Catalog(spark)
    for rows in TABLES:
        catalog.add(spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(len(rows[0])))).coalesce(1))
    return Engine(spark, catalog)


@pytest.mark.parametrize("mode", ["auto", "on", "off"])
def test_queries_agree_with_nested_loops(own, mode):
    want = [brute(TABLES, q) for q in CASES]
    assert "NULL" in " ".join(want) and own.run(CASES, mode) == want
    lines = own.batch(CASES[:6], mode).orderBy("query_no").collect()
    assert [r.line for r in lines] == want[:6]


def test_errors(own):
    for text in ("0 9|0.0=1.0|0.0", "0 1|0.0=1.7|0.0", "0 1 2|0.0=1.0|2.0", "0 1|0.0=1.0|"):
        with pytest.raises((QueryError, ValueError)):
            own.query(text)
    with pytest.raises(ValueError):
        own.query("0||0.0", mode="never")


def test_generated_sql_agrees(own):
    for text in CASES:
        assert own.sql(text).collect() == own.query(text).collect() == own.sql(text, rewritten=False).collect()


def test_a_filter_on_any_column_leads_its_joins(own):
    """The binding with the filter comes first, although its filtered column joins nothing."""
    plan = own.plan("0 1 2|0.0=1.1&1.0=2.3&2.2=38|0.1")
    assert [b for b, _ in plan.steps] == [1, 2, 0] and plan.df.first()[0] == int(brute(TABLES, "0 1 2|0.0=1.1&1.0=2.3&2.2=38|0.1"))


def brute(tables, text):
    """Nested loops in Python, unoptimised."""
    from quernel.plans.textql import parse

    q = parse(text)
    test = {"<": int.__lt__, ">": int.__gt__, "=": int.__eq__}
    totals = [0] * len(q.sums)
    kept = []
    for b, rel in enumerate(q.relations):
        own = [f for f in q.filters if f.column.binding == b]
        kept.append([r for r in tables[rel] if all(test[f.op](r[f.column.col], f.value) for f in own)])
    for rows in itertools.product(*kept):
        if all(rows[p.left.binding][p.left.col] == rows[p.right.binding][p.right.col] for p in q.predicates):
            for i, c in enumerate(q.sums):
                totals[i] += rows[c.binding][c.col]
    return " ".join(str(t) if t else "NULL" for t in totals)


def random_query(rnd, tables):
    n = rnd.randint(2, 4)
    rels = [rnd.randrange(len(tables)) for _ in range(n)]
    col = lambda b: f"{b}.{rnd.randrange(len(tables[rels[b]][0]))}"
    preds = [f"{col(rnd.randrange(b))}={col(b)}" for b in range(1, n)]
    if rnd.random() < 0.5:
        preds.append(f"{col(rnd.randrange(n))}={col(rnd.randrange(n))}")
    preds += [f"{col(rnd.randrange(n))}{rnd.choice('<>=')}{rnd.randint(0, 6)}" for _ in range(rnd.randint(0, 3))]
    rnd.shuffle(preds)
    return f"{' '.join(map(str, rels))}|{'&'.join(preds)}|{' '.join(col(rnd.randrange(n)) for _ in range(rnd.randint(1, 3)))}"


def test_random_queries_agree_with_nested_loops(spark):
    rnd = random.Random(11)
    tables = [[tuple(rnd.randint(0, 5) for _ in range(k)) for _ in range(n)] for k, n in ((2, 14), (3, 11), (1, 9))]
    catalog = Catalog(spark)
    for rows in tables:
        catalog.add(spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(len(rows[0])))).coalesce(1))
    engine = Engine(spark, catalog)
    texts = [random_query(rnd, tables) for _ in range(14)]
    want = [brute(tables, t) for t in texts]
    for mode in ("on", "off", "auto"):
        assert engine.run(texts, mode) == want


def test_big_sums_are_exact(spark):
    catalog = Catalog(spark)
    big = 2**62
    catalog.add(spark.createDataFrame([(1, big), (1, big + 1), (2, -5)], "a long, b long"))
    catalog.add(spark.createDataFrame([(1,), (1,), (1,)], "a long"))
    total = 3 * (2 * big + 1)
    for mode in ("on", "off"):
        assert Engine(spark, catalog, mode).query("0 1|0.0=1.0|0.1").first()[0] == total
        assert Engine(spark, catalog, mode, "wrap64").query("0 1|0.0=1.0|0.1").first()[0] == total % 2**64
    assert Engine(spark, catalog, "off", "exact").query("0|0.0=2|0.1").first()[0] == -5


def test_unsigned_values(spark):
    catalog = Catalog(spark)
    catalog.add(spark.createDataFrame([(str(2**64 - 1),), (str(2**63),), ("3",)], "a string").select(F.col("a").cast("decimal(20,0)")))
    engine = Engine(spark, catalog, numeric="wrap64")
    assert engine.query(f"0|0.0>{2**63 - 1}|0.0").first()[0] == 2**63 - 1
    assert engine.query(f"0|0.0={2**64 - 1}|0.0").first()[0] == 2**64 - 1
    assert engine.query("0||0.0").first()[0] == (2**64 - 1 + 2**63 + 3) % 2**64


def test_empty_relation(spark):
    catalog = Catalog(spark)
    catalog.add(synthetic(spark, 0, 3))
    catalog.add(synthetic(spark, 4, 2))
    for mode in ("auto", "on", "off"):
        assert Engine(spark, catalog, mode).run(["0 1|0.0=1.0|1.1 0.2", "0||0.0"]) == ["NULL NULL", "NULL"]


def test_multiplicities_are_counted_where_values_repeat(spark):
    catalog = Catalog(spark)
    catalog.add(spark.range(30_000).select((F.col("id") % 3).alias("a")))
    catalog.add(spark.range(30_000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b")))
    plan = Engine(spark, catalog).plan("0 1|0.0=1.0|1.1")
    assert plan.counted == (0,)
    assert plan.df.first()[0] == 10_000 * sum(range(30_000))
    assert "counted" in plan.describe()


def test_pushdown_and_pruning(spark, sf):
    from quernel.sources.catalog import testdata_catalog

    df = Engine(spark, testdata_catalog(spark, sf), "off").query("0 1|0.0=1.0&1.0>14000|0.4 1.1")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_orderkey,14000)" in text and "GreaterThan(o_orderkey,14000)" in text
    assert "l_partkey" not in text


def test_single_operators(spark):
    r1 = synthetic(spark, 5, 3)
    assert filter_scan(r1, [("c0", "=", 2)]).count() == 1 and filter_scan(r1, [("c0", ">", 2)], ["c1"]).columns == ["c1"]
    assert residual_equality(r1, "c0", "c2").count() == 5
    assert checksum(group_count(r1.union(r1), ["c1"]), ["c1", "c1"]).first() == (20, 20)


def test_protocol(spark, tmp_path):
    from quernel.sources.colrel import write_colrel
    from quernel.sources.tables import write_tbl

    write_colrel(synthetic(spark, 6, 2), str(tmp_path / "r0"))
    write_tbl(synthetic(spark, 6, 3), str(tmp_path / "r1.tbl"))
    lines = [str(tmp_path / "r0"), str(tmp_path / "r1.tbl"), "Done", "0 1|0.0=1.0|0.1", "0||0.0", "F", "1||1.0".replace("1.0", "0.2")]
    assert list(serve(Engine(spark), lines)) == ["15", "15", "15"]


def test_whole_self_joins_by_key(spark, sf):
    import duckdb

    from quernel.queries import oracle_sql, queries

    for name, table in (("q_self", "customer"), ("q_emb", "embeddings")):
        sql = oracle_sql()[name].replace(f"{table} a, {table} b", f"'{sf}/{table}.parquet' a, '{sf}/{table}.parquet' b")
        want = duckdb.sql(sql).fetchall()[0]
        assert tuple(queries()[name](spark, sf).first()) == want
        counted = queries()[f"{name}_counted"](spark, sf)
        assert tuple(counted.first()) == want
        # both sides are one row a key before they meet
        assert counted._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_statistics(spark):
    catalog = Catalog(spark)
    catalog.add(spark.range(100_000).repartition(4).select(F.col("id").alias("a"), (F.col("id") % 10).alias("b"), ((F.col("id") % 10).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("c")))
    catalog.add(spark.range(50).select((F.col("id") % 10).alias("b"), ((F.col("id") % 10).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("c")))
    catalog.add(spark.createDataFrame([], "a long"))
    catalog.analyze()
    assert catalog.statistics(0).rows == 100_000 and 20_000 <= len(catalog.statistics(0).sample[0]) <= 40_000
    assert catalog.duplicated(0, [1]) and not catalog.duplicated(0, [0]) and not catalog.duplicated(0, [0, 1]) and not catalog.duplicated(2, [0])
    for columns in (([1], [0]), ([2], [1]), ([1, 2], [0, 1])):
        assert catalog.pairs(0, columns[0], 1, columns[1]) == pytest.approx(500_000, rel=0.01)
    assert catalog.pairs(0, [0], 1, [0]) == pytest.approx(50, abs=40) and catalog.pairs(0, [0], 2, [0]) == 0
    # the first rows of a sorted relation repeat their key; all of them are many keys
    catalog.add(spark.range(200_000, numPartitions=2).select((F.col("id") / 4).cast("long").alias("k")))
    assert not catalog.duplicated(3, [0])
    assert Engine(spark, catalog).plan("3 0|0.0=1.0|1.0").counted == ()


def test_counters_and_monitor(own):
    before, told = own.counters.taken(), []
    with Monitor(own, 0.01, told.append):
        assert own.run(["0 1|0.0=1.1|0.1", "0 3|0.0=1.0&0.0>20|0.1 1.0"]) == [brute(TABLES, "0 1|0.0=1.1|0.1"), "NULL NULL"]
    gained = {k: v - before.get(k, 0) for k, v in own.counters.taken().items()}
    assert (gained["queries"], gained["scans"], gained["joins"], gained["results"], gained["null_results"]) == (2, 4, 2, 2, 1)
    assert any("jobs" in line and "queries" in line for line in told)


def test_counts_beyond_64_bits(spark):
    """Four relations of 2^17 equal rows each meet 2^68 times."""
    catalog = Catalog(spark)
    catalog.add(spark.range(1 << 17).select(F.lit(1).alias("k")))
    total = Engine(spark, catalog, "on").query("0 0 0 0|0.0=1.0&1.0=2.0&2.0=3.0|3.0").first()[0]
    assert int(total) == 1 << 68


def test_joins_by_key_agree_with_nested_loops(spark):
    rows = [(k, None if k == 2 else v) for k, v in ((1, 5), (1, -5), (1, 7), (2, 3), (2, 4), (None, 9), (3, 1))]
    catalog = Catalog(spark)
    catalog.add(spark.createDataFrame(rows, "a long, b long"))
    for text in ("0 0|0.0=1.0|0.1 1.1 0.0", "0 0|0.0=1.0&1.1>4|0.1 1.1 1.1", "0 0|0.0=1.0&0.1=1.1|1.1 0.0", "0 0|0.0=1.0&0.0=1.1|0.1", "0 0|0.0=1.0&0.1>100|0.1"):
        plain, *others = [tuple(Engine(spark, catalog, mode, numeric).query(text).first()) for mode, numeric in (("off", "bigint"), ("on", "bigint"), ("auto", "bigint"), ("on", "exact"))]
        assert all(o == plain for o in others), text


@pytest.mark.parametrize("name", ["q_empty_relation", "op_protocol", "op_ddl", "op_query_text", "op_to_sql", "op_statistics", "op_duplication", "op_counters"])
def test_queries_of_tools_agree_with_sql(spark, name):
    import os

    import duckdb

    from quernel.queries import oracle_sql, queries

    small = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for file in os.listdir(small):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    got, want = queries()[name](spark, small), db.sql(oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
