"""The registered queries over the generated tables, and SQL that must agree.

The SQL is written by hand against the base tables; it shares nothing with
the engine's own SQL generator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.engine import Engine
from quernel.functions.scratch import new_folder
from quernel.operators.relational import checksum, counted_filter, counted_join, equi_join, filter_scan, group_count, residual_equality, scan
from quernel.plans.textql import parse, to_text
from quernel.sources.catalog import TESTDATA_RELATIONS, Catalog, testdata_catalog
from quernel.sources.colrel import read_colrel, write_colrel
from quernel.sources.tables import ddl, export_all, read_tbl, synthetic, write_tbl
from quernel.streaming.batches import FLUSH, LOADED, serve
from quernel.to_sql import translate

#: name: (text query, FROM, conditions, summed columns)
TEXT_QUERIES: dict[str, tuple[str, str, str, list[str]]] = {
    "q_join2": ("0 1|0.0=1.0|0.4 1.1", "lineitem, orders", "l_orderkey = o_orderkey", ["l_quantity", "o_custkey"]),
    "q_filter_eq": ("0 1|0.0=1.0&0.3=1|0.4 1.0", "lineitem, orders", "l_orderkey = o_orderkey AND l_linenumber = 1", ["l_quantity", "o_orderkey"]),
    "q_filter_lt": ("0 1|0.0=1.0&0.4<10|0.4 1.1", "lineitem, orders", "l_orderkey = o_orderkey AND l_quantity < 10", ["l_quantity", "o_custkey"]),
    "q_filter_gt": ("0 1|0.0=1.0&0.4>40|0.4 1.1", "lineitem, orders", "l_orderkey = o_orderkey AND l_quantity > 40", ["l_quantity", "o_custkey"]),
    "q_filter_range": ("0 1|0.0=1.0&0.4>10&0.4<20|0.4", "lineitem, orders", "l_orderkey = o_orderkey AND l_quantity > 10 AND l_quantity < 20", ["l_quantity"]),
    "q_filter_both": ("0 1|0.0=1.0&0.3=1&1.1<500|0.4 1.1", "lineitem, orders", "l_orderkey = o_orderkey AND l_linenumber = 1 AND o_custkey < 500", ["l_quantity", "o_custkey"]),
    "q_prop": ("0 1|0.0=1.0&1.0>14000|0.4 1.1", "lineitem, orders", "l_orderkey = o_orderkey AND o_orderkey > 14000", ["l_quantity", "o_custkey"]),
    "q_chain3": ("0 1 2|0.0=1.0&1.1=2.0&2.1=7|0.4 2.0", "lineitem, orders, customer", "l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = 7", ["l_quantity", "c_custkey"]),
    "q_chain4": ("0 1 2 5|0.0=1.0&1.1=2.0&2.1=3.0&3.1=2|0.4 3.0", "lineitem, orders, customer, nation", "l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = 2", ["l_quantity", "n_nationkey"]),
    "q_chain5": ("0 1 2 5 6|0.0=1.0&1.1=2.0&2.1=3.0&3.1=4.0&4.0=1|0.4 4.0", "lineitem, orders, customer, nation, region", "l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 1", ["l_quantity", "r_regionkey"]),
    "q_star4": ("0 1 3 4|0.0=1.0&0.2=2.0&0.1=3.0&3.1<10|3.1 2.1 1.1", "lineitem, orders, supplier, part", "l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND p_size < 10", ["p_size", "s_nationkey", "o_custkey"]),
    "q_mn": ("2 3|0.1=1.1|0.0 1.0", "customer, supplier", "c_nationkey = s_nationkey", ["c_custkey", "s_suppkey"]),
    "q_self": ("2 2|0.1=1.1|0.0 1.0", "customer a, customer b", "a.c_nationkey = b.c_nationkey", ["a.c_custkey", "b.c_custkey"]),
    "q_cycle": ("0 1 2 3|0.0=1.0&1.1=2.0&0.2=3.0&2.1=3.1|0.4 3.0", "lineitem, orders, customer, supplier", "l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey", ["l_quantity", "s_suppkey"]),
    "q_multi": ("0 4 3|0.1=1.0&0.2=2.0&1.0=2.0|0.4 1.1", "lineitem, part, supplier", "l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_partkey = s_suppkey", ["l_quantity", "p_size"]),
    "q_dup_pred": ("0 1|0.0=1.0&1.0=0.0|0.4", "lineitem, orders", "l_orderkey = o_orderkey AND o_orderkey = l_orderkey", ["l_quantity"]),
    "q_permuted": ("0 1 2 5|0.0=1.0&2.1=3.0&1.1=2.0|3.1", "lineitem, orders, customer, nation", "l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND o_custkey = c_custkey", ["n_regionkey"]),
    "q_empty": ("0 1|0.0=1.0&0.3=100|0.4 1.1", "lineitem, orders", "l_orderkey = o_orderkey AND l_linenumber = 100", ["l_quantity", "o_custkey"]),
    "q_contra": ("0 1|0.0=1.0&0.0<3&1.0>3|1.0", "lineitem, orders", "l_orderkey = o_orderkey AND l_orderkey < 3 AND o_orderkey > 3", ["o_orderkey"]),
    "q_zero_sum": ("5 6|0.1=1.0&1.0<1|1.0 0.1", "nation, region", "n_regionkey = r_regionkey AND r_regionkey < 1", ["r_regionkey", "n_regionkey"]),
    "q_dup_sel": ("0 1|0.0=1.0&0.4=5|1.1 0.4 0.4", "lineitem, orders", "l_orderkey = o_orderkey AND l_quantity = 5", ["o_custkey", "l_quantity", "l_quantity"]),
    "q_key_only": ("0 3|0.2=1.0|0.2 1.0", "lineitem, supplier", "l_suppkey = s_suppkey", ["l_suppkey", "s_suppkey"]),
    "q_events": ("7 2|0.1=1.0&1.1<12|0.0 1.0", "events, customer", "user_id = c_custkey AND c_nationkey < 12", ["event_id", "c_custkey"]),
    "q_docs": ("8 9|0.0=1.0&1.1=1|0.1 1.0", "documents d, labels l", "d.doc_id = l.doc_id AND l.quality = 1", ["d.n_chars", "l.doc_id"]),
    "q_conv": ("10 9|0.0=1.0|0.1 1.1", "conversations, labels", "conv_id = doc_id", ["turn", "quality"]),
    "q_emb": ("11 11|0.1=1.1|0.0 1.0", "embeddings a, embeddings b", "a.label = b.label", ["a.vec_id", "b.vec_id"]),
    "q_order_nonjoin_filter": ("0 1 2|0.0=1.0&1.1=2.0&2.1=7&0.4>45|0.4 1.0", "lineitem, orders, customer", "l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = 7 AND l_quantity > 45", ["l_quantity", "o_orderkey"]),
}

#: Also with multiplicities everywhere.
COUNTED = ("q_mn", "q_self", "q_emb", "q_cycle", "q_key_only", "q_chain4")
BATCH = ["q_join2", "q_chain3", "q_empty", "q_dup_sel"]


def _sum_sql(name: str) -> str:
    _, tables, where, sums = TEXT_QUERIES[name]
    columns = ", ".join(f"CAST(NULLIF(SUM(CAST({c} AS BIGINT)), 0) AS BIGINT) AS s{i}" for i, c in enumerate(sums))
    return f"SELECT {columns} FROM {tables} WHERE {where}"


def _line_sql(name: str, number: int) -> str:
    n = len(TEXT_QUERIES[name][3])
    line = " || ' ' || ".join(f"COALESCE(CAST(s{i} AS VARCHAR), 'NULL')" for i in range(n))
    return f"SELECT CAST({number} AS BIGINT) AS query_no, {line} AS line FROM ({_sum_sql(name)}) q{number}"


def _text(name: str, mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, testdata_catalog(spark, sf_dir), mode, "bigint").query(TEXT_QUERIES[name][0])


def _table(spark: SparkSession, sf_dir: str, rel: int) -> DataFrame:
    return testdata_catalog(spark, sf_dir).get(rel)


def _colrel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "orders")
    write_colrel(_table(spark, sf_dir, 1), path)
    return read_colrel(spark, path)


def _unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two binary relations of keys from 2^63 on and in between, loaded like any others, joined and summed."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(_high("n_nationkey"), _high("n_regionkey"))
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(_high("r_regionkey"), F.col("r_regionkey").cast("bigint"))
    engine = Engine(spark)
    for name, df in (("nation", nation), ("region", region)):
        path = new_folder(spark, name)
        write_colrel(df, path)
        engine.load(path)
    return engine.query(f"0 1|0.1=1.0&0.0>{2**63 + 3}|0.0 1.1 0.1")


def _high(column: str) -> Column:
    return (F.col(column).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").alias(column)


def _wide_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums beyond 64 bits of values near 2^62, over pairs of rows."""
    catalog = Catalog(spark)
    for rel, (key, value) in ((2, ("c1", "c0")), (3, ("c1", "c0"))):
        catalog.add(_table(spark, sf_dir, rel).select(F.col(key).alias("k"), (F.col(value) + 2**62).alias("v")))
    return Engine(spark, catalog).query("0 1|0.0=1.0|0.1 1.1")


def _tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "customer") + ".tbl"
    write_tbl(_table(spark, sf_dir, 2), path)
    return read_tbl(spark, path, 2)


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """A few lines of text, numbered."""
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "query_no bigint, line string")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one relation from both files of its export."""
    binary, text, _ = export_all(_table(spark, sf_dir, 1), new_folder(spark, "export"), 0)
    return read_colrel(spark, binary).withColumn("form", F.lit("binary")).unionAll(read_tbl(spark, text, 2).withColumn("form", F.lit("text")))


def _protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the line protocol answers: two relations by path, one batch that is flushed and one that the end of input closes."""
    folder = new_folder(spark, "protocol")
    paths = [export_all(_table(spark, sf_dir, rel), folder, i)[i] for i, rel in enumerate((2, 3))]  # one binary, one text
    asked = ["0 1|0.1=1.1|0.0 1.0", "0 1|0.1=1.1&0.0<1|0.0", FLUSH, "0 0|0.1=1.1|0.0 1.0"]
    return _lines(spark, list(serve(Engine(spark), [*paths, LOADED, *asked])))


PROTOCOL_SQL = f"""{_line_sql("q_mn", 0)}
UNION ALL SELECT 1, 'NULL'
UNION ALL {_line_sql("q_self", 2)}"""


def _empty_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join with a relation of no rows, whose statistics are empty too."""
    catalog = Catalog(spark)
    catalog.add(_table(spark, sf_dir, 2))
    catalog.add(synthetic(spark, 0, 3))
    return Engine(spark, catalog, numeric="bigint").query("0 1|0.0=1.0|0.1 1.2")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every relation as the statistics phase counts them."""
    catalog = testdata_catalog(spark, sf_dir)
    catalog.analyze()
    return spark.createDataFrame([(rel, catalog.statistics(rel).rows) for rel in range(len(catalog))], "rel bigint, n bigint")


def _duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per different value; of relations this small the sample has all rows."""
    catalog = testdata_catalog(spark, sf_dir)
    asked = [(5, 0), (5, 1), (6, 0)]
    return spark.createDataFrame([(rel, col, catalog.duplication(rel, [col])) for rel, col in asked], "rel bigint, col bigint, duplication double")


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine counts over a batch that it runs to the end."""
    engine = Engine(spark, testdata_catalog(spark, sf_dir))
    engine.run([TEXT_QUERIES[q][0] for q in BATCH])
    told = engine.counters.taken()
    return spark.createDataFrame([(name, told.get(name, 0)) for name in ("queries", "scans", "joins", "results", "null_results")], "counter string, n bigint")


def _counted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = group_count(_table(spark, sf_dir, 2).select("c1"), ["c1"])
    right = group_count(_table(spark, sf_dir, 3).select(F.col("c1").alias("d1")), ["d1"])
    return counted_join(left, right, [("c1", "d1")], ["c1"]).select("c1", F.col("__n").cast("bigint").alias("n"))


def _join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(_table(spark, sf_dir, 1), ["c0", "c1"])
    customer = filter_scan(_table(spark, sf_dir, 2), [("c1", "=", 3)]).select(F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    return equi_join(orders, customer, [("c1", "d0")])


OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "op_scan_project": (lambda s, d: scan(_table(s, d, 0), ["c0", "c3"]), "SELECT CAST(l_orderkey AS BIGINT) AS c0, CAST(l_linenumber AS BIGINT) AS c3 FROM lineitem"),
    "op_filter_eq": (lambda s, d: filter_scan(_table(s, d, 1), [("c1", "=", 7)]), "SELECT CAST(o_orderkey AS BIGINT) AS c0, CAST(o_custkey AS BIGINT) AS c1 FROM orders WHERE o_custkey = 7"),
    "op_filter_lt": (lambda s, d: filter_scan(_table(s, d, 1), [("c1", "<", 50)], ["c0"]), "SELECT CAST(o_orderkey AS BIGINT) AS c0 FROM orders WHERE o_custkey < 50"),
    "op_filter_gt": (lambda s, d: filter_scan(_table(s, d, 1), [("c1", ">", 1400)], ["c0"]), "SELECT CAST(o_orderkey AS BIGINT) AS c0 FROM orders WHERE o_custkey > 1400"),
    "op_filter_conj": (lambda s, d: filter_scan(_table(s, d, 0), [("c4", ">", 10), ("c4", "<", 20), ("c3", "=", 2)], ["c0", "c4"]), "SELECT CAST(l_orderkey AS BIGINT) AS c0, CAST(l_quantity AS BIGINT) AS c4 FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_linenumber = 2"),
    "op_join_rows": (_join_rows, "SELECT CAST(o_orderkey AS BIGINT) AS c0, CAST(o_custkey AS BIGINT) AS c1, CAST(c_custkey AS BIGINT) AS d0, CAST(c_nationkey AS BIGINT) AS d1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"),
    "op_self_equality": (lambda s, d: residual_equality(scan(_table(s, d, 0), ["c0", "c1", "c2"]), "c1", "c2"), "SELECT CAST(l_orderkey AS BIGINT) AS c0, CAST(l_partkey AS BIGINT) AS c1, CAST(l_suppkey AS BIGINT) AS c2 FROM lineitem WHERE l_partkey = l_suppkey"),
    "op_group_count": (lambda s, d: group_count(_table(s, d, 0), ["c2"]).select("c2", F.col("__n").alias("n")), "SELECT CAST(l_suppkey AS BIGINT) AS c2, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey"),
    "op_counted_filter": (lambda s, d: counted_filter(_table(s, d, 0), "c4", [(">", 30)]).select("c4", F.col("__n").alias("n")), "SELECT CAST(l_quantity AS BIGINT) AS c4, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY l_quantity"),
    "op_counted_join": (_counted_join, "SELECT CAST(c_nationkey AS BIGINT) AS c1, CAST(COUNT(*) AS BIGINT) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_nationkey"),
    "op_weighted_sum": (lambda s, d: checksum(group_count(_table(s, d, 0), ["c2", "c4"]), ["c2", "c4"], "bigint"), "SELECT CAST(NULLIF(SUM(l_suppkey), 0) AS BIGINT) AS s0, CAST(NULLIF(SUM(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS s1 FROM lineitem"),
    "op_checksum": (lambda s, d: checksum(_table(s, d, 1), ["c0", "c1", "c1"], "bigint"), "SELECT CAST(NULLIF(SUM(o_orderkey), 0) AS BIGINT) AS s0, CAST(NULLIF(SUM(o_custkey), 0) AS BIGINT) AS s1, CAST(NULLIF(SUM(o_custkey), 0) AS BIGINT) AS s2 FROM orders"),
    "op_batch": (lambda s, d: Engine(s, testdata_catalog(s, d)).batch([TEXT_QUERIES[q][0] for q in BATCH]), " UNION ALL ".join(_line_sql(q, i) for i, q in enumerate(BATCH))),
    "op_synthetic": (lambda s, d: synthetic(s, 1000, 3), "SELECT range AS c0, range AS c1, range AS c2 FROM range(1000)"),
    "op_colrel_roundtrip": (_colrel, "SELECT CAST(o_orderkey AS BIGINT) AS c0, CAST(o_custkey AS BIGINT) AS c1 FROM orders"),
    "op_tbl_roundtrip": (_tbl, "SELECT CAST(c_custkey AS BIGINT) AS c0, CAST(c_nationkey AS BIGINT) AS c1 FROM customer"),
    "op_colrel_unsigned": (_unsigned, "SELECT CAST(SUM(CAST(n_nationkey AS HUGEINT) + 9223372036854775808) AS DECIMAL(38,0)) AS s0, CAST(SUM(r_regionkey) AS DECIMAL(38,0)) AS s1, CAST(SUM(CAST(n_regionkey AS HUGEINT) + 9223372036854775808) AS DECIMAL(38,0)) AS s2 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3"),
    "q_wide_sum": (_wide_sum, "SELECT CAST(SUM(CAST(c_custkey AS HUGEINT) + 4611686018427387904) AS DECIMAL(38,0)) AS s0, CAST(SUM(CAST(s_suppkey AS HUGEINT) + 4611686018427387904) AS DECIMAL(38,0)) AS s1 FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "q_empty_relation": (_empty_relation, "SELECT CAST(NULL AS BIGINT) AS s0, CAST(NULL AS BIGINT) AS s1"),
    "op_export_all": (_exported, "SELECT CAST(o_orderkey AS BIGINT) AS c0, CAST(o_custkey AS BIGINT) AS c1, form FROM orders, (VALUES ('binary'), ('text')) f(form)"),
    "op_protocol": (_protocol, PROTOCOL_SQL),
    "op_ddl": (lambda s, d: _lines(s, [ddl(len(_table(s, d, rel).columns), rel) for rel in (1, 6)]), "SELECT CAST(0 AS BIGINT) AS query_no, 'CREATE TABLE r1 (c0 bigint,c1 bigint);' || chr(10) || 'copy r1 from ''r1.tbl'' delimiter ''|'';' || chr(10) AS line UNION ALL SELECT 1, 'CREATE TABLE r6 (c0 bigint);' || chr(10) || 'copy r6 from ''r6.tbl'' delimiter ''|'';' || chr(10)"),
    "op_query_text": (lambda s, d: _lines(s, [to_text(parse(q)) for q, *_ in TEXT_QUERIES.values()]), " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_no, '{q}' AS line" for i, (q, *_) in enumerate(TEXT_QUERIES.values()))),
    "op_to_sql": (lambda s, d: _lines(s, list(translate(["2 3|0.1=1.1|0.0 1.0", FLUSH, "1|0.1<50|0.0"]))), """SELECT CAST(0 AS BIGINT) AS query_no, 'SELECT SUM("0".c0), SUM("1".c0) FROM r2 "0", r3 "1" WHERE "0".c1 = "1".c1;' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'SELECT SUM("0".c0) FROM r1 "0" WHERE "0".c1 < 50;'"""),
    "op_statistics": (_statistics, " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS rel, COUNT(*) AS n FROM {table}" for i, table in enumerate(TESTDATA_RELATIONS))),
    "op_duplication": (_duplication, " UNION ALL ".join(f"SELECT CAST({rel} AS BIGINT) AS rel, CAST({col} AS BIGINT) AS col, COUNT(*) / CAST(COUNT(DISTINCT {name}) AS DOUBLE) AS duplication FROM {table}" for rel, col, table, name in ((5, 0, "nation", "n_nationkey"), (5, 1, "nation", "n_regionkey"), (6, 0, "region", "r_regionkey")))),
    "op_counters": (_counters, "SELECT * FROM (VALUES ('queries', CAST(4 AS BIGINT)), ('scans', 9), ('joins', 5), ('results', 4), ('null_results', 1)) c(counter, n)"),
    "op_generated_sql": (lambda s, d: Engine(s, testdata_catalog(s, d)).sql(TEXT_QUERIES["q_cycle"][0]).select(F.col("s0").cast("bigint"), F.col("s1").cast("bigint")), _sum_sql("q_cycle")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _text(name, "auto") for name in TEXT_QUERIES}
    found |= {f"{name}_counted": _text(name, "on") for name in COUNTED}
    found |= {name: run for name, (run, _) in OPERATORS.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: _sum_sql(name) for name in TEXT_QUERIES}
    found |= {f"{name}_counted": _sum_sql(name) for name in COUNTED}
    found |= {name: sql for name, (_, sql) in OPERATORS.items()}
    return found
