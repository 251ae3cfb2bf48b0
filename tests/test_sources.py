import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quernel.engine import Engine
from quernel.functions import scratch
from quernel.sources import colrel
from quernel.sources.tables import create_table, ddl, export_all, load_relation, read_tbl, synthetic, write_tbl


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_binary_round_trip(spark, tmp_path, monkeypatch):
    df = synthetic(spark, 640, 6).withColumn("c3", F.col("c0") * 7)
    colrel.write_colrel(df, str(tmp_path / "r"))
    assert rows_of(colrel.read_colrel(spark, str(tmp_path / "r"))) == rows_of(df)
    colrel.write_colrel(df.limit(3), str(tmp_path / "r"), single=True)
    files = list((tmp_path / "r").iterdir())
    assert len(files) == 1 and rows_of(colrel.read_colrel(spark, str(files[0]))) == [(i, i, i, 7 * i, i, i) for i in range(3)]


def test_layout(spark, tmp_path):
    path = tmp_path / "x.colrel"
    path.write_bytes(struct.pack("<8Q", 3, 2, 1, 2, 3, 10, 20, 30))
    assert rows_of(colrel.read_colrel(spark, str(path))) == [(1, 10), (2, 20), (3, 30)]
    assert [(p.start, p.stop) for p in colrel._Reader(str(path), None).partitions()] == [(0, 3)]


def test_unsigned(spark, tmp_path):
    path = tmp_path / "x.colrel"
    path.write_bytes(struct.pack("<4Q", 2, 1, 2**64 - 1, 5))
    assert sorted(int(r[0]) for r in colrel.read_colrel(spark, str(path), unsigned=True).collect()) == [5, 2**64 - 1]
    with pytest.raises(Exception, match="2\\^63"):
        colrel.read_colrel(spark, str(path)).collect()


def test_any_unsigned_value_is_loaded(spark, tmp_path):
    """By the normal door, binary and text: columns with values from 2^63 on are wide, the others are not."""
    rows = [(2**64 - 1, 5), (2**63, 6), (7, 2**63 - 1)]
    wide = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "a string, b string").select(F.col("a").cast("decimal(20,0)"), F.col("b").cast("decimal(20,0)"))
    colrel.write_colrel(wide, str(tmp_path / "bin"))
    write_tbl(wide, str(tmp_path / "text.tbl"))
    engine = Engine(spark)
    for name in ("bin", "text.tbl"):
        df = load_relation(spark, str(tmp_path / name))
        assert [k for _, k in df.dtypes] == ["decimal(20,0)", "bigint"] and sorted((int(a), int(b)) for a, b in df.collect()) == sorted(rows)
        engine.load(str(tmp_path / name))
    assert engine.run(["0 1|0.0=1.0|0.0 1.1", f"0 1|0.0=1.0&0.0>{2**63 - 1}&1.0<{2**64 - 1}|0.0", "0 1|0.1=1.1&0.1=5|1.0"]) == [f"{2**64 + 2**63 + 6} {2**63 + 10}", str(2**63), str(2**64 - 1)]


def test_binary_relations_are_read_by_column(spark, tmp_path):
    colrel.write_colrel(synthetic(spark, 50, 4), str(tmp_path / "r"))
    plan = load_relation(spark, str(tmp_path / "r")).where("c1 > 5").select("c2")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c1,5)" in plan and "c3" not in plan


def test_writer_takes_what_the_format_has(spark, tmp_path):
    for bad in ("cast(null as bigint)", "-1L", "1.5D"):
        with pytest.raises(Exception, match="the format has no"):
            colrel.write_colrel(spark.range(3).selectExpr(f"{bad} as a"), str(tmp_path / "x"))


def test_scratch_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        def __init__(self, master):
            self.conf = Conf()
            self.sparkContext = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), setCheckpointDir=lambda folder: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(Session("spark://host:7077"))
    assert scratch.scratch_folder(Session("local[4]")).startswith("file:///")
    monkeypatch.setattr(Conf, "get", lambda self, key, default=None: "hdfs://shared/scratch/")
    assert scratch.scratch_folder(Session("yarn")) == "hdfs://shared/scratch"
    monkeypatch.undo()
    kept = scratch.materialize(spark.range(10), "kept")
    assert kept.count() == 10 and kept.inputFiles()[0].startswith("file:")
    scratch.forget(kept)
    assert not scratch.hadoop(spark, kept.inputFiles()[0])[1].exists(scratch.hadoop(spark, kept.inputFiles()[0])[0])
    scratch.write_text(spark, f"{scratch.scratch_folder(spark)}/a.txt", "é\n")
    assert scratch.read_text(spark, f"{scratch.scratch_folder(spark)}/a.txt") == "é\n" and scratch.read_text(spark, "/nowhere/at/all") == ""


def test_empty_and_broken(spark, tmp_path):
    (tmp_path / "e.colrel").write_bytes(struct.pack("<2Q", 0, 0))
    assert colrel.read_colrel(spark, str(tmp_path / "e.colrel")).count() == 0
    (tmp_path / "e3.colrel").write_bytes(struct.pack("<2Q", 0, 3))
    empty = colrel.read_colrel(spark, str(tmp_path / "e3.colrel"))
    assert empty.count() == 0 and len(empty.columns) == 3
    (tmp_path / "short.colrel").write_bytes(b"1234")
    (tmp_path / "cut.colrel").write_bytes(struct.pack("<3Q", 2, 1, 5))
    for name in ("short.colrel", "cut.colrel", "missing.colrel"):
        with pytest.raises(Exception):
            colrel.read_colrel(spark, str(tmp_path / name))


def test_row_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(colrel, "ROWS_PER_SPLIT", 10)
    path = tmp_path / "x.colrel"
    path.write_bytes(struct.pack("<2Q", 25, 1) + struct.pack("<25Q", *range(25)))
    reader = colrel._Reader(str(path), spark.range(1).select(F.col("id").alias("c0")).schema)
    parts = reader.partitions()
    assert len(parts) == 3
    assert [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()] == list(range(25))


def test_text(spark, tmp_path):
    write_tbl(synthetic(spark, 333, 3).coalesce(1), str(tmp_path / "t.tbl"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t.tbl").glob("part-*")))
    assert text == "".join(f"{i}|{i}|{i}|\n" for i in range(333))
    assert rows_of(read_tbl(spark, str(tmp_path / "t.tbl"), 3)) == [(i, i, i) for i in range(333)]
    (tmp_path / "bad.tbl").write_text("1|x|\n")
    with pytest.raises(Exception):
        read_tbl(spark, str(tmp_path / "bad.tbl"), 2).collect()


def test_ddl_and_export(spark, tmp_path):
    assert ddl(2, 8) == "CREATE TABLE r8 (c0 bigint,c1 bigint);\ncopy r8 from 'r8.tbl' delimiter '|';\n"
    export_all(synthetic(spark, 4, 2), str(tmp_path), 0)
    export_all(synthetic(spark, 5, 1), str(tmp_path), 1)
    assert (tmp_path / "relations.init").read_text() == "r0\nr1\n"
    assert load_relation(spark, str(tmp_path / "r0")).count() == load_relation(spark, str(tmp_path / "r0.tbl")).count() == 4
    create_table(spark, synthetic(spark, 4, 2), 77)
    assert spark.table("r77").count() == 4
    spark.sql("DROP TABLE r77")
