"""The binary column-major relation format, as a Spark data source.

Layout, little-endian: u64 rows, u64 columns, then each column's rows as u64,
one column after another. A relation is one file or a folder of such files.
Read in row ranges, so a file of any size spreads over many tasks; any store
that pyarrow can open is read (a bare path is a local or mounted one).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER_BYTES = 16
ROWS_PER_SPLIT = 4_000_000
ROWS_PER_BATCH = 65_536
SUFFIX = ".colrel"


class RelationFormatError(ValueError):
    """The file is missing, too short, or not of this layout."""


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return store, inner


def _files(path: str) -> list[str]:
    store, inner = _open(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise RelationFormatError(f"no relation at {path}")
    if info.type == fs.FileType.Directory:
        return sorted(x.path for x in store.get_file_info(fs.FileSelector(inner)) if x.path.endswith(SUFFIX))
    return [inner]


def read_header(path: str, inner: str) -> tuple[int, int]:
    store, _ = _open(path)
    with store.open_input_file(inner) as f:
        head = f.read(HEADER_BYTES)
        if len(head) < HEADER_BYTES:
            raise RelationFormatError(f"{inner} is shorter than a header")
        rows, cols = (int(x) for x in np.frombuffer(head, "<u8"))
        if f.size() != HEADER_BYTES + 8 * rows * cols:
            raise RelationFormatError(f"{inner} has {f.size()} bytes; its header says {rows} rows of {cols} columns")
    return rows, cols


@dataclass
class RowRange(InputPartition):
    file: str
    start: int
    stop: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, bits: bool = False):
        self.path, self.schema, self.bits = path, schema, bits

    def partitions(self):
        ranges = []
        for file in _files(self.path):
            rows, _ = read_header(self.path, file)
            ranges += [RowRange(file, i, min(rows, i + ROWS_PER_SPLIT), rows) for i in range(0, rows, ROWS_PER_SPLIT)]
        return ranges or [RowRange("", 0, 0, 0)]

    def read(self, part: RowRange):
        if part.start >= part.stop:
            return
        store, _ = _open(self.path)
        wide = [isinstance(f.dataType, T.DecimalType) for f in self.schema]
        with store.open_input_file(part.file) as f:
            for i in range(part.start, part.stop, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, part.stop - i)
                columns = []
                for c, is_wide in enumerate(wide):
                    values = np.frombuffer(f.read_at(8 * n, HEADER_BYTES + 8 * (c * part.rows + i)), "<u8")
                    if is_wide:
                        columns.append(pa.array(values).cast(pa.decimal128(20, 0)))
                    elif n and not self.bits and int(values.max()) >> 63:
                        raise RelationFormatError(f"{part.file} column {c} has values over 2^63; read it with unsigned=true")
                    else:
                        columns.append(pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema])


def _unsigned_bytes(values: pa.Array) -> bytes:
    """The values as u64; null, negative and fractional ones have no place in the format."""
    if values.null_count:
        raise RelationFormatError("the format has no nulls")
    if pa.types.is_decimal(values.type):
        return np.array([int(v) for v in values.to_pylist()], "<u8").tobytes()
    if not pa.types.is_integer(values.type):
        raise RelationFormatError(f"the format has no {values.type}")
    plain = values.to_numpy(zero_copy_only=False)
    if len(plain) and plain.min() < 0:
        raise RelationFormatError("the format has no negative values")
    return plain.astype("<u8").tobytes()


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _Writer(DataSourceArrowWriter):
    """One file per task; a failed or repeated task leaves no file that is read.

    Columns grow side by side in files of the task's own, as the number of
    rows, and so each one's place, is known at the end only.
    """

    def __init__(self, path: str, arity: int, overwrite: bool):
        self.path, self.arity, self.overwrite = path, arity, overwrite

    def write(self, batches):
        rows = 0
        with ExitStack() as held:
            columns = [held.enter_context(tempfile.TemporaryFile()) for _ in range(self.arity)]
            for batch in batches:
                rows += batch.num_rows
                for file, values in zip(columns, batch.columns, strict=True):
                    file.write(_unsigned_bytes(values))
            store, inner = _open(self.path)
            store.create_dir(inner, recursive=True)
            name = f"{inner}/part-{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(name) as f:
                f.write(np.array([rows, self.arity], "<u8").tobytes())
                for file in columns:
                    file.seek(0)
                    while part := file.read(1 << 20):
                        f.write(part)
        return _Written(name)

    def commit(self, messages):
        store, inner = _open(self.path)
        old = [x.path for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.path.endswith(SUFFIX)]
        for m in messages:
            if m is not None:
                store.move(m.file, m.file.removesuffix(".tmp") + SUFFIX)
        for file in old if self.overwrite else []:
            store.delete_file(file)

    def abort(self, messages):
        store, _ = _open(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.file)


class ColRelDataSource(DataSource):
    """format("colrel"); option unsigned=true reads DECIMAL(20,0) columns, bits=true the 64 bits as a signed long."""

    @classmethod
    def name(cls) -> str:
        return "colrel"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        cols = read_header(self.options["path"], files[0])[1] if files else 0
        unsigned = str(self.options.get("unsigned", "false")).lower() == "true"
        kind = T.DecimalType(20, 0) if unsigned else T.LongType()
        return T.StructType([T.StructField(f"c{i}", kind, False) for i in range(cols)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, str(self.options.get("bits", "false")).lower() == "true")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], len(schema.fields), overwrite)


def read_colrel(spark: SparkSession, path: str, unsigned: bool = False) -> DataFrame:
    spark.dataSource.register(ColRelDataSource)
    files = _files(path)
    if files and read_header(path, files[0])[1] == 0:
        return spark.createDataFrame([], T.StructType([]))
    return spark.read.format("colrel").option("unsigned", str(unsigned).lower()).load(path)


def read_bits(spark: SparkSession, path: str) -> DataFrame:
    """Every value's 64 bits as a BIGINT: those from 2^63 on come out negative."""
    spark.dataSource.register(ColRelDataSource)
    files = _files(path)
    if files and read_header(path, files[0])[1] == 0:
        return spark.createDataFrame([], T.StructType([]))
    return spark.read.format("colrel").option("bits", "true").load(path)


def write_colrel(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of relation files, one per partition; single: one file only (small relations)."""
    df.sparkSession.dataSource.register(ColRelDataSource)
    (df.coalesce(1) if single else df).write.format("colrel").mode("overwrite").save(path)
