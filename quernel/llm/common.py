"""What the operators share: inputs, bounded batches to Python, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quernel.functions.scratch import forget, materialize

__all__ = ["WordHashes", "batch_of", "bounded_batches", "documents", "forget", "materialize", "mix", "per_row", "rewritten", "slices", "slim"]

#: Words are maximal runs of bytes other than these; bytes.split() cuts at just them.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
CACHED_WORDS = 150_000
#: Longer words are hashed anew each time, so that the words remembered have a bounded size.
CACHED_WORD_BYTES = 64
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: What Python looks at in one go, as objects: about so many bytes of text, and so many rows.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slim(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; any others can't clash with what an operator adds."""
    return docs.select("doc_id", "text", *more)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python of at most BATCH_BYTES or one row, for the session: with long rows 10,000 would be gigabytes."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings have about SLICE_BYTES; a longer row is alone."""
    sizes = np.full(batch.num_rows, SLICE_BYTES // SLICE_ROWS, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def per_row(df: DataFrame, start: Callable[[], Callable[..., tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """A row out for each row in, in Python. start() is called once a task and returns the function of a row's values."""
    bounded_batches(df.sparkSession)

    def run(batches):
        made = start()
        for batch in batches:
            for part in slices(batch):
                yield batch_of(schema, [made(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)])
        del made
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, ddl)


def rewritten(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """df, same columns, with each run of rows (see slices) as `change` makes it."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield change(part)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of UTF-8 bytes, A-Z lowered, in lists of about PIECE_BYTES."""
    data = data.lower()
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to CACHED_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        return self.of_bytes((text or "").encode("utf-8", "surrogatepass"))

    def of_bytes(self, data: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) for words in word_pieces(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
