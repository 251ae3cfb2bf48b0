"""Shards of near equal bytes by a histogram sort, in DataFrame operations alone.

Rows are ordered by a hash of the text, then doc_id: equal texts stand
together. Each round counts exact bytes between candidate boundaries over all
partitions, and only the intervals in which a splitter still lies are cut
finer. Once every splitter is within tolerance, rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import materialize, slim

SHARDS = 24
#: A splitter may be off by this share of a shard's even part before it is refined further.
TOLERANCE = 0.001
#: A group of equal texts of up to this share of a shard's part isn't split.
WHOLE_GROUP = 0.05
STEP_BITS = 12
#: Text of a file that write_shards writes.
FILE_BYTES = 256 << 20
#: Rows of a shard are numbered in so many sub-buckets, each in a task of its own if need be.
SUB_BUCKETS = 64
TOP = 1 << 63


@dataclass(frozen=True)
class Splitter:
    """Rows below (hash, doc) go left; both in unsigned order."""

    hash: int
    doc: int


def _unsigned(column: Column) -> Column:
    """Signed order as the order of bits: shifting right then keeps it."""
    return column.bitwiseXOR(F.lit(-TOP))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= TOP else value


def histogram(keys: DataFrame, column: str, prefixes: list[int], known_bits: int, bits: int) -> list:
    """Bytes, rows and key range by the next `bits` bits under each given prefix of `known_bits`."""
    shift = 64 - known_bits - bits
    if known_bits:
        wanted = [_signed(p << (64 - known_bits)) >> (64 - known_bits) for p in prefixes]
        keys = keys.where(F.shiftright(column, 64 - known_bits).isin(wanted))
    cell = F.shiftrightunsigned(F.col(column), shift) if shift else F.col(column)
    return keys.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(column).alias("low"), F.max(column).alias("high")).collect()


def _locate(keys: DataFrame, column: str, goals: dict[int, float], tolerance: float) -> dict[int, tuple[int, float, bool]]:
    """For each goal (bytes from the start): a boundary value, its exact bytes below, and whether one value spans the goal.

    Spanning values come back as the value itself with the bytes below it.
    """
    found: dict[int, tuple[int, float, bool]] = {}
    active = {0: (0.0, sorted(goals))}  # prefix: bytes below it, goals in it
    known = 0
    while active and known < 64:
        bits = min(STEP_BITS, 64 - known)
        cells = sorted((r.cell % (1 << 64), r) for r in histogram(keys, column, list(active), known, bits))
        further: dict[int, tuple[float, list[int]]] = {}
        for prefix, (below, names) in active.items():
            at = below
            own = [(c, r) for c, r in cells if c >> bits == prefix] if known else cells
            left = sorted(names, key=goals.get)
            for c, r in own:
                here = [g for g in left if goals[g] <= at + r.bytes]
                for g in here:
                    left.remove(g)
                    start = c << (64 - known - bits)
                    if goals[g] - at <= tolerance or at + r.bytes - goals[g] <= tolerance or r.rows == 1:
                        nearer = goals[g] - at <= at + r.bytes - goals[g]
                        found[g] = (start, at, False) if nearer else (start + (1 << (64 - known - bits)), at + r.bytes, False)
                    elif r.low == r.high:
                        found[g] = (r.low % (1 << 64), at, True)
                    else:
                        further.setdefault(c, (at, []))[1].append(g)
                at += r.bytes
            for g in left:  # above all rows
                found[g] = ((1 << 64), at, False)
        active, known = further, known + bits
    return found


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[Splitter]:
    """shards - 1 boundaries over (key_hash, key_doc, size), in order. Repeated rows are never parted."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    part = total / shards
    goals = {j: part * j for j in range(1, shards)}
    if not total:
        return [Splitter(1 << 64, 0)] * (shards - 1)
    placed: dict[int, Splitter] = {}
    spanning: dict[int, list[tuple[int, float]]] = {}
    for j, (value, below, spans) in _locate(keys, "key_hash", goals, tolerance * part).items():
        if spans:
            spanning.setdefault(value, []).append((j, below))
        else:
            placed[j] = Splitter(value, 0)
    if spanning:
        groups = keys.where(F.col("key_hash").isin([_signed(v) for v in spanning])).groupBy("key_hash").agg(F.sum("size").alias("bytes"))
        sizes = {r.key_hash % (1 << 64): r.bytes for r in groups.collect()}
        for value, own in spanning.items():
            if sizes[value] <= WHOLE_GROUP * part:
                for j, below in own:
                    placed[j] = Splitter(value + (goals[j] - below > sizes[value] / 2), 0)
                continue
            inside = keys.where(F.col("key_hash") == _signed(value))
            for j, (doc, _, _) in _locate(inside, "key_doc", {j: goals[j] - below for j, below in own}, tolerance * part).items():
                placed[j] = Splitter(value, doc)
    return [placed[j] for j in sorted(placed)]


def shard_of(cuts: list[Splitter]) -> Column:
    """The number of splitters at or below (key_hash, key_doc)."""
    shard = F.lit(0)
    h, d = _unsigned(F.col("key_hash")), _unsigned(F.col("key_doc"))
    for cut in cuts:
        if cut.hash >= 1 << 64:
            continue
        bound = F.lit(_signed(cut.hash ^ TOP))
        inside = F.lit(False) if cut.doc >= 1 << 64 else d >= F.lit(_signed(cut.doc ^ TOP))
        shard = shard + F.when((h > bound) | ((h == bound) & inside), 1).otherwise(0)
    return shard


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row.

    Size is the text's UTF-8 bytes (null: none) plus 8. Equal texts share a
    shard unless their group is over WHOLE_GROUP of a shard's part and a
    boundary falls in it. A null doc_id is ordered as the least. Repeated rows
    share a shard. Fewer rows than shards leave shards empty; no rows give none.
    """
    # unsigned order of these bits is the order of rows; doc_ids go in signed order
    doc = F.coalesce("doc_id", F.lit(-TOP)).bitwiseXOR(F.lit(-TOP))
    rows = slim(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_hash"),
        doc.alias("key_doc"),
    )
    rows = materialize(rows, "keys")
    placed = rows.withColumn("shard", shard_of(splitters(rows, shards)).cast("int"))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", "key_hash"), F.lit(SUB_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))  # shards * SUB_BUCKETS rows at most
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "sub").orderBy("key_hash", "key_doc")
    numbered = placed.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(starts), ["shard", "sub"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, file_bytes: int = FILE_BYTES) -> None:
    """docs as Parquet under path/shard=<n>/, in shards of near equal bytes and files of about `file_bytes` of text.

    Null ids and texts, repeated rows and empty tables are as in sharded().
    Other columns pass through, but for one named shard, which can't be there.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    doc = F.coalesce("doc_id", F.lit(-TOP)).bitwiseXOR(F.lit(-TOP))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    keys = materialize(slim(docs).select(key.alias("key_hash"), doc.alias("key_doc"), size.alias("size")), "keys")
    writers = max(1, -(-(keys.agg(F.sum("size")).first()[0] or 0) // (shards * file_bytes)))
    row = docs.select(F.struct("*").alias("row"), key.alias("key_hash"), doc.alias("key_doc"))
    row = row.select("row", shard_of(splitters(keys, shards)).alias("shard"), F.pmod(F.xxhash64("key_doc", "key_hash"), F.lit(writers)).alias("writer"))
    row.repartition(shards * writers, "shard", "writer").select("row.*", "shard").write.partitionBy("shard").parquet(path)
