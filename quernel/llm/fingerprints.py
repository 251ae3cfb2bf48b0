"""Document fingerprints by one-permutation MinHash, in SQL functions alone.

Each 5-word shingle is hashed once; the top bits of the hash name its bin, and
a bin keeps its least value. An empty bin takes the value of the first
non-empty bin along a probe sequence of its own, the same for all documents
(optimal densification). The low bits of the bins are the fingerprint; chance
matches of so few bits are taken out of the likeness.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import materialize

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
WORDS = 5
VALUE_BITS = 64 - BIN_BITS
VALUE_MASK = (1 << VALUE_BITS) - 1
#: Probes tried one by one before the whole sequence is searched.
QUICK_PROBES = 12
BLANKS = r"[\x20\x09-\x0D]+"
#: What a document goes by: null ids first, then ids, then a hash of the text in two halves.
KEY = ("given", "id", "tie", "tie2")
KEYS_PER_RANGE = 250_000
#: Equal rows are given out in runs of so many.
RUN = 100_000


def _probes(bin_: int) -> list[int]:
    """All other bins in the order of a hash of (bin, other)."""
    return sorted((j for j in range(BINS) if j != bin_), key=lambda j: hashlib.blake2b(f"{bin_}:{j}".encode(), digest_size=8).digest())


_PROBES = [_probes(i) for i in range(BINS)]


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' if v > -(2**63) else '(-9223372036854775807L - 1L)' for v in values)})")


def _ints(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and `name`: the fingerprint of column `text` as 8 longs of 16 four-bit values.

    Text without words has no shingle and the fingerprint of zeros; with fewer
    than five words its whole sequence is the one shingle. Column names that
    start with `name` and an underscore are used on the way.
    """
    kept = df.columns
    w, s, o, v, d = (f"{name}_{x}" for x in "wsovd")
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WORDS)]))
    shingles = F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.expr("array_repeat(0L, 0)"))
    # one value above all others of each bin marks where the bin ends, so that none is missing from the sorted array
    ends = _longs([((b - BINS // 2) << VALUE_BITS) | VALUE_MASK for b in range(BINS)])
    df = df.withColumn(s, F.sort_array(F.concat(shingles, ends)))
    first = lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(F.col(s), i - 1), VALUE_BITS))
    df = df.withColumn(o, F.filter(F.col(s), first))
    least = lambda x: F.nullif(x.bitwiseAND(F.lit(VALUE_MASK)), F.lit(VALUE_MASK))
    df = df.withColumn(v, F.transform(F.col(o), least))
    quick = [_ints([_PROBES[i][k] for i in range(BINS)]) for k in range(QUICK_PROBES)]
    every = F.expr(f"array({', '.join('array(' + ', '.join(map(str, p)) + ')' for p in _PROBES)})")

    def filled(x: Column, i: Column) -> Column:
        rest = F.filter(F.transform(F.get(every, i), lambda j: F.get(F.col(v), j)), lambda y: y.isNotNull())
        return F.coalesce(x, *[F.get(F.col(v), F.get(q, i)) for q in quick], F.get(rest, F.lit(0)), F.lit(0))

    df = df.withColumn(d, F.transform(F.col(v), filled))
    low = lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    packed = F.array(*[F.aggregate(F.slice(F.col(d), 1 + i * PER_LONG, PER_LONG), F.lit(0).cast("long"), low) for i in range(BINS // PER_LONG)])
    return df.withColumn(name, packed).select(*kept, name)


def as_text(fingerprint: Column) -> Column:
    """128 lowercase hex digits, one per bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal values, less what chance gives."""
    misses = F.lit(0)
    ones = F.lit(0x1111111111111111)
    for i in range(BINS // PER_LONG):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones)
        misses = misses + F.bit_count(x)
    chance = 1 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (1 - misses / F.lit(float(BINS)) - chance) / (1 - chance))


def in_order(keys: DataFrame) -> DataFrame:
    """keys, one row each of KEY in ascending order, with prev_<column>: the row before; before the first comes the last.

    Rows are dealt by ranges, written, and look back within their file; one
    row a file tells where the file before ends.
    """
    order = F.struct(*KEY, "n")
    ranges = max(1, -(-keys.count() // KEYS_PER_RANGE))
    placed = materialize(keys.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY), "ordered").withColumn("file", F.input_file_name())
    ends = placed.groupBy("file").agg(F.min(order).alias("head"), F.max(order).alias("tail"))
    before = F.lag("tail").over(Window.orderBy("head"))
    last = F.max("tail").over(Window.partitionBy(F.lit(0)))
    ends = ends.select(F.col("file").alias("its_file"), F.coalesce(before, last).alias("tail_before"))
    back = F.lag(order).over(Window.partitionBy("file").orderBy(*KEY))
    rows = placed.withColumn("back", back).join(F.broadcast(ends), F.col("file") == F.col("its_file"))
    prev = F.coalesce("back", "tail_before")
    return rows.select(*keys.columns, *[prev[c].alias(f"prev_{c}") for c in (*KEY, "n")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness.

    The edit replaces the last quarter (rounded down) of the code points by the
    first as many of the next document's, by ascending doc_id (null first, ties
    by a hash of the text); after the last comes the first. Rows of equal
    doc_id and text are worked on once: each is followed by the next of them,
    the last by the next document. A null text is empty. A table of one row is
    its own next; an empty one gives no rows. Other columns are not looked at.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = base.select(F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("tie"), F.xxhash64("text", F.lit(1)).alias("tie2"), "text")
    keys = named.groupBy(*KEY).agg(F.first(F.char_length("text").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"))
    keys = materialize(in_order(materialize(keys, "keys")), "neighbours")
    held = with_fingerprint(named, "text", "fp").groupBy(*KEY).agg(F.first(F.struct("text", "fp")).alias("own"))
    both = held.join(keys, list(KEY))
    quarter = lambda n: F.floor(n / 4).cast("int")
    start = lambda text, n: F.substring(text, F.lit(1), quarter(n))
    after = both.select(*[F.col(f"prev_{c}").alias(c) for c in KEY], start(F.col("own.text"), F.col("prev_n")).alias("start"), F.col("own.fp").alias("next_fp"))
    met = both.select(*KEY, "own", "n", "rows").join(after, list(KEY))
    # what follows, and for how many of the equal rows
    follows = F.array(
        F.struct(F.lit(1).cast("long").alias("times"), "start", "next_fp"),
        F.struct((F.col("rows") - 1).alias("times"), start(F.col("own.text"), F.col("n")).alias("start"), F.col("own.fp").alias("next_fp")),
    )
    met = met.select("given", "id", "n", "own", F.explode(F.filter(follows, lambda x: x.times > 0)).alias("next"))
    edited = F.concat(F.substring(F.col("own.text"), F.lit(1), F.col("n").cast("int") - quarter(F.col("n"))), F.col("next.start"))
    near = met.select("given", "id", F.col("own.fp").alias("fp"), "next", F.col("n").alias("n_chars"), edited.alias("edited"))
    near = with_fingerprint(near, "edited", "fe")
    done = near.select(
        F.when(F.col("given"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next.next_fp")).alias("near_next"),
        F.col("next.times").alias("times"),
    )
    # so many equal rows, in runs so that no array is long
    runs = done.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))).alias("run"))
    again = F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("times") - F.col("run") * RUN))
    return runs.select(*done.columns[:-1], F.explode(again).alias("copy")).drop("copy")
