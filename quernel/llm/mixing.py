"""Mix sources to target weights by repeating and thinning documents.

Sizes are summed per source, each source gets a target, and target / size is
its repetition rate: every document is taken floor(rate) times, and once more
with the fraction as probability. A hash of doc_id and text draws; rows equal
in both, and so in their draw, share one sequence of draws by their number, so
that c of them are taken c times the rate up to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import WORD_CLASS, forget, materialize, slim

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20240101
#: A table of sources of up to this many rows may be broadcast.
BROADCAST_ROWS = 100_000
#: Equal rows are numbered in runs of so many.
RUN = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight), one row a source.

    Target is weight times one level, and stops at `most` times the size. The
    level is raised until the capped targets add up to `share` of all sizes:
    what sources at their cap leave over goes to the others by weight. A size
    of 0 has target 0. One row of sums per round comes to the driver.
    """
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    cap = F.col("source_size") * most
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, taken, weight = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, max(level, (total - (taken or 0)) / weight)
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def weigh(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight) of (source, size, n): WEIGHTS in turn to sources by code point, null last.

    One row a source; the numbering alone brings these rows together.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(order) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return per.withColumn("weight", F.get(weights, place % len(WEIGHTS)).cast("double"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that doc_id (null: empty), text and seed decide: 13 digits of an MD5, which SQL has everywhere."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), key)
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def taken_times(rate: Column, drawn: Column, number: Column) -> Column:
    """Copies of the number-th (from 1) of equal rows: floor(rate), and one more with the fraction as probability.

    Of equal rows every 1/fraction-th gets one more, from a drawn place on.
    """
    fraction = rate - F.floor(rate)
    return (F.floor(rate) + F.floor(number * fraction + drawn) - F.floor((number - 1) * fraction + drawn)).cast("long")


def _per_source(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target, rate), broadcast if there are few sources."""
    weights = materialize(weigh(sizes), "weights")
    per = materialize(targets(weights), "targets")
    forget(weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = per.select(F.col("source").alias("source_key"), "source_size", "target", rate.alias("rate"))
    return F.broadcast(table) if per.count() <= BROADCAST_ROWS else table


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document with its source's size and target, copies to emit and words taken.

    A null text has size 0; a null source is a source. Rows equal in doc_id,
    source and text (null ids too) are counted together, then numbered, so a
    third of all rows may be equal. An empty table gives no rows; columns
    other than the three are not looked at.
    """
    rows = slim(docs, "source").select("doc_id", "source", words(F.col("text")).alias("size"), text_key(F.col("text")).alias("key"))
    rows = materialize(rows.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    both = rows.join(_per_source(rows), F.col("source").eqNullSafe(F.col("source_key")))
    both = both.withColumn("drawn", draw(F.col("doc_id"), F.col("key"), seed))
    # numbers 1..n, in runs of RUN so that no array is long
    both = both.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    numbers = F.sequence(F.col("run") * RUN + 1, F.least(F.col("n"), (F.col("run") + 1) * RUN))
    both = both.select("*", F.explode(numbers).alias("number"))
    both = both.withColumn("copies", taken_times(F.col("rate"), F.col("drawn"), F.col("number")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def _numbered(keyed: DataFrame) -> DataFrame:
    """keyed with `number`: 1, or its place among rows of equal doc_id, source and key, which no single task counts."""
    names = ("doc_id", "source", "key")
    again = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"again_{c}") for c in names])
    again = materialize(again, "again")
    rows = again.count()
    if not rows:
        return keyed.withColumn("number", F.lit(1).cast("long"))
    again = F.broadcast(again) if rows <= BROADCAST_ROWS else again
    same = [F.col(c).eqNullSafe(F.col(f"again_{c}")) for c in names]
    repeated = materialize(keyed.join(again, same, "left_semi").withColumn("part", F.spark_partition_id()), "repeated")
    here = Window.partitionBy(*names, "part").orderBy("part")
    before = Window.partitionBy(*[f"c_{c}" for c in names]).orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = repeated.groupBy(*[F.col(c).alias(f"c_{c}") for c in (*names, "part")]).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = repeated.withColumn("place", F.row_number().over(here))
    placed = placed.join(counts, [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in (*names, "part")])
    placed = placed.select(*keyed.columns, (F.col("before") + F.col("place")).alias("number"))
    return keyed.join(again, same, "left_anti").withColumn("number", F.lit(1).cast("long")).union(placed)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, same columns, each row as often as the mix takes it.

    Nulls, repeated rows and empty tables are as in mixed(); of rows equal in
    doc_id, source and text it is open which ones get one more copy. Other
    columns pass through.
    """
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), text_key(F.col("text")).alias("key"))
    per = _per_source(keyed.select("source", "size", F.lit(1).alias("n")))
    both = _numbered(keyed).join(per, F.col("source").eqNullSafe(F.col("source_key")))
    copies = taken_times(F.col("rate"), draw(F.col("doc_id"), F.col("key"), seed), F.col("number"))
    return both.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")
