"""Delimited text, DDL text, synthetic relations, and all exports together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.scratch import new_folder, read_text, write_text
from quernel.sources.colrel import read_bits, write_colrel

DELIMITER = "|"
UNSIGNED = T.DecimalType(20, 0)


def synthetic(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Every column holds 0 .. rows-1."""
    return spark.range(rows).select(*[F.col("id").alias(f"c{i}") for i in range(columns)])


def write_tbl(df: DataFrame, path: str) -> None:
    """One line a row, with the delimiter after every value, the last included."""
    values = [F.col(c).cast("string") for c in df.columns]
    df.select(F.concat(F.concat_ws(DELIMITER, *values), F.lit(DELIMITER)).alias("value")).write.mode("overwrite").text(path)


def read_tbl(spark: SparkSession, path: str, columns: int, unsigned: bool = False) -> DataFrame:
    """Lines as write_tbl makes them; a malformed line fails the query that reads it. unsigned: as DECIMAL(20,0)."""
    fields = [T.StructField(f"c{i}", UNSIGNED if unsigned else T.LongType(), True) for i in range(columns)]
    # the delimiter that ends a line opens one more, empty field
    schema = T.StructType([*fields, T.StructField("_end", T.StringType(), True)])
    read = spark.read.csv(path, sep=DELIMITER, schema=schema, mode="FAILFAST")
    return read.select(*[f.name for f in fields])


def ddl(columns: int, rel: int, data_path: str | None = None) -> str:
    """CREATE TABLE for relation `rel`, and the statement that loads its text file."""
    body = ",".join(f"c{i} bigint" for i in range(columns))
    data = data_path or f"r{rel}.tbl"
    return f"CREATE TABLE r{rel} ({body});\ncopy r{rel} from '{data}' delimiter '{DELIMITER}';\n"


def create_table(spark: SparkSession, df: DataFrame, rel: int) -> None:
    """The relation as a managed Parquet table r<rel>."""
    df.write.mode("overwrite").format("parquet").saveAsTable(f"r{rel}")


def export_all(df: DataFrame, folder: str, rel: int) -> list[str]:
    """Binary, text and DDL of one relation under `folder`, in any store; appends its name to the init list."""
    spark, base = df.sparkSession, f"{folder.rstrip('/')}/r{rel}"
    write_colrel(df, base)
    write_tbl(df, f"{base}.tbl")
    write_text(spark, f"{base}.sql", ddl(len(df.columns), rel, f"r{rel}.tbl"))
    names = f"{folder.rstrip('/')}/relations.init"
    write_text(spark, names, f"{read_text(spark, names)}r{rel}\n")
    return [base, f"{base}.tbl", f"{base}.sql"]


def _narrowed(df: DataFrame, wide: list[bool]) -> DataFrame:
    """Each column as BIGINT, or as DECIMAL(20,0) if it has values from 2^63 on."""
    return df.select(*[F.col(c).cast(UNSIGNED if w else T.LongType()).alias(c) for c, w in zip(df.columns, wide, strict=True)])


def import_colrel(spark: SparkSession, path: str) -> DataFrame:
    """A binary relation, turned once into Parquet in the scratch folder: queries then read the columns they need.

    One pass over the file finds which columns have values from 2^63 on.
    """
    bits = read_bits(spark, path)
    if not bits.columns:
        return bits
    least, folder = Observation(), new_folder(spark, "relation")
    bits.observe(least, *[F.min(c).alias(c) for c in bits.columns]).write.parquet(folder)
    table = spark.read.schema(bits.schema).parquet(folder)
    whole = F.lit(str(1 << 64)).cast(UNSIGNED)
    columns = []
    for c in bits.columns:
        value = F.col(c).cast(UNSIGNED)
        columns.append(F.when(F.col(c) < 0, value + whole).otherwise(value).cast(UNSIGNED).alias(c) if (least.get[c] or 0) < 0 else F.col(c))
    return table.select(*columns)


def load_relation(spark: SparkSession, path: str) -> DataFrame:
    """By name: Parquet, delimited text (arity from its first line) or binary; any unsigned 64-bit values."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".tbl"):
        first = spark.read.text(path).first()
        df = read_tbl(spark, path, first[0].count(DELIMITER) if first else 1, unsigned=True)
        most = df.agg(*[F.max(c).alias(c) for c in df.columns]).first()
        return _narrowed(df, [(m or 0) >= 2**63 for m in most])
    return import_colrel(spark, path)
