"""The folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or the context's checkpoint folder.

    Where neither is set, one process that is driver and executor at once (master local) gets a temporary folder
    that goes with it; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name under the scratch folder that nothing has; what is put there goes when the application ends."""
    folder = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    path, files = hadoop(spark, folder)
    files.deleteOnExit(path)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the scratch folder and read it: cuts lineage, survives executors; see also forget()."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path, files = hadoop(df.sparkSession, folder)
            files.delete(path, True)


def hadoop(spark: SparkSession, name: str):
    """(path, its file system) as Spark itself sees them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small text file in any store that Spark reaches, in place of what was there."""
    path, files = hadoop(spark, name)
    out = files.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, name: str) -> str:
    """A small text file's content; empty if there is none."""
    path, files = hadoop(spark, name)
    if not files.exists(path):
        return ""
    with_lines = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    source = files.open(path)
    try:
        return bytes(with_lines.readFullyToByteArray(source)).decode()
    finally:
        source.close()
