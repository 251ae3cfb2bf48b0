"""Executors need this package for the Python parts of a plan."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to all executors, once per application; a no-op for those that have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "quernel"), "zip", root, "quernel")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
