"""Gives executors this package where their path lacks it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package through Spark once a session, unless PYTHONPATH has it (a driver started outside the repository)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in paths or getattr(sc, "_gridregimes_shipped", False):
        return
    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "gridregimes"), "zip", root, "gridregimes")
    sc.addPyFile(zipped)
    sc._gridregimes_shipped = True
