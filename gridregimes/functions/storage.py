"""Tables between steps, in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names; a local one only in local mode where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its machines share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(base)
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"

    def clear() -> None:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone already
            pass

    atexit.register(clear)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what follows does not compute it again, and a lost task costs only itself."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
