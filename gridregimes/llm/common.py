"""What the text operators share: tables, scratch tables in the cluster's shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship as ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that a side may have, as counted, to be broadcast; a larger side is joined by a shuffle.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. An all-ASCII text takes the faster built-in, which is the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only in local mode where that is unset, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its machines share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


class Scratch:
    """Parquet tables in the shared checkpoint folder.

    A task that is run again reads them from there, so a lost executor costs its own tasks only. ``drop`` removes a
    table that nothing reads any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.parquet(f"{self.path}/{name}", compression=compression)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        try:
            self.drop()
        except Exception:  # the JVM has gone already; the cluster clears its checkpoint folder
            pass


def small(df: DataFrame, n_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` marked for broadcast if its counted bytes are within the limit; else Spark chooses a shuffled join."""
    return F.broadcast(df) if n_bytes <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]) -> object:
    """The one large object (encoder, automaton) that a worker process keeps between tasks; another one takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Frees what another operator's tasks have left in this worker process."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


#: Rows and bytes of a batch that goes to a Python worker, where the session's configuration does not say.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepare(spark: SparkSession) -> None:
    """The package on executors, and batches small enough that long texts leave memory to the executor itself."""
    ship(spark)
    given = spark.sparkContext.getConf()
    for key, value in BATCH.items():
        if not given.contains(key):
            spark.conf.set(key, value)
