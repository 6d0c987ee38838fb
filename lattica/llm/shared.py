"""What the operators share: written tables in the cluster's shared folder, deterministic buckets, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
MASK63 = (1 << 63) - 1


def shared_root(spark: SparkSession) -> str:
    """This application's own folder under spark.checkpoint.dir.

    The setting is read from the session. Only where it is unset (tests, one machine) a temporary folder is set.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="lattica-")
            with contextlib.suppress(Exception):
                spark.conf.set("spark.checkpoint.dir", base)
        _ROOTS[app] = f"{base.rstrip('/')}/lattica-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """A DataFrame written once to the shared folder; reading it cuts lineage and outlives executors."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def tidy(spark: SparkSession) -> None:
    """Let the cluster remove shuffle files that no live DataFrame refers to any more; they go when the driver's JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system the free blocks that this process's allocators (C's and Arrow's) keep. Spark uses its Python
    workers again, and what one stage's texts took would else count beside all that later stages hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[text], F.lit(""))


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns never travel or clash."""
    return docs.select(docs[key].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def slices_of(rows: int, per_slice: int, least: int = 8) -> int:
    """How many buckets keep about per_slice rows in each; grows with the data, so that buckets do not."""
    return max(least, -(-int(rows) // per_slice))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
