"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory however long the texts are.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches that go to Python small; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the session runs in one process (tests) a folder of our own is set for it. On a
    cluster such a folder would lie on each machine's own disk, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _written(df: DataFrame, path: str) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Listeners hold the last query that ran until the next one comes, so an empty one comes first.
    """
    gc.collect()
    spark.range(0).count()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation of what came before, and lets
    Spark drop the shuffle files that led here.
    """
    spark, given = df.sparkSession, [df]
    del df  # _written() must hold the only reference, else the plan and its shuffle files live on
    out = _written(given.pop(), f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}")
    _release(spark)
    return out


class Scratch:
    """Tables between the jobs of one computation, in a folder of their own that goes when its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/tessera-scratch-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """stored() in this folder."""
        path, given = f"{self.folder}/{len(self.tables):04d}-{name}", [df]
        del df  # as in stored()
        self.tables.append((_written(given.pop(), path), path))
        _release(self.spark)
        return self.tables[-1][0]

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

    def replaced(self, old: DataFrame, df: DataFrame, name: str) -> DataFrame:
        """stored() of df, which takes the place of `old`, a table of this folder that nothing else needs."""
        new = self.stored(df, name)
        for table, path in self.tables:
            if table is old:
                self._delete(path)
        return new

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """stored() of what the computation gives; all its other tables go."""
        out = stored(df, name)
        self._delete(self.folder)
        return out


def free_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken, name = {c.lower() for f in frames for c in f.columns}, wanted
    while name.lower() in taken:
        name += "_"
    return name


#: What a worker process keeps between tasks: tables and memories of one operator at a time.
_HELD: dict = {}


def worker_cache(owner: str, key=None, make=None):
    """In a worker: the object that `make` builds for (owner, key), kept for later tasks.

    Workers live on between stages, so what other operators have kept goes first, and its memory with it; an
    owner without a key only does that.
    """
    others = [k for k in _HELD if k[0] != owner]
    if others:
        for other in others:
            del _HELD[other]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc keeps what was freed
            ctypes.CDLL(None).malloc_trim(0)
    if make is None:
        return None
    if (owner, key) not in _HELD:
        _HELD[owner, key] = make()
    return _HELD[owner, key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out_column(doc_id: str = "doc_id"):
    """True for rows kept back from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def hash_bound(share: float):
    """The largest value of the least `share` of all 64-bit hashes."""
    return F.lit(min(2**63 - 1, -(2**63) + int(max(0.0, min(1.0, share)) * 2**64))).cast("bigint")
