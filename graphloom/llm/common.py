"""Shared pieces of the training-data operators: reading, checkpoints, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; without one a local master (tests) gets a folder of its own, others an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="graphloom-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the checkpoint folder, and its path.

    For loops whose column depends on its own last value: a checkpoint keeps the constraints that
    the optimiser has inferred, and these grow with every round; a table has none.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole documents cross to Python at most so many at a time: the default of 10,000 can be gigabytes.

    A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def drop_shuffles(spark: SparkSession) -> None:
    """From now on a query's shuffle files go when it has ended, and not when the driver happens to collect its garbage: in operators of many checkpointed steps they add up to several times the input.

    It holds for DataFrames made after it. One that is run again makes the files again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, and what they keep counts for the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), in place where it can be."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def unused(name: str, *frames: DataFrame) -> str:
    """name, longer by as many _ as it takes not to be a column of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(rows: DataFrame, table: DataFrame, key: str | list[str], by: str | list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined to a table that has one row a key, with the rows of one key spread over `salts` tasks by the hash of their columns `by`.

    The table is repeated once a salt, which is little beside rows of which a third may have one key.
    """
    keys, by = [key] if isinstance(key, str) else key, [by] if isinstance(by, str) else by
    salt = unused("join__salt", rows, table)
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)
