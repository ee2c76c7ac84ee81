"""Session helpers: table loading and tables that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one a local master (tests) gets a folder of its own, others an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def measured(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """df, and how many bytes its rows take in memory, to be asked once it has been written."""
    told, row = Observation(), df._jdf.schema().defaultSize()
    texts = [F.octet_length(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    text = F.sum(reduce(Column.__add__, (F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(0).cast("long")))
    return df.observe(told, F.count("*").alias("rows"), text.alias("text")), lambda: told.get["rows"] * row + (told.get["text"] or 0)


def by_rows(spark: SparkSession, name: str, size: int) -> DataFrame:
    """The table of that name, whose rows take size bytes in memory; its entry goes from the catalogue, its files stay.

    Files hold some rows many times smaller than memory does. By their size Spark would send such a table, or some of its columns, everywhere,
    and by way of the driver; so it is told the number of rows.
    """
    if size > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        spark.conf.set("spark.sql.cbo.planStats.enabled", "true")
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder. In loops a checkpoint keeps the sizes and constraints that the optimiser guessed, which multiply with every round; a table has its own."""
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path, (rows, size) = f"{shared_folder(spark)}/{name}", measured(df)
    rows.write.option("compression", "zstd").parquet(path)
    spark.catalog.createTable(name, path, "parquet", df.schema)
    return by_rows(spark, name, size())


#: Cut the lineage; an RDD checkpoint writes whole rows uncompressed.
checkpoint = stored


INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """stored(), and where task_sizes asks for more partitions dealt into as many buckets of the key: joins by the key, however many, then move only their other side."""
    spark, parts = df.sparkSession, df.sparkSession.conf.get(INITIAL, None)
    if not parts:
        return stored(df)
    name = f"bucketed_{uuid.uuid4().hex}"
    # with fewer buckets than a shuffle has partitions Spark would move both sides
    n = max(int(parts), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, size = measured(df.repartition(n, key))
    rows.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return by_rows(spark, name, size())


#: Bytes of a file or a shuffle that one task reads; in sorts and aggregations they take some twenty times as much memory. A shuffle of a graph moves up to four times its tables.
TASK_BYTES, SHUFFLED = 16 << 20, 4


def task_sizes(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Let tasks stay as small as they are while the tables grow: splits and merged shuffle partitions of TASK_BYTES, and as many partitions as the tables' files call for."""
    conf = spark.conf
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        conf.set(key, str(TASK_BYTES))
    size = sum(int(str(t._jdf.queryExecution().analyzed().stats().sizeInBytes())) for t in tables)
    want = -(-size * SHUFFLED // TASK_BYTES)
    if want > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set(INITIAL, str(want))
    else:
        conf.unset(INITIAL)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it isn't installed and no PYTHONPATH leads to it."""
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent.parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='graphloom-')}/graphloom", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(made)
