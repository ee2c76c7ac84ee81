"""Diagnostics as a stream: the latest state of each file, kept by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.session import checkpoint


def latest_by(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """A streaming aggregate that replaces a key's row by the one that comes last in order."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return stream.groupBy(key).agg(last, F.count("*").alias("updates")).select(key, "last.*", "updates")


def replay(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """All rows of a table through the stream, at once; the result is a table in the checkpoint folder."""
    checkpoint(spark.range(0).toDF("id"))  # sets the folder where it is unset
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    source = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        rows = source.parquet(f"{sf_dir}/{table}.parquet")
    else:  # a stream takes folders only
        rows = source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    state = latest_by(rows, "user_id", ["ts", "event_id"], ["event_id", "event_type"])
    query = (
        state.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{base}/state")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/table"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(state.schema).parquet(f"{base}/table")
