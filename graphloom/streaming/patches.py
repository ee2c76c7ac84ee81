"""Patches of a code graph by Structured Streaming: each batch of changed files moves the stored state one version on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import incremental as I
from graphloom.operators.extract import lines_of

#: A changed file: its new text, null if it's gone; of several changes in a batch the one of the highest version counts.
SCHEMA = "path string, language string, version long, text string"


def patch(state_folder: str, extract: I.Extract):
    """The foreachBatch function: state n becomes state n + 1, so that a batch that runs twice gives the same."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        files = batch.groupBy("path").agg(F.max_by(F.struct("language", "text"), "version").alias("f")).select("path", "f.*")
        state = I.State.load(spark, f"{state_folder}/{n}")
        I.apply(state, files, lines_of(files.where("text IS NOT NULL")), extract).save(f"{state_folder}/{n + 1}")

    return run


def patched(spark: SparkSession, changes_folder: str, state_folder: str, checkpoint_folder: str, extract: I.Extract, files_a_batch: int = 1):
    """Apply all change files (Parquet, SCHEMA) that wait in a folder to the state in state_folder/0, and return the query."""
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(changes_folder)
    query = changes.writeStream.foreachBatch(patch(state_folder, extract)).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
