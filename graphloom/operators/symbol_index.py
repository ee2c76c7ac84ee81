"""A stored index of symbols: tables laid out by what is looked up, so that a look-up reads a few files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines in a band; a symbol is stored in every band of bands that its range touches.
BAND = 200


def bucket(c: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


@dataclass(frozen=True)
class SymbolIndex:
    """Symbols (views.symbols_of with `kind`) in three layouts below a folder: by id, by name, and by language, kind and file.

    Each look-up names the partition that can hold its answer, so Spark lists and reads that partition alone; rows are sorted within files, so statistics skip row groups
    too. `buckets` should grow with the table: a bucket of some hundred MB.
    """

    folder: str
    buckets: int = 16

    def write(self, symbols: DataFrame) -> SymbolIndex:
        own = symbols.withColumn("id_bucket", bucket("id", self.buckets)).withColumn("name_bucket", bucket("name", self.buckets)).withColumn("file_bucket", bucket("file", self.buckets))
        for name, keys, order in (("by_id", ["id_bucket"], ["id"]), ("by_name", ["name_bucket"], ["name", "id"]), ("by_file", ["language", "kind", "file_bucket"], ["file", "line"])):
            own.repartition(*keys).sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).parquet(f"{self.folder}/{name}")
        return self

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def by_id(self, spark: SparkSession, value: str) -> DataFrame:
        return self.table(spark, "by_id").where((F.col("id_bucket") == bucket(F.lit(value), self.buckets)) & (F.col("id") == value))

    def by_name(self, spark: SparkSession, value: str) -> DataFrame:
        return self.table(spark, "by_name").where((F.col("name_bucket") == bucket(F.lit(value), self.buckets)) & (F.col("name") == value))

    def by_language(self, spark: SparkSession, value: str) -> DataFrame:
        return self.table(spark, "by_file").where(F.col("language") == value)

    def by_kind(self, spark: SparkSession, value: str) -> DataFrame:
        return self.table(spark, "by_file").where(F.col("kind") == value)

    def by_file(self, spark: SparkSession, value: str) -> DataFrame:
        return self.table(spark, "by_file").where((F.col("file_bucket") == bucket(F.lit(value), self.buckets)) & (F.col("file") == value))

    def by_range(self, spark: SparkSession, file: str, line: int, char: int) -> DataFrame:
        """The symbols of a file whose range holds a position, ends included."""
        r = F.col("range")
        after = (r["start_line"] < line) | ((r["start_line"] == line) & (r["start_char"] <= char))
        return self.by_file(spark, file).where(after & ((r["end_line"] > line) | ((r["end_line"] == line) & (r["end_char"] >= char))))
