"""Numbers in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.session import checkpoint

#: monotonically_increasing_id has the partition above this bit and the row below it.
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """rows with their place in the order, counted from `first`.

    Rows are dealt by ranges of the order and sorted within partitions, each partition counts its own, and a partition begins where those before it
    end: what meets in one place is a count a partition. Equal rows are numbered in some order. The order may be of several columns or expressions; nulls
    come first; no rows give no rows.
    """
    keys = [F.expr(o) if isinstance(o, str) else o for o in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    kept = checkpoint(dealt.withColumn("scan__at", place))
    part = F.shiftright("scan__at", ROW_BITS)
    counts = kept.groupBy(part.alias("scan__part")).count()
    starts, sofar = [], first
    for p, n in sorted(tuple(r) for r in counts.collect()):  # one row a partition
        starts.append((p, sofar))
        sofar += n
    table = rows.sparkSession.createDataFrame(starts, "scan__part long, scan__start long")
    met = kept.withColumn("scan__part", part).join(F.broadcast(table), "scan__part")
    return met.withColumn(name, F.col("scan__start") + F.col("scan__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).select(*rows.columns, name)
