"""Running sums and predecessors over long groups, in two levels.

A window over a whole paper would put one long paper into one task.  Here a group is cut to chunks along its
order; a window runs inside each chunk, another over one row a chunk, and a join puts both together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1000


def chunk_of(order: Column, size: int = CHUNK) -> Column:
    """Chunk number of an integer order column; null sorts first."""
    return F.coalesce(F.floor(order / size), F.lit(-1)).cast("long")


def _joined(df: DataFrame, chunks: DataFrame, group: list[str]) -> DataFrame:
    on = [*group, "_chunk"]
    right = chunks.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in chunks.columns if c not in on])
    condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return df.join(right, condition).drop(*[f"_r_{c}" for c in on])


def running_sum(df: DataFrame, group: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` from the start of the group to the row; chunk must grow with the order."""
    rows = df.withColumn("_chunk", chunk).withColumn("_v", value)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_chunk").agg(F.sum("_v").alias("_t"))
    totals = totals.select(*group, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    both = _joined(rows.withColumn("_inside", F.sum("_v").over(inside)), totals, group)
    return both.withColumn(name, F.col("_before") + F.col("_inside")).drop("_chunk", "_v", "_inside", "_before")


def previous(df: DataFrame, group: list[str], chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the value of the row before in the group, null for the first; value must not be null."""
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    last = rows.groupBy(*group, "_chunk").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.select(*group, "_chunk", F.lag("_last").over(Window.partitionBy(*group).orderBy("_chunk")).alias("_last"))
    both = _joined(rows.withColumn("_inside", F.lag(value).over(inside)), last, group)
    return both.withColumn(name, F.coalesce("_inside", "_last")).drop("_chunk", "_inside", "_last")
