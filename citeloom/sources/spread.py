"""Keeping all cores busy when a table comes in fewer splits than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself, or rebalanced if its scan has fewer partitions than the cluster has cores.

    Only small inputs are moved: a large table always has more splits than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
