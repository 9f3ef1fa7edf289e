"""Reading the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import materialize

REPEATED = 200_000  # keys up to which those that repeat are broadcast


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """``name`` from ``sf_dir``, projected at once so that the scan reads those columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame) -> DataFrame:
    """Rows that were delivered twice, once.

    A redelivered row equals the first in all columns, so equal rows collapse; hash aggregation does it on
    the map side first, and no value has to be carried through a sort.
    """
    return df.distinct()


def once_by_key(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``once``, where equal rows have equal keys and few keys repeat: only rows of repeated keys are shuffled."""
    repeated = materialize(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").select("_key"), "once-repeated")
    if repeated.count() > REPEATED:
        return once(df)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(once(df.join(F.broadcast(repeated), same, "left_semi")))
