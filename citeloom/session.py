"""Session construction and lineage cutting.

Nothing here assumes a driver-local disk on a cluster: the only scratch space is the folder named by
``spark.checkpoint.dir``.  When that setting is absent (unit tests, ad-hoc local runs) a private
temporary folder is used instead and removed at interpreter exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None


def build_session(app: str = "citeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan in this package assumes (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` if set, else a temporary one (local runs)."""
    global _LOCAL_SCRATCH
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH, True)
    return "file://" + _LOCAL_SCRATCH


def _stages(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/citeloom/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Remove what ``materialize`` wrote in this application; results that still read it must be saved before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(conf).delete(path, True)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def stage_settings(spark: SparkSession) -> Iterator[None]:
    """Inside, adaptive execution hashes a join's side instead of sorting both where it has measured all its partitions as small,
    and shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
    """
    settings = {
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB"),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    with _set(spark, settings):
        yield


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, a join's side is broadcast only when it has been shuffled and its rows were measured as few.

    An estimate is of the files that are read and knows nothing of the rows that ``explode`` makes of them, and all
    that is broadcast passes through the driver.
    """
    most = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with _set(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": most}):
        yield


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet in the shared scratch folder and read it back.

    Compared with ``checkpoint()`` this keeps columnar pruning and gives the optimizer true sizes, so
    later joins choose their strategy from measured bytes.  The files survive the loss of executors.
    What is shuffled meanwhile takes disk until the stage is written, so the peak is that of the largest stage.
    """
    spark = df.sparkSession
    path = f"{_stages(spark)}/{label}-{uuid.uuid4().hex}"
    with stage_settings(spark):
        df.write.parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage._written = path
    return stage


def discard(*stages: DataFrame) -> None:
    """Remove stages that ``materialize`` wrote and that nothing reads any more."""
    for stage in stages:
        spark = stage.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage._written)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
