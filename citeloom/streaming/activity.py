"""Streams: windows over activity, a resumable ledger of work, the breaker that guards a source.

All of them are the same functions in batch and in a stream; event time is the column ts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(events: DataFrame) -> DataFrame:
    """ts as TIMESTAMP, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) in windows that follow each other."""
    timed = with_event_time(events)
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = with_event_time(events)
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): a session ends after a pause."""
    timed = with_event_time(events)
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


# ---------------------------------------------------------------- resumable work


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run_ledger(stream: DataFrame, ledger: str, output: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]):
    """Run ``work`` over a stream of units (unit_id, ...) that a ledger has not as done.

    Each batch has a folder of its own in output and ledger, named by the checkpoint and its number, which a
    second try overwrites; a batch counts when the ledger has it, so ``committed`` reads every unit once, also if
    a run dies between output and ledger.
    """
    name = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mine = f"{name}-{epoch:08d}"
        todo = batch.dropDuplicates(["unit_id"])
        if _exists(spark, ledger):
            done = spark.read.parquet(ledger).filter(F.col("batch") != mine).select("unit_id").distinct()
            todo = todo.join(done, "unit_id", "left_anti")
        todo = todo.persist()
        try:
            work(todo).write.mode("overwrite").parquet(f"{output}/batch={mine}")
            todo.select("unit_id").write.mode("overwrite").parquet(f"{ledger}/batch={mine}")
        finally:
            todo.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, ledger: str, output: str) -> DataFrame:
    """The output of batches that the ledger has; what a crash left behind is not read."""
    batches = spark.read.parquet(ledger).select("batch").distinct()
    return spark.read.parquet(output).join(batches, "batch", "left_semi")


def running_totals(stream: DataFrame):
    """(user_id, n, total) for each user, state kept across batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].fillna(0.0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- the breaker of a source


def breaker(answers: list[tuple[float, bool]], most: int = 3, pause: float = 90.0) -> list[str]:
    """What happens to each call (seconds, was it refused): 'ok', 'refused', 'opens' or 'blocked'.

    ``most`` refusals in a row open the breaker; while it is open calls are blocked; a success sets it back.
    """
    out, row, until = [], 0, float("-inf")
    for at, refused in answers:
        if at < until:
            out.append("blocked")
        elif not refused:
            row = 0
            out.append("ok")
        else:
            row += 1
            if row >= most:
                row, until = 0, at + pause
            out.append("opens" if until == at + pause else "refused")
    return out


def breaker_states(events: DataFrame, hosts: int = 16) -> DataFrame:
    """(host, outcome, n): calls of each host in order of time; a host's calls are few, it is limited to some a second."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        out = breaker(list(zip(pdf["ts"].astype("int64") / 1e9, pdf["event_type"] == "error")))
        counts = pd.Series(out).value_counts()
        return pd.DataFrame({"host": pdf["host"].iloc[0], "outcome": counts.index, "n": counts.to_numpy()})

    hosted = events.withColumn("host", F.pmod(F.xxhash64("user_id"), F.lit(hosts)).cast("int"))
    return hosted.select("host", "ts", "event_id", "event_type").groupBy("host").applyInPandas(run, "host int, outcome string, n long")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
