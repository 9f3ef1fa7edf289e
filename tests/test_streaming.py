import pytest
from pyspark.sql import functions as F

from citeloom.streaming import activity


def _events(spark):
    return spark.createDataFrame(
        [(i, f"2025-01-01 0{i % 3}:{i % 60:02d}:00", i % 4, "error" if i % 5 == 0 else "view", float(i)) for i in range(40)], "event_id long, ts string, user_id long, event_type string, value double"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_windows_agree_in_batch_and_stream(spark, tmp_path):
    events = _events(spark)
    events.write.parquet(str(tmp_path / "in"))
    stream = activity.read_events(spark, str(tmp_path / "in"), events.schema)
    query = activity.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling_test").trigger(availableNow=True).start()
    query.awaitTermination(60)
    query.stop()
    assert sorted(map(tuple, spark.table("tumbling_test").collect())) == sorted(map(tuple, activity.tumbling(events).collect()))


def test_ledger_counts_every_unit_once(spark, tmp_path):
    units = spark.range(20).withColumnRenamed("id", "unit_id")
    units.write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("ledger", "out")]
    for attempt in ("one", "two"):  # a second run with a new checkpoint finds all units done
        stream = spark.readStream.schema(units.schema).parquet(str(tmp_path / "in"))
        activity.run_ledger(stream, *paths, str(tmp_path / f"cp-{attempt}"), lambda df: df).awaitTermination(60)
    assert activity.committed(spark, *paths).count() == 20


def test_ledger_survives_a_crash_between_output_and_ledger(spark, tmp_path):
    units = spark.range(12).withColumnRenamed("id", "unit_id")
    units.write.parquet(str(tmp_path / "in"))
    ledger, out, cp = (str(tmp_path / x) for x in ("ledger", "out", "cp"))

    def dies(df):
        df.write.mode("overwrite").parquet(f"{out}/batch=left-behind")
        raise RuntimeError("lost")

    stream = lambda: spark.readStream.schema(units.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        activity.run_ledger(stream(), ledger, out, cp, dies).awaitTermination(60)
    activity.run_ledger(stream(), ledger, out, cp, lambda df: df).awaitTermination(60)
    assert sorted(r["unit_id"] for r in activity.committed(spark, ledger, out).collect()) == list(range(12))


def test_state_is_kept_across_batches(spark, tmp_path):
    events = _events(spark)
    for i in range(2):
        events.filter(F.col("event_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    schema = events.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = activity.running_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals_test").trigger(availableNow=True).start()
    query.awaitTermination(90)
    query.stop()
    last = spark.table("totals_test").groupBy("user_id").agg(F.max("n").alias("n")).collect()
    assert {r["user_id"]: r["n"] for r in last} == {0: 10, 1: 10, 2: 10, 3: 10}


def test_breaker_opens_blocks_and_recovers():
    calls = [(0, True), (1, True), (2, True), (3, True), (50, False), (92, False), (93, True), (94, False), (95, True)]
    assert activity.breaker(calls) == ["refused", "refused", "opens", "blocked", "blocked", "ok", "refused", "ok", "refused"]
