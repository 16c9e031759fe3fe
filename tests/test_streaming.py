from pyspark.sql import functions as F

from loomgraph.operators.incremental import debounce
from loomgraph.streaming import events as S

PATH = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path):
    batch = spark.read.parquet(PATH)
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    return S.read_events(spark, folder, batch.schema, "ts"), batch.withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows(spark, tmp_path, rows):
    live, batch = stream(spark, tmp_path)
    found = S.run_available(S.windowed_counts(live, ["event_type"], "ts", "1 day"), "windows", "complete", str(tmp_path / "c1"))
    want = batch.groupBy("event_type", F.window("ts", "1 day").start.alias("start")).count()
    assert rows(found) == rows(want)


def test_debounce_gives_out_closed_bursts(spark, tmp_path, rows):
    live, batch = stream(spark, tmp_path)
    found = rows(S.run_available(S.debounced(live, ["user_id"], "ts", "6 hours"), "bursts", "append", str(tmp_path / "c2")))
    assert found and set(found) <= set(rows(debounce(batch, ["user_id"], "ts", "6 hours")))


def test_state(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    found = S.run_available(S.last_writes(live, "user_id", "ts", "event_type"), "writes", "update", str(tmp_path / "c3"))
    last = {r.key: r.at for r in found.groupBy("key").agg(F.max("at").alias("at")).collect()}
    assert last == {str(r.user_id): r.at for r in batch.groupBy("user_id").agg(F.max("ts").alias("at")).collect()}
    drained = S.run_available(S.drain_once(live, "user_id", "event_type"), "drained", "append", str(tmp_path / "c4"))
    assert drained.count() == drained.distinct().count() == batch.select("user_id", "event_type").distinct().count()


def test_merge_each_batch(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    seen = []
    S.merge_each_batch(live, lambda df, n: seen.append(df.count()), str(tmp_path / "c5")).awaitTermination()
    assert sum(seen) == batch.count()
