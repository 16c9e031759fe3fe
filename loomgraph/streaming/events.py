"""Structured Streaming over event logs: windows, debounce, upserts, drain-once queues, last write wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType | str, time: str, files: int = 100) -> DataFrame:
    """A stream of the parquet files in a folder; the time becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, keys: list[str], time: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(keys, start, n) over tumbling or sliding windows; rows later than ``late`` go."""
    w = F.window(F.col(time), length, slide) if slide else F.window(F.col(time), length)
    return events.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def debounced(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 day") -> DataFrame:
    """(keys, start, end, n): bursts, given out once they're over."""
    out = events.withWatermark(time, late).groupBy(*keys, F.session_window(F.col(time), gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def call_pairs(calls: DataFrame, caller: str, callee: str) -> DataFrame:
    """Running counts of (caller, callee); for update mode."""
    own = calls.filter(F.col(caller).isNotNull() & F.col(callee).isNotNull() & (F.col(caller) != F.col(callee)))
    return own.groupBy(F.col(caller).alias("from_node"), F.col(callee).alias("to_node")).agg(F.count("*").alias("n"))


def with_static(events: DataFrame, known: DataFrame, key: str, flag: str) -> DataFrame:
    """A stream's rows, each with whether a static table knows its key."""
    return events.join(known.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


class LastWrite(StatefulProcessor):
    """State of a key: the latest (time, value); given out whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at timestamp, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.state.get() if self.state.exists() else None
        best = old
        for pdf in rows:
            for r in pdf.sort_values(["at", "value"]).itertuples():
                if best is None or (r.at, r.value) >= tuple(best):
                    best = (r.at, r.value)
        if best is not None and best != old:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "at": [best[0]], "value": [best[1]]})

    def close(self) -> None:
        pass


def last_writes(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, at, value): a key-value view kept by state; for update mode and the RocksDB state store."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LastWrite(), outputStructType="key string, at timestamp, value string", outputMode="Update", timeMode="None"
    )


class DrainOnce(StatefulProcessor):
    """State of a key: ids already given out; each id leaves the queue once, for as long as it is remembered."""

    def __init__(self, remember_ms: int | None):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "n int", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = []
        for pdf in rows:
            for i in pdf["id"].tolist():
                if not self.seen.containsKey((i,)):
                    self.seen.updateValue((i,), (1,))
                    fresh.append(i)
        yield pd.DataFrame({"queue": [key[0]] * len(fresh), "id": fresh})

    def close(self) -> None:
        pass


def drain_once(events: DataFrame, queue: str, item: str, remember_ms: int | None = None) -> DataFrame:
    """(queue, id): every item the first time it comes up. remember_ms: how long an id is kept after it was given out, so that the
    state doesn't grow without end; a stream with it runs on by the clock and doesn't end by itself. None: for ever."""
    rows = events.select(F.col(queue).cast("string").alias("queue"), F.col(item).cast("string").alias("id"))
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=DrainOnce(remember_ms), outputStructType="queue string, id string", outputMode="Append", timeMode="None" if remember_ms is None else "ProcessingTime")


def merge_each_batch(stream: DataFrame, merge, checkpoint: str):
    """Runs ``merge(batch, number)`` on every micro-batch, as far as there is input: for upserts into tables."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream gives for the input there is, as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
