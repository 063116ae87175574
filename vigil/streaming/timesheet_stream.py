"""Pair task starts with ends as they arrive (Structured Streaming, ``transformWithState``).

Input rows (key, kind, ts, project, seq): kind 'start' or 'end'. Per key, the
k-th start pairs with the k-th end, as the batch ``timesheet`` does; a
pair is emitted in the micro-batch that completes it. Events of a key are
numbered in arrival order (a stopwatch emits them in time order); within
a micro-batch they are ordered by (ts, seq).

State lies in RocksDB: two counters a key, and one map entry for each open row, read and written by its number alone,
so an event costs the same however many rows of its key are open. A timer for the row's end of patience emits it
with the other side NULL once the watermark passes ``ts + ttl``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.materialize import scratch_path

PAIRS = ("key string, k long, Project string, Start timestamp_ntz, "
         "`End` timestamp_ntz, `Time Spent` double")
_OUT = "key string, k long, project string, start_us long, end_us long"
_OPEN = "ts_us long, due_ms long, project string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The session's queries started inside keep their state in RocksDB, as ``transformWithState`` needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Pairer(StatefulProcessor):
    """One key's open starts and ends by number, and the numbers due at a time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "starts long, ends long")
        self.open = {kind: handle.getMapState(f"open_{kind}", "k long", _OPEN) for kind in ("start", "end")}
        self.due = handle.getMapState("due", "due_ms long", "rows array<string>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = dict(zip(("start", "end"), self.seen.get())) if self.seen.exists() else {"start": 0, "end": 0}
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "seq"], kind="stable")
        found = []
        for kind, us, ms, project in zip(batch["kind"], batch["ts_us"], batch["ts_ms"], batch["project"]):
            side, other = ("start", "end") if kind == "start" else ("end", "start")
            seen[side] += 1
            k = seen[side]
            project = None if pd.isna(project) else project
            if self.open[other].containsKey((k,)):
                us_2, due, project_2 = self.open[other].getValue((k,))
                self.open[other].removeKey((k,))
                self._forget(due, f"{other}:{k}")
                found.append((k, project, us, us_2) if side == "start" else (k, project_2, us_2, us))
            else:
                # a timer may not lie before the watermark
                due = max(int(ms) + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1)
                self.open[side].updateValue((k,), (int(us), due, project))
                self._remember(due, f"{side}:{k}")
        self.seen.update((seen["start"], seen["end"]))
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        found = []
        for name in self._names(due):
            side, k = name.split(":")
            us, _, project = self.open[side].getValue((int(k),))
            self.open[side].removeKey((int(k),))
            found.append((int(k), project, us, None) if side == "start" else (int(k), None, None, us))
        if self.due.containsKey((due,)):
            self.due.removeKey((due,))
        yield self._rows(key, found)

    def _names(self, due: int) -> list[str]:
        return list(self.due.getValue((due,))[0]) if self.due.containsKey((due,)) else []

    def _remember(self, due: int, name: str) -> None:
        names = self._names(due)
        if not names:
            self.handle.registerTimer(due)
        self.due.updateValue((due,), ([*names, name],))

    def _forget(self, due: int, name: str) -> None:
        names = [n for n in self._names(due) if n != name]
        if names:
            self.due.updateValue((due,), (names,))
        else:
            self.due.removeKey((due,))
            self.handle.deleteTimer(due)

    @staticmethod
    def _rows(key, found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=["k", "project", "start_us", "end_us"], dtype=object)
        for c in ("k", "start_us", "end_us"):
            frame[c] = frame[c].astype("Int64")
        frame.insert(0, "key", key[0])
        return frame.astype({"key": object})


def milliseconds(duration: str) -> int:
    """Of e.g. '8 hours'."""
    n, unit = duration.split()
    return int(float(n) * UNITS[unit.rstrip("s")] * 1000)


def _sheet(rows: DataFrame) -> DataFrame:
    """Output columns from times in microseconds of wall-clock time."""
    wall = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    return rows.select("key", "k", F.col("project").alias("Project"), wall("start_us").alias("Start"),
                       wall("end_us").alias("End"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("Time Spent"))


def pair_starts_ends(events: DataFrame, ttl: str, watermark: str = "1 hour") -> DataFrame:
    """Streaming frame of (key, kind, ts, project, seq) -> pairs. Start the query within ``rocksdb_state``.

    ``seq`` orders events with equal ``ts``. A start or an end without a
    partner is emitted with the other side NULL, and dropped from the state,
    once the watermark passes it by ``ttl`` (e.g. '8 hours'). A NULL key is a key. Rows later than the
    watermark are numbered like others. Times are wall-clock times without a zone.
    """
    since = F.lit("1970-01-01").cast("timestamp_ntz")
    src = (events.select("key", "kind", "project", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"))
           # watermarks need TIMESTAMP (not TIMESTAMP_NTZ) event time
           .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
           .withColumns({"ts_us": F.timestamp_diff("MICROSECOND", since, F.col("ts")), "ts_ms": F.unix_millis("event_time")}))
    return _sheet(src.groupBy("key").transformWithStateInPandas(
        Pairer(milliseconds(ttl)), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"))


def open_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows without a partner in the state that a query has left under its ``checkpoint`` folder."""
    def of(kind: str) -> DataFrame:
        held = spark.read.format("statestore").option("stateVarName", f"open_{kind}").load(checkpoint)
        us = F.col("user_map_value.ts_us")
        none = F.lit(None).cast("long")
        return held.select(
            F.col("key.key").alias("key"), F.col("user_map_key.k").alias("k"),
            (F.col("user_map_value.project") if kind == "start" else F.lit(None).cast("string")).alias("project"),
            (us if kind == "start" else none).alias("start_us"), (us if kind == "end" else none).alias("end_us"))
    return _sheet(of("start").unionByName(of("end")))


def replay(events: DataFrame, ttl: str, watermark: str = "1 hour") -> tuple[DataFrame, str]:
    """Run all that a streaming frame of events holds now; (the rows emitted, the query's checkpoint folder)."""
    spark = events.sparkSession
    out, checkpoint = scratch_path(spark, "pairs"), scratch_path(spark, "pairs-state")
    with rocksdb_state(spark):
        query = (pair_starts_ends(events, ttl, watermark).writeStream.format("parquet")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
        query.awaitTermination()
    return spark.read.schema(PAIRS).parquet(out), checkpoint
