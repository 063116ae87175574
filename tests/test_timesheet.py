"""Time sheets: ordinal pairing, unequal lengths, streaming equals batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.plans import timesheet
from vigil.streaming.timesheet_stream import open_rows, pair_starts_ends, rocksdb_state

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def frames(spark):
    starts = spark.createDataFrame(
        [("k", "p1", T0), ("k", "p2", T0 + dt.timedelta(hours=2)),
         ("k", "p3", T0 + dt.timedelta(days=1)), ("j", "q", T0)],
        "key string, project string, start timestamp_ntz")
    ends = spark.createDataFrame(
        [("k", T0 + dt.timedelta(hours=1)), ("k", T0 + dt.timedelta(hours=3)),
         ("j", T0 + dt.timedelta(minutes=30)), ("j", T0 + dt.timedelta(minutes=40))],
        "key string, `end` timestamp_ntz")
    return starts, ends


def test_three_starts_two_ends(spark):
    s, e = frames(spark)
    rows = {(r.key, r.k): r for r in timesheet.timesheet(s, e).collect()}
    assert rows[("k", 1)]["Time Spent"] == 3600.0 and rows[("k", 2)].Project == "p2"
    assert rows[("k", 3)].End is None and rows[("k", 3)]["Time Spent"] is None
    assert rows[("j", 2)].Start is None and rows[("j", 2)].Project is None
    assert rows[("j", 1)]["Time Spent"] == 1800.0


def test_ordinals_across_days_are_exact(spark):
    df = spark.range(0, 500).select(
        F.lit("u").alias("key"), F.col("id"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), (F.col("id") * 7 % 500).cast("int"))
         ).alias("ts"))
    got = timesheet.ordinals(df, "key", "ts", ["id"]).select("id", "k", "ts").toPandas()
    got = got.sort_values(["ts", "id"])
    assert list(got.k) == list(range(1, 501))


def test_stream_pairs_equal_batch(spark, tmp_dir):
    s, e = frames(spark)
    ev = (s.select("key", F.lit("start").alias("kind"), F.col("start").alias("ts"), "project")
          .unionByName(e.select("key", F.lit("end").alias("kind"), F.col("end").alias("ts"),
                                F.lit(None).cast("string").alias("project")))
          .withColumn("seq", F.monotonically_increasing_id()))
    # replay in arrival (time) order as two files, read as two micro-batches
    src = f"{tmp_dir}/events"
    early = F.col("ts") < T0 + dt.timedelta(minutes=45)
    ev.where(early).orderBy("ts", "seq").coalesce(1).write.parquet(f"{src}/b1")
    ev.where(~early).orderBy("ts", "seq").coalesce(1).write.parquet(f"{src}/b2")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = f"{tmp_dir}/pairs"
    with rocksdb_state(spark):
        q = (pair_starts_ends(stream, ttl="7 days").writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start(out))
        q.awaitTermination(120)
    got = sorted((r.key, r.k, r.Project, r["Time Spent"]) for r in spark.read.parquet(out).collect())
    batch = timesheet.timesheet(s, e).where("Start is not null and `End` is not null")
    exp = sorted((r.key, r.k, r.Project, r["Time Spent"]) for r in batch.collect())
    assert got == exp


def test_stream_closes_never_ended_starts(spark, tmp_dir):
    rows = [("k", "start", T0, "p1", 0), ("j", "start", T0 + dt.timedelta(hours=10), "q", 1),
            ("j", "end", T0 + dt.timedelta(hours=11), None, 2)]
    schema = "key string, kind string, ts timestamp_ntz, project string, seq long"
    src = f"{tmp_dir}/ev"
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(f"{src}/b1")
    spark.createDataFrame(rows[1:], schema).coalesce(1).write.parquet(f"{src}/b2")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = f"{tmp_dir}/pairs"
    with rocksdb_state(spark):
        q = (pair_starts_ends(stream, ttl="8 hours", watermark="1 hour").writeStream
             .format("parquet").option("checkpointLocation", f"{tmp_dir}/ckpt")
             .trigger(availableNow=True).start(out))
        q.awaitTermination(120)
    got = {(r.key, r.k): r for r in spark.read.parquet(out).collect()}
    assert got[("j", 1)]["Time Spent"] == 3600.0
    assert got[("k", 1)].End is None and got[("k", 1)].Project == "p1"


def test_stream_drops_ends_without_a_start(spark, tmp_dir):
    schema = "key string, kind string, ts timestamp_ntz, project string, seq long"
    src = f"{tmp_dir}/ev"
    for i, (key, kind, hours) in enumerate([("k", "end", 0), ("j", "start", 10), ("j", "end", 30)]):
        spark.createDataFrame([(key, kind, T0 + dt.timedelta(hours=hours), "p", i)], schema).coalesce(1) \
            .write.parquet(f"{src}/b{i}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = f"{tmp_dir}/pairs"
    with rocksdb_state(spark):
        q = (pair_starts_ends(stream, ttl="8 hours").writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start(out))
        q.awaitTermination(120)
    got = {(r.key, r.k): r for r in spark.read.parquet(out).collect()}
    assert got[("k", 1)].Start is None and got[("k", 1)].End == T0


def test_stream_keeps_open_rows_and_null_keys(spark, tmp_dir):
    """Restarted from its checkpoint, a query pairs with what it had left open; a state entry an open row."""
    schema = "key string, kind string, ts timestamp_ntz, project string, seq long"
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("ev", "pairs", "ckpt"))
    first = [(None, "start", T0, "p", 0), (None, "start", T0, "q", 1), ("k", "end", T0, None, 2)]
    later = [(None, "end", T0 + dt.timedelta(minutes=5), None, 3)]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        with rocksdb_state(spark):
            (pair_starts_ends(spark.readStream.schema(schema).parquet(src), "7 days").writeStream.format("parquet")
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)).awaitTermination(120)
        return {(r.key, r.k, r.Project, r.Start, r.End) for r in open_rows(spark, ckpt).collect()}
    assert run(first) == {(None, 1, "p", T0, None), (None, 2, "q", T0, None), ("k", 1, None, None, T0)}
    assert run(later) == {(None, 2, "q", T0, None), ("k", 1, None, None, T0)}
    done = spark.read.parquet(out).collect()
    assert [(r.key, r.k, r.Project, r["Time Spent"]) for r in done] == [(None, 1, "p", 300.0)]
