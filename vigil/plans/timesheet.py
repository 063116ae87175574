"""Time sheets: pair the k-th start of a key with its k-th end.

The source zipped two lists by position and kept the longer list's tail
(unequal lengths give NULL ends or starts). Here ordinals are numbered over
range partitions, so a key with a third of all rows is still numbered by
many tasks, and the pairing is a full outer null-safe join on (key, k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rownumber import number_rows


def ordinals(df: DataFrame, key: str, ts: str, order: list[str], out: str = "k") -> DataFrame:
    """1-based ordinal of each row within ``key`` by (ts, *order), NULL times first."""
    n = number_rows(df, [F.asc_nulls_first(c) for c in (ts, *order)], key=[key], out="_off")
    return n.withColumn(out, F.col("_off") + 1).drop("_off")


def timesheet(starts: DataFrame, ends: DataFrame, key: str = "key",
              order: list[str] | None = None) -> DataFrame:
    """(key, k, Project, Start, End, Time Spent) with Time Spent in seconds.

    ``starts``: (key, project, start[, order...]); ``ends``: (key, end[, order...]).
    """
    order = order or []
    s = ordinals(starts, key, "start", order).select(
        F.col(key), "k", F.col("project").alias("Project"), F.col("start").alias("Start"))
    e = ordinals(ends, key, "end", order).select(
        F.col(key).alias("_key"), F.col("k").alias("_k"), F.col("end").alias("End"))
    # k is never NULL, so it tells the sides that have no partner
    j = (s.join(e, s[key].eqNullSafe(e["_key"]) & (s["k"] == e["_k"]), "full_outer")
         .select(F.when(F.col("k").isNull(), F.col("_key")).otherwise(F.col(key)).alias(key),
                 F.coalesce("k", "_k").alias("k"), "Project", "Start", "End"))
    spent = F.timestamp_diff("MICROSECOND", F.col("Start"), F.col("End")) / 1e6
    return j.select(key, "k", "Project", "Start", "End", spent.alias("Time Spent"))


def day_label(ts) -> F.Column:
    """ISO day of a time stamp (the file label of a day's sheet)."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd")
