"""Window building blocks.

All helpers take one ``partitionBy(...).orderBy(...)`` spec so several of
them share a single exchange and sort: rolling frames, the whole
partition, running maxima and "rows from the end" are all derived from
the same ordered partition.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import col


def ordered(partition: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def whole(partition: list[str]) -> WindowSpec:
    """The whole partition as frame (for partition-level mean, sd, count)."""
    return Window.partitionBy(*partition).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)


def trailing(spec: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` rows before it (rows, not days)."""
    return spec.rowsBetween(-(n - 1), 0)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def rolling_mean(c, spec: WindowSpec, n: int) -> Column:
    """Mean of the last ``n`` rows; NULL until ``n`` non-null values exist."""
    w = trailing(spec, n)
    c = col(c)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def rolling_sum(c, spec: WindowSpec, n: int) -> Column:
    """Sum of the last ``n`` rows; NULL until ``n`` non-null values exist."""
    w = trailing(spec, n)
    c = col(c)
    return F.when(F.count(c).over(w) == n, F.sum(c).over(w))


def run_length(flag, rn, spec: WindowSpec) -> Column:
    """Length of the run of 1-flags ending at this row (0 on a 0-flag row).

    Same value as numbering islands of equal flags and summing the flag
    inside each island, but needs no partition by island: it is the row
    number minus the row number of the last 0-flag row so far.
    """
    last_zero = F.max(F.when(col(flag) == 0, col(rn))).over(running(spec))
    return (col(rn) - F.coalesce(last_zero, F.lit(0))).cast("int")


def island_id(flag, spec: WindowSpec) -> Column:
    """Running count of flag changes (islands of equal consecutive flags)."""
    prev = F.lag(col(flag)).over(spec)
    change = F.when(prev.isNotNull() & (prev == col(flag)), 0).otherwise(1)
    return F.sum(change).over(running(spec))
