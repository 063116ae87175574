"""Exact row numbers and running sums without a single-task window.

``number_rows`` range-partitions the rows on their whole order, so a key
with a third of all rows is spread over many tasks. Rows are numbered inside
their partition and written once to the shared checkpoint folder together
with the partition number; only one total per (partition, key) is summed
across partitions. NULL keys form a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize

IN_PARTITION_BITS = 33   # monotonically_increasing_id: partition << 33 | row


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def number_rows(df: DataFrame, order: list, key: list[str] | None = None,
                size: str | None = None, out: str = "offset",
                keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Add ``out``: the number of rows (or the sum of ``size``) that come
    before this row in ``order`` among the rows of the same ``key``.

    Rows equal in ``key`` and ``order`` are numbered by their place in the input, which also lets them be
    spread over partitions. Helper columns take names that no column has; a column called ``out`` is replaced. The
    frame is evaluated here, once (a documented write to the checkpoint folder, by ``keep``).
    """
    key = key or []
    columns = [c for c in df.columns if c != out]
    row, part, place, total, first, p, before_part = (
        fresh([*df.columns, out], c) for c in ("_row", "_part", "_place", "_sum", "_first", "_p", "_before"))
    keys = [fresh([*df.columns, out], f"_k{i}") for i in range(len(key))]
    by = [F.asc_nulls_first(k) for k in key] + list(order) + [F.asc(place)]
    rows = keep(df.withColumn(place, F.monotonically_increasing_id())
                .repartitionByRange(*by).sortWithinPartitions(*by).drop(place)
                .withColumn(row, F.monotonically_increasing_id())
                .withColumn(part, F.shiftright(row, IN_PARTITION_BITS)))
    unit = F.col(size) if size else F.lit(1)
    totals = rows.groupBy(part, *key).agg(F.sum(unit).alias(total), F.min(row).alias(first))
    before = (Window.partitionBy(*key) if key else Window).orderBy(part).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = totals.select(F.col(part).alias(p), *[F.col(k).alias(n) for k, n in zip(key, keys)], first,
                           F.coalesce(F.sum(total).over(before), F.lit(0)).alias(before_part))
    on = F.col(part) == F.col(p)
    for k, n in zip(key, keys):
        on = on & F.col(k).eqNullSafe(F.col(n))
    # without a key there is one total per shuffle partition: a bounded side
    joined = rows.join(totals if key else F.broadcast(totals), on)
    if size:
        local = Window.partitionBy(part, *key).orderBy(row).rowsBetween(
            Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(unit).over(local), F.lit(0))
    else:
        inside = F.col(row) - F.col(first)
    return joined.select(*columns, (F.col(before_part) + inside).cast("bigint").alias(out))
