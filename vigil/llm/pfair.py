"""Mixing sources to target weights by proportionate-fair scheduling.

A source's rows, in a seeded order, are cut into blocks. With target weight w, its block i (from 1) is
released at floor((i - 1) / w) and due at ceil(i / w), in block slots. Earliest deadline first among
released blocks meets every deadline on one resource, so at any slot a source is less than one
block from its target. Weights are exact fractions of whole numbers, one for every source, and all times are
integers.

The schedule is one stream of blocks: a task holds a number or two for each source and hands out (source, block, slot) row
by row; rows and texts are shuffled to it by (source, block), so that no source is one group. Its length is the number of
blocks; ``block_rows`` should grow with the table (a thousand at 10^10 rows).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize, scratch_path
from ..operators.rownumber import number_rows
from .common import fresh

BLOCK_ROWS = 16
TEMPERATURE = 0.7    # a source's weight follows its rows to this power
SEED = 8
UNIT = 1 << 20       # a weight of one, in the whole numbers that weights are kept in
SLOTS = "source string, block long, slot long, release long, deadline long"


def target_weights(docs: DataFrame, temperature: float = TEMPERATURE, stratum: str = "source") -> DataFrame:
    """(source, weight): from the whole table's row counts, a row for each source, null being one."""
    counts = docs.groupBy(docs[stratum].cast("string").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("source", F.greatest(F.lit(1).cast("long"), F.floor(
        F.pow(F.col("rows").cast("double"), temperature) * UNIT)).cast("long").alias("weight"))


def earliest_deadlines(sources: Iterable[tuple[str | None, int, int]]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of (source, weight, blocks), in the order of slots; blocks count from 0.

    Ties of deadlines go by name, null first. Once a source has run out its slots are passed over.
    """
    rows = sorted(((s, w, n) for s, w, n in sources if n > 0 and w > 0), key=lambda r: (r[0] is not None, r[0] or ""))
    total = sum(w for _, w, _ in rows)

    def window(s: int, block: int) -> tuple[int, int]:
        weight = rows[s][1]
        return block * total // weight, -(-(block + 1) * total // weight)

    waiting = [(*window(s, 0), s, 0) for s in range(len(rows))]   # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []                   # by deadline
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, block, release))
        deadline, s, block, release = heapq.heappop(ready)
        yield rows[s][0], block, slot, release, deadline
        if block + 1 < rows[s][2]:
            heapq.heappush(waiting, (*window(s, block + 1), s, block + 1))
        slot += 1


def schedule(sources: DataFrame) -> DataFrame:
    """The slots of all blocks of (source, weight, blocks), a row a source; one task streams them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        kinds = [pa.string()] + [pa.int64()] * 4
        names = [c.split()[0] for c in SLOTS.split(", ")]

        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some) if some else [()] * 5, kinds)], names)
        some: list[tuple] = []
        for x in earliest_deadlines(rows):
            some.append(x)
            if len(some) >= 1 << 15:
                yield batch(some)
                some = []
        yield batch(some)

    return sources.select("source", "weight", "blocks").repartition(1).mapInArrow(run, SLOTS)


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED,
        stratum: str = "source", id_col: str = "doc_id", place: str | None = None) -> DataFrame:
    """(doc_id, source, block, slot, release, deadline, in_block, position, place) of every row of ``docs``.

    ``weights`` (source, weight) holds whole numbers whose shares are the targets (by default ``target_weights``).
    ``position`` is the row's place in the mixed order, gapless from 0. Every row is kept: when a source has run
    out its slots are passed over, and the others go on in their proportions. Sources without a weight, or one that is not
    positive, come after all others, a block of each in turn. A null source is a source. Null ids, repeated rows and ties are
    ordered by a seeded hash and their place in the input (``place``: the column of that name, which must differ from row to
    row, else a number that names a row of this frame); an empty table gives no rows; texts are not read, nor are other
    columns. Only ids and sources are shuffled.
    """
    weights = target_weights(docs, stratum=stratum) if weights is None else weights
    at = docs[place] if place else F.monotonically_increasing_id()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[stratum].cast("string").alias("source"),
                       at.alias("place")).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    ranked = number_rows(rows, [F.col("draw"), F.asc_nulls_first("doc_id"), F.col("place")],
                         key=["source"], out="rank").drop("draw")
    # a row for each source
    sizes = ranked.groupBy("source").agg(F.max(F.expr(f"rank div {block_rows}") + 1).alias("blocks"))
    named = weights.select(F.col("source").alias("of"), F.col("weight").cast("long").alias("weight"))
    slots = materialize(schedule(sizes.join(named.where("weight > 0"), F.col("source").eqNullSafe(F.col("of")))))
    slots = slots.select(F.col("source").alias("of"), F.col("block").alias("step"), "slot", "release", "deadline")
    blocks = ranked.withColumns({"block": F.expr(f"rank div {block_rows}"), "in_block": F.expr(f"rank % {block_rows}")})
    due = blocks.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("step")), "left")
    return number_rows(due.select("doc_id", "source", "block", "slot", "release", "deadline", "in_block", "place"),
                       [F.asc_nulls_last("slot"), F.col("block"), F.asc_nulls_first("source"), F.col("in_block"),
                        F.col("place")], out="position")


def mixed_documents(docs: DataFrame, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS,
                    seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs``, sorted in the mixed order: written files, and their rows, follow it.

    Every row takes its own position, rows of one doc_id, or of none, like others: the rows are written once with the
    number that stands for them. The texts are shuffled to their positions and then sorted in ranges.
    """
    number, key, at = (fresh(docs.columns, f"mix_{x}") for x in ("number", "place", "position"))
    path = scratch_path(docs.sparkSession, "mixing-rows")
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    placed = mix(rows, target_weights(rows, temperature), block_rows, seed, place=number)
    placed = placed.select(F.col("place").alias(key), F.col("position").alias(at))
    return rows.join(placed, rows[number] == placed[key]).orderBy(at).select(*docs.columns)
