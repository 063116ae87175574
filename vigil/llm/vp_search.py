"""Approximate nearest neighbours with vantage-point trees per shard.

Vectors go to the cell of their nearest pivot (a bounded sample of the vectors),
and a cell is cut into shards of a bounded size. A shard builds a
vantage-point tree. A query first searches its own cell, then every cell whose
ball the triangle inequality does not rule out at the distance of its k-th
neighbour so far. Inside trees and between cells a branch is pruned when
its least possible distance times ``relax`` exceeds that distance: one is exact search,
more prunes sooner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize

SHARD_ROWS = 4096      # vectors of a shard, about
MAX_PIVOTS = 512       # pivots that reach the driver, at most; larger cells have more shards
QUERY_ROWS = 4096      # queries that a shard answers at a time
LEAF = 64
SMALLER_SIDE = 8       # a split leaves at least an eighth of the rows on either side, or the rows stay a leaf
TILE_QUERIES, TILE_ROWS = 256, 1024   # distances held at a time
SLACK = 1e-9           # of a distance: rounding never prunes an equal neighbour


class Tree:
    """A vantage-point tree over rows of a matrix. A node is [vantage, greatest distance of the near side, least and greatest of
    the far side, near side, far side], a leaf its rows. It is built with a stack and splits are balanced, so its depth is a
    logarithm of the rows; rows that no distance tells apart, such as copies or equidistant ones, are one leaf."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids = vectors, ids
        self.squares = (vectors ** 2).sum(axis=1)
        self.single_ids = len(np.unique(ids)) == len(ids)
        holder: list = [None]
        stack = [(np.arange(len(ids)), holder, 0)]
        while stack:
            rows, parent, at = stack.pop()
            parent[at] = rows
            if len(rows) <= leaf:
                continue
            vantage = rows[len(rows) // 2]
            d = euclidean(vectors[rows], vectors[vantage])
            bound = np.partition(d, len(d) // 2)[len(d) // 2]
            for inside in (d < bound, d <= bound):   # the rows at the bound go to the side that balances
                n = np.count_nonzero(inside)
                if min(n, len(rows) - n) * SMALLER_SIDE >= len(rows):
                    node = [vantage, d[inside].max(), d[~inside].min(), d[~inside].max(), None, None]
                    parent[at] = node
                    stack += [(rows[inside], node, 4), (rows[~inside], node, 5)]
                    break
        self.root = holder[0]


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows in double precision, always summed in the same order."""
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


class Found:
    """The k nearest of each query, ordered by distance, then id."""

    def __init__(self, n: int, k: int, reach: np.ndarray | None = None):
        self.k = k
        self.compared = 0   # pairs of a query and a row that a leaf or a vantage point compared
        self.score, self.id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.reach = np.full(n, np.inf) if reach is None else reach   # what is already known to be enough

    def bound(self, q: np.ndarray) -> np.ndarray:
        return np.minimum(self.score[q, -1], self.reach[q])

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` and ``ids``: a row per query, a column per candidate (infinite: none)."""
        s = np.concatenate([self.score[q], score], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(np.isinf(s), np.iinfo(np.int64).max, i)
        # one id may be offered more than once if its rows repeat, with one vector or several: its smallest score stays
        order = np.lexsort((s, i), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = (i[:, 1:] == i[:, :-1]) & np.isfinite(s[:, 1:])
        s, i = np.where(again, np.inf, s), np.where(again, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, s), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.score[q], self.id[q] = s[:, :self.k], i[:, :self.k]


def search_tree(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, k: int, relax: float,
                reach: np.ndarray | None = None) -> Found:
    """The tree's k nearest of each query but itself. All queries go down together; at a node those go on
    for which it can still hold a neighbour."""
    found = Found(len(queries), k, reach)
    stack = [(tree.root, np.arange(len(queries)), np.zeros(len(queries)))]
    while stack:
        node, q, least = stack.pop()
        alive = least * relax <= found.bound(q) * (1 + SLACK) + SLACK
        q, least = q[alive], least[alive]
        if not len(q):
            continue
        if not isinstance(node, list):
            for at in range(0, len(q), TILE_QUERIES):
                for a in range(0, len(node), TILE_ROWS):
                    _search_leaf(tree, node[a:a + TILE_ROWS], queries, query_ids, q[at:at + TILE_QUERIES], found)
            continue
        found.compared += len(q)
        vantage, near_max, far_min, far_max, near, far = node
        d = euclidean(queries[q], tree.vectors[vantage])
        in_near = np.maximum(least, d - near_max)
        in_far = np.maximum(least, np.maximum(far_min - d, d - far_max))
        first = in_near <= in_far
        # the last pushed is searched first: queries see their nearer side before the other
        for side, pick, low in ((far, first, in_far), (near, ~first, in_near), (near, first, in_near),
                                (far, ~first, in_far)):
            if pick.any():
                stack.append((side, q[pick], low[pick]))
    return found


def _search_leaf(tree: Tree, rows: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, q: np.ndarray, found: Found) -> None:
    """Offer a leaf's rows. Squared distances from inner products, with their rounding errors' bound, leave out rows that cannot
    come in; the others' distances are taken exactly."""
    found.compared += len(q) * len(rows)
    asked, other = queries[q], query_ids[q][:, None] == tree.ids[rows][None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        size = (asked ** 2).sum(axis=1)[:, None] + tree.squares[rows][None, :]
        rough = size - 2 * (asked @ tree.vectors[rows].T)
        slack = size * SLACK
    if np.isfinite(slack).all():
        limit = found.bound(q) ** 2
        rough[other] = np.inf
        if tree.single_ids and len(rows) > found.k:   # with several rows of one id the k-th row need not be the k-th id
            limit = np.minimum(limit, np.partition(rough, found.k - 1, axis=1)[:, found.k - 1])
        near = ~other & (rough <= limit[:, None] * (1 + SLACK) + 4 * slack)
        most = int(near.sum(axis=1).max(initial=0))
        if not most:
            return
        pick = np.argpartition(np.where(near, rough, np.inf), most - 1, axis=1)[:, :most]
        near = np.take_along_axis(near, pick, 1)
    else:   # numbers whose squares a double does not hold
        pick, near = np.broadcast_to(np.arange(len(rows)), other.shape), ~other
    d = euclidean(asked[:, None, :], tree.vectors[rows[pick]])
    found.offer(q, np.where(near, d, np.inf), tree.ids[rows[pick]])


def takes_part(vector: Column) -> Column:
    """Whether a vector is not null, has components, all finite, and is not zero."""
    x = vector.cast("array<double>")
    return F.coalesce(
        (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), width)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, relax: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of every row where ``queries`` holds.

    Rows with a null id, and null, zero or non-finite vectors, take no part, nor do vectors of another length than the
    most frequent one (ties: the longer). A query's own id is no candidate; a repeated id counts once, by its nearest
    vector. Equal
    distances go to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = vectors.where(vectors[id_col].isNotNull() & takes_part(vectors[vector_col])).select(
        vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    widths = valid.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    out = "query_id long, id long, score double"
    if not widths:
        return spark.createDataFrame([], out).select("query_id", F.lit(0).alias("rank"), "id", "score")
    width, n = widths[0]
    valid = valid.where(F.size("v") == width)
    sample = valid.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MAX_PIVOTS, n // shard_rows))).collect()
    pivots = np.unique(np.array([r["v"] for r in sample], float), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            d = np.stack([euclidean(v, p) for p in pivots], axis=1)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(d[np.arange(len(d)), cell])],
                ["id", "v", "asks", "cell", "d"])

    placed = materialize(valid.mapInArrow(assign, "id long, v array<double>, asks boolean, cell long, d double"))
    # one row per pivot
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max("d").alias("radius")).collect()}
    parts = {c: -(-r["n"] // shard_rows) for c, r in cells.items()}

    def by_cell(values: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(values.get(c, 0)) for c in range(len(pivots))]),
                            (F.col("cell") + 1).cast("int"))

    # by place, not id: the rows of one id are dealt like others
    data = placed.select("id", "v", "cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), by_cell(parts)).alias("shard"))

    def search(key: tuple, shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if shard.empty or ask.empty:
            return empty
        ids = shard["id"].to_numpy(np.int64)
        tree = Tree(_matrix(shard["v"], width), ids)
        query_ids = ask["id"].to_numpy(np.int64)
        found = search_tree(tree, _matrix(ask["v"], width), query_ids, k, relax, ask["reach"].to_numpy(float))
        row, col = np.nonzero(np.isfinite(found.score))
        return pd.DataFrame({"query_id": query_ids[row], "id": found.id[row, col], "score": found.score[row, col]})

    def run(asks: DataFrame, visits: dict[int, int]) -> DataFrame:
        """Every shard of a cell meets every block of the queries that come to the cell; a cell without any is left out."""
        blocks = by_cell({c: -(-q // QUERY_ROWS) for c, q in visits.items()})
        keys = ["cell", "shard", "block"]
        shards = data.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(1), blocks)))
        to = asks.withColumn("block", (F.pmod(F.xxhash64(F.lit(1), "id"), blocks) + 1).cast("int")).withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), (by_cell(parts) - 1).cast("long"))))
        return shards.groupBy(*keys).cogroup(to.select("id", "v", "reach", *keys).groupBy(*keys)).applyInPandas(search, out)

    asked = placed.where("asks").select("id", "v", "cell")
    home = materialize(run(asked.withColumn("reach", F.lit(float("inf"))), {c: r["q"] for c, r in cells.items()}))
    reach = _top(home, k).groupBy("query_id").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("got"))
    known = asked.join(reach, asked["id"] == reach["query_id"], "left").withColumn(
        "reach", F.when(F.col("got") >= k, F.col("far")).otherwise(float("inf")))
    radius = np.array([cells[c]["radius"] if c in cells else -np.inf for c in range(len(pivots))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            d = np.stack([euclidean(v, p) for p in pivots], axis=1)
            reach = b.column(3).to_numpy(zero_copy_only=False)[:, None]
            go = (np.maximum(d - radius, 0) * relax <= reach * (1 + SLACK) + SLACK) & np.isfinite(radius)
            go[np.arange(len(d)), b.column(2).to_numpy(zero_copy_only=False)] = False
            row, cell = np.nonzero(go)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(cell.astype("int64")),
                 b.column(3).take(take)], ["id", "v", "cell", "reach"])

    others = materialize(known.select("id", "v", "cell", "reach").mapInArrow(
        spread, "id long, v array<double>, cell long, reach double"))
    # one row per pivot
    visits = {r["cell"]: r["count"] for r in others.groupBy("cell").count().collect()}
    return _top(home.union(run(others, visits)), k).select("query_id", "rank", "id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
