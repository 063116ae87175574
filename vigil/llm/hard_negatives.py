"""Hard-negative mining by slot-decomposed selection.

An anchor's positives bound windows of scores: a negative answers a positive if its score lies between two
percentages of the positive's. The windows of one anchor overlap. Their upper limits, highest first, split the scores
into disjoint slots: a slot reaches from its limit down to the next lower one. A shard of the rows keeps the best k
of every slot (the combiner), the shards' lists are merged slot by slot, and a descending merge over the slots from
a positive's own limit downwards gives the best k rows at or below it: those within its window answer it.
Nothing else of a slot can reach any window's first k, so only k rows a slot and shard are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize

SHARD_ROWS = 4096     # rows of a shard, about
ANCHOR_ROWS = 4096    # anchors that a shard meets at a time, about
TILE_SCORES = 1 << 20   # scores held at a time
NONE = np.iinfo(np.int64).min   # no score
EXACT = 2.0 ** 53


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v)
                               & (F.abs(v) < float("inf"))), F.lit(False))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as int64; beyond its range the nearest number it holds."""
    width = a.shape[1]
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if width * float(np.abs(a).max()) * float(np.abs(b).max()) < EXACT:   # no partial sum is rounded
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[max(NONE + 1, min(-(NONE + 1), sum(x * y for x, y in zip(p, q)))) for q in whole[1]]
                     for p in whole[0]], np.int64)


def best(masked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest of each row, ``NONE`` apart; of equals the earlier columns. Spoils ``masked``."""
    rows, cols = [], []
    live = np.arange(len(masked))
    for _ in range(k):
        if not masked.shape[1] or not len(live):
            break
        at = masked[live].argmax(axis=1)
        there = masked[live, at] != NONE
        live, at = live[there], at[there]
        rows.append(live)
        cols.append(at)
        masked[live, at] = NONE
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def slots(positives: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """(least, greatest) score of each slot, greatest first: between the distinct upper limits of the windows that hold
    a score at all, and not below the least score that a window reaching into the slot asks for."""
    spans = sorted({w for w in (window(p, low, high) for p in positives) if w[0] <= w[1]}, key=lambda w: (-w[1], -w[0]))
    limits = sorted({hi for _, hi in spans}, reverse=True)
    out = []
    for hi, below in zip(limits, [*limits[1:], None]):
        least = min(lo for lo, top in spans if top >= hi)
        out.append((least if below is None else max(least, below + 1), hi))
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), width)


def _shard(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A shard's rows in the order of ties, and their vectors."""
    frame = frame.sort_values(["id", "place"], kind="stable", ignore_index=True)
    return frame, _matrix(frame["v"], int(frame["width"].iat[0]))


def mine(vectors: DataFrame, label: Column, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: float = 256.0, n_positives: int = 5, k: int = 3, low: int = 50, high: int = 95,
         shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row where ``anchors`` holds.

    A component counts as floor(scale * component). A row's score is its integer inner product with the anchor; ties go to the smaller
    id. The positives are the anchor's first ``n_positives`` other rows of the same ``label``; for each, the first
    ``k`` rows of other labels whose score is between ``low`` and ``high`` per cent of the positive's are returned.
    Rows go by themselves: a repeated row is a row of its own, and an anchor row's twin may be its positive (ties of
    one id: by place in the input). Rows with a null id, label or vector, and those with null or non-finite
    components, take no part; vectors of different length are not compared; an empty vector scores 0. A
    positive below zero has no window. An anchor without positives, or without rows in a window, returns none; an empty table no rows. Scores
    beyond a long's range count as the nearest long. Other columns are not read, whatever their names.
    """
    rows = materialize(
        vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"),
                       F.transform(vectors[vector_col].cast("array<double>"), lambda x: _floor(x * scale)).alias("v"),
                       F.coalesce(anchors, F.lit(False)).alias("asks"), finite(vectors[vector_col]).alias("_fine"))
        .where("id is not null and label is not null and _fine").drop("_fine")
        .withColumn("width", F.size("v")).withColumn("place", F.monotonically_increasing_id()))
    positives = _positives(rows, n_positives, shard_rows, anchor_rows)
    asked = (rows.where("asks").select("place", "id", "label", "width", "v")
             .join(positives.withColumnRenamed("anchor", "place"), "place"))
    found = _negatives(rows, asked, k, low, high, shard_rows, anchor_rows)
    mine_of = positives.join(asked.select(F.col("place").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    each = mine_of.select("anchor", "anchor_id", F.posexplode("positives").alias("_n", "positive")).select(
        "anchor", "anchor_id", "_n", F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    # the slots' lists, slot after slot, are in descending order: from a positive's limit down, the first k are its merge
    p = F.col("positive_score").cast("decimal(38,0)")
    fits = F.filter("found", lambda c: (c["score"].cast("decimal(38,0)") * 100 <= p * high)
                    & (c["score"].cast("decimal(38,0)") * 100 >= p * low))
    return (each.join(found, "anchor")
            .select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(fits, 1, k)).alias("_at", "n"))
            .select("anchor_id", "positive_id", (F.col("_at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
                    "positive_score", F.col("n.score").alias("negative_score")))


def _floor(x: Column) -> Column:
    """Floor as a double, also beyond a long's range, where a double is whole; an overflow to infinity becomes the
    greatest double."""
    most = 1.7976931348623157e308
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), x)))


def _renewed(frame: DataFrame, *columns: str) -> DataFrame:
    """The columns under new identities, so that a frame can meet one of the same origin."""
    return frame.select(*[F.col(c).alias(c) for c in columns])


def _positives(rows: DataFrame, n: int, shard_rows: int, anchor_rows: int) -> DataFrame:
    """(anchor, positives): the anchor's best rows of its own label, best first. A label's rows are dealt to shards and
    its anchors to blocks, so a frequent label is many groups."""
    key = ["width", "label", "shard", "block"]
    size = rows.groupBy("width", "label").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"),
                                              F.ceil(F.count_if("asks") / anchor_rows).alias("blocks"))
    sized = rows.join(size.where("blocks > 0"), ["width", "label"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    data = sized.withColumn("shard", F.pmod(F.xxhash64("place"), "shards")).withColumn("block", each)
    asks = sized.where("asks").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "place"), "blocks")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))

    def search(shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(ask):
            shard, d = _shard(shard)
            place, ids = shard["place"].to_numpy(np.int64), shard["id"].to_numpy(np.int64)
            a, own = _matrix(ask["v"], d.shape[1]), ask["place"].to_numpy(np.int64)
            step = max(1, TILE_SCORES // len(d))
            for at in range(0, len(a), step):
                s = scores(a[at:at + step], d)
                m = np.where(own[at:at + step, None] == place[None, :], NONE, s)
                r, c = best(m, n)
                out.append(pd.DataFrame({"anchor": own[at:at + step][r], "score": s[r, c], "id": ids[c], "place": place[c]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "score", "id", "place")})

    parts = data.select("id", "place", "v", *key).groupBy(*key).cogroup(
        _renewed(asks, "place", "v", *key).groupBy(*key)).applyInPandas(search, "anchor long, score long, id long, place long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "place")
    top = parts.withColumn("n", F.row_number().over(first)).where(F.col("n") <= n)
    # n rows an anchor
    return materialize(top.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id"))).alias("positives")))


def _negatives(rows: DataFrame, asked: DataFrame, k: int, low: int, high: int, shard_rows: int,
               anchor_rows: int) -> DataFrame:
    """(anchor, found): the best k rows of each slot, in descending order over all slots."""
    key = ["width", "shard", "block"]
    total, n_asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()   # two numbers
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-n_asks // anchor_rows))
    data = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asks = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "place"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(ask):
            shard, d = _shard(shard)
            place, ids, labels = (shard[c].to_numpy(np.int64) for c in ("place", "id", "label"))
            a, own, ask_labels = _matrix(ask["v"], d.shape[1]), ask["place"].to_numpy(np.int64), ask["label"].to_numpy(np.int64)
            cuts = [slots([int(x) for x in p], low, high) for p in ask["scores"]]
            step = max(1, TILE_SCORES // len(d))
            for at in range(0, len(a), step):
                s = scores(a[at:at + step], d)
                other = ask_labels[at:at + step, None] != labels[None, :]
                for i in range(max(map(len, cuts[at:at + step]), default=0)):
                    # an anchor with fewer slots: a slot that holds nothing
                    lo, hi = np.array([c[i] if i < len(c) else (1, 0) for c in cuts[at:at + step]], np.int64).T
                    m = np.where(other & (s >= lo[:, None]) & (s <= hi[:, None]), s, NONE)
                    r, c = best(m, k)
                    out.append(pd.DataFrame({"anchor": own[at:at + step][r], "slot": i, "score": s[r, c], "id": ids[c],
                                             "place": place[c]}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: np.zeros(0, np.int64) for c in ("anchor", "slot", "score", "id", "place")})

    asks = _renewed(asks.withColumn("scores", F.transform("positives", lambda p: p["score"])), "place", "label", "v", "scores", *key)
    parts = data.select("id", "place", "label", "v", *key).groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(
        search, "anchor long, slot int, score long, id long, place long")
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "place")
    top = parts.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    # k rows for each of the few slots of an anchor
    return top.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "score", "id"))).alias("found"))
