"""SimHash near-duplicates, linked through vantage-point trees.

Each text gets a 64-bit fingerprint of its shingles; equal fingerprints are one
point. A vantage-point tree, fitted on a bounded sample, partitions the points
by Hamming distance into shards. For an exact search radius, a point within the radius of a
split's bound is also sent, as a query, to shards beyond that bound; every
other branch is pruned by the triangle inequality. A shard builds a tree of its
own over its points and answers its points and the visiting queries. It returns a spanning
forest of the links it found, so a dense group costs as many edges as points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .common import texts_of
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SHARD_POINTS = 1 << 22  # points of a shard, about: fewer shards, fewer points near their bounds that query others
LEAST_POINTS = 8192     # points of a shard, at least
SPREAD = 16             # shards below SHARD_POINTS * SPREAD points, so that tasks share the work
SAMPLE_POINTS = 20_000  # points that the shards' tree is fitted on, at most
LEAF_PAIRS = 1 << 18    # a shard's tree compares all of two sets below this many pairs
SEED = 42


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a UTF-8 text, lower-cased in A-Z, repeats included."""
    words = text.lower().split()   # bytes: A-Z only, and space and 0x09-0x0D only
    if not words:
        return 0
    grams = [words[i:] for i in range(shingle_words)] if len(words) >= shingle_words else [
        [b" ".join(words)]]
    n = len(grams[-1])
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(b" ".join(g), SEED) for g in
                           zip(*[g[at:at + (1 << 16)] for g in grams])] if len(grams) > 1 else
                          [digest(grams[0][0], SEED)] if len(words) < shingle_words else
                          [digest(w, SEED) for w in grams[0][at:at + (1 << 16)]], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, point): the fingerprint of every row as a signed long; a null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([fingerprint(t, shingle_words) for t in texts_of(batch.column(1))], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points.view("<i8"))], ["doc_id", "point"])
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, point long")


# ------------------------------------------------------------------ vantage-point trees

def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def fit_tree(sample: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """A complete tree as (vantage point, bound) by heap position; its leaves are ``shards`` or
    the next power of two. Points at the bound or nearer go left.
    """
    levels = max(0, (shards - 1).bit_length())
    tree: list[tuple[int, int]] = []
    groups = [np.sort(sample)]
    for _ in range(levels):
        nxt = []
        for g in groups:
            if len(g) < 2:   # nothing left to split: all points go left
                tree.append((0, 64))
                nxt += [g, g[:0]]
                continue
            # of a few points, the one whose distances spread most separates best
            tried = g[:: max(1, len(g) // 16)][:16]
            spread = [distances(g, v).astype(np.int64).var() for v in tried]
            vantage = tried[int(np.argmax(spread))]
            d = distances(g, vantage)
            bound = int(np.sort(d)[(len(g) - 1) // 2])
            tree.append((int(vantage), bound))
            nxt += [g[d <= bound], g[d > bound]]
        groups = nxt
    return tree


def route(points: np.ndarray, tree: list[tuple[int, int]], radius: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, is_query): the home leaf of each point, and the leaves it must query.

    A home point near a bound on its left side asks the right side; that finds each pair across
    the bound once. A query goes to both sides unless the triangle inequality rules one out.
    """
    rows, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    query = np.zeros(len(points), bool)
    levels = len(tree).bit_length()
    vantages = np.array([v for v, _ in tree], np.uint64)
    bounds = np.array([b for _, b in tree], np.int64)
    for _ in range(levels):
        d = np.bitwise_count(points[rows] ^ vantages[node]).astype(np.int64)
        b = bounds[node]
        left = np.where(query, d - radius <= b, d <= b)
        right = np.where(query, d + radius > b, d > b)
        cross = ~query & left & (d + radius > b)
        rows, node, query = (np.concatenate(x) for x in (
            (rows[left], rows[right], rows[cross]),
            (2 * node[left] + 1, 2 * node[right] + 2, 2 * node[cross] + 2),
            (query[left], query[right], np.ones(int(cross.sum()), bool))))
    return rows, node - len(tree), query


class Forest:
    """Union-find over the points of a shard."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                self.up[i] = r
                return r
            r = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each pair; pairs already in one set cost a look-up only."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            a, b = np.maximum(a, b), np.minimum(a, b)
            a, b = a[a != b], b[a != b]
            # of the pairs of one root the smallest wins; the others are looked at again
            np.minimum.at(self.up, a, b)


def join_sets(points: np.ndarray, own: np.ndarray, visiting: np.ndarray, radius: int, forest: Forest) -> None:
    """Link every pair of ``own`` points, and of ``visiting`` with ``own``, within ``radius``.

    A tree over ``own`` in place: split by the distance to a vantage point, pass on only what the
    triangle inequality allows. Iterative, so its depth is not Python's.
    """
    stack = [(own, visiting)]
    while stack:
        own, visiting = stack.pop()
        if not len(own) or len(own) + len(visiting) < 2:
            continue
        if len(own) * (len(own) + len(visiting)) <= LEAF_PAIRS or len(own) <= 64:
            _compare(points, own, visiting, radius, forest)
            continue
        vantage = points[own[len(own) // 2]]
        d = distances(points[own], vantage).astype(np.int64)
        bound = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        inside = d <= bound
        if inside.all():   # at least half lie at the largest distance: split below it
            bound -= 1
            inside = d <= bound
        if not inside.any() or inside.all():
            _compare(points, own, visiting, radius, forest)
            continue
        dv = distances(points[visiting], vantage).astype(np.int64)
        cross = own[inside & (d + radius > bound)]
        stack.append((own[inside], visiting[dv - radius <= bound]))
        stack.append((own[~inside], np.concatenate([visiting[dv + radius > bound], cross])))


def _compare(points: np.ndarray, own: np.ndarray, visiting: np.ndarray, radius: int, forest: Forest) -> None:
    both = np.concatenate([own, visiting])
    step = max(1, LEAF_PAIRS // len(own))
    for at in range(0, len(both), step):
        some = both[at:at + step]
        x, y = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[own][None, :]) <= radius)
        forest.link(some[x], own[y])


def shard_count(n: int, shard_points: int = SHARD_POINTS) -> int:
    """Shards for ``n`` points; no more than the sample can tell apart."""
    some = min(SPREAD, -(-n // min(LEAST_POINTS, shard_points)))
    return max(1, min(max(some, -(-n // shard_points)), SAMPLE_POINTS // 8))


def link_points(points: DataFrame, radius: int = MAX_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most ``radius`` bits connect.

    ``points`` (point) holds each fingerprint once. The sample for the shards' tree, at most
    ``SAMPLE_POINTS`` points with the smallest hashes, is all that reaches the driver.
    """
    n = points.count()
    sample = [r["point"] for r in points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE_POINTS).collect()]
    tree = fit_tree(np.array(sample, "<i8").view("<u8"), shard_count(n, shard_points))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            rows, leaf, query = route(own, tree, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[rows].view("<i8")), pa.array(leaf), pa.array(query)], ["point", "shard", "visits"])

    def search(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        values = shard["point"].to_numpy(np.int64).view(np.uint64)
        visits = shard["visits"].to_numpy(bool)
        forest = Forest(len(values))
        join_sets(values, np.flatnonzero(~visits), np.flatnonzero(visits), radius, forest)
        roots = forest.roots(np.arange(len(values)))
        moved = roots != np.arange(len(values))
        return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[roots[moved]].view(np.int64)})

    dealt = points.select("point").mapInArrow(deal, "point long, shard long, visits boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _components(points: DataFrame, max_bits: int) -> DataFrame:
    """(point, ..., component) of every row of ``points``, which holds each fingerprint once."""
    linked = components(link_points(points.select("point"), max_bits))
    return points.join(linked.withColumnRenamed("node", "point"), "point", "left").withColumn(
        "component", F.coalesce("component", "point"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, point, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Texts without a word share fingerprint zero and link like others. ``component_id`` is the
    smallest doc_id reachable (null if all are null); repeated rows are points of one
    group; very long texts are hashed whole, a part of their shingles at a time; an empty table gives no rows; other
    columns are not read.
    """
    prints = materialize(fingerprints(docs, shingle_words))
    distinct = materialize(prints.groupBy("point").agg(F.min("doc_id").alias("least")))
    labels = _components(distinct, max_bits)
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labels.join(least, "component").select("point", "component_id")
    return prints.join(named, "point").select(
        "doc_id", "point", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def _row_key(docs: DataFrame) -> list[Column]:
    """A row's doc_id, its text's digest and a hash of its other columns: rows equal in the first two have one fingerprint."""
    def plain(c: str) -> Column:   # a map has no hash
        return F.to_json(F.struct(docs[c])) if any(k in dict(docs.dtypes)[c] for k in ("map<", "variant")) else docs[c]
    others = [x for c in docs.columns if c not in ("doc_id", "text") for x in (docs[c].isNull(), plain(c))]
    return [docs["doc_id"].cast("long"), F.sha2(docs["text"].cast("binary"), 256), F.xxhash64(F.lit(SEED), *others)]


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
             unnamed_stay: bool = True) -> DataFrame:
    """The rows of ``docs``, one of each group: the first by doc_id (nulls last), text digest and hash of the other
    columns; of rows equal in all of these one stays. A doc_id on several texts decides nothing: each row goes by its
    own text's group. With ``unnamed_stay``, rows without a doc_id all stay, and do not stand for
    a group; without it they are rows like others. All columns stay as they are."""
    key = [f"keep_{k}_{uuid.uuid4().hex[:8]}" for k in ("id", "text", "rest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([fingerprint(t, shingle_words) for t in texts_of(batch.column(3))], "<u8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(points.view("<i8"))], [*key, "point"])

    prints = docs.select(*[c.alias(k) for c, k in zip(_row_key(docs), key)], docs["text"]).mapInArrow(
        run, f"{key[0]} long, {key[1]} string, {key[2]} long, point long")
    # aggregated by point, then by component: copies of one text meet no join
    first = F.struct(F.col(key[0]).isNull().alias("unnamed"), *key)
    distinct = materialize(prints.groupBy("point").agg(F.min(first).alias("first")))
    kept = _components(distinct, max_bits).groupBy("component").agg(F.min("first").alias("first"))
    if unnamed_stay:
        kept = kept.where("not first.unnamed")
    kept = kept.select(*[F.col("first")[k].alias(k) for k in key])
    mine = [f"{k}_row" for k in key]
    rows = docs.where(docs["doc_id"].isNotNull()) if unnamed_stay else docs
    rows = rows.select("*", *[c.alias(k) for c, k in zip(_row_key(docs), mine)])
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(mine, key)]
    ones = rows.join(kept, same[0] & same[1] & same[2], "left_semi").dropDuplicates(mine).select(*docs.columns)
    return ones.unionByName(docs.where(docs["doc_id"].isNull())) if unnamed_stay else ones
