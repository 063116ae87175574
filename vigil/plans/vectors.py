"""Word vectors as distributed tables.

Parameters are two tables keyed by word id: ``emb`` (id, v) and ``out`` (id, u, b). The data are the distinct (center, context)
pairs of the token stream with their counts, as bytes by the cells of a grid (blocks of centers by blocks of targets). A step draws
negatives for each pair by a hashed, log-uniform rule, deals them to their cells, meets all pairs there with the blocks' parameters, and
sums the gradients of noise-contrastive estimation per id, some columns of the grid at a time; no matrix is ever whole in one place. A
frequent word is one row of a parameter table and many pairs, which the cells of its block share.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expr import l2_normalize
from ..operators.coded import packed, unpacked
from ..operators.materialize import Scratch, scratch_table, written
from .text import lookup_vectors

PRIME = 2147483647    # 2 ^ 31 - 1, modulus of the draws
FACTOR = 48271        # a primitive root of it
CELL_ROWS = 1 << 23   # rows of a cell, about: what one task holds at a time, as bytes
PIECE_ROWS = 1 << 19  # rows of a piece at most: what is unpacked at a time
COUNT_ROWS = 1 << 22  # pairs that a task counts at a time
PASS_CELLS = 32       # cells whose parameters are on disk at once, or a row of the grid
MEAN_ROWS = 1 << 24   # ids of a block of documents, about
MEAN_CHUNK = 1 << 16  # ids whose vectors are added up at a time


def first_vectors(vocab: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(emb, out) before the first step, by a fixed rule that two engines can rebuild: vectors within -1..1, outputs within
    a sqrt(dim)-th of it, no bias."""
    def rule(k: int, a: int, b: int) -> Column:
        return F.pmod(F.col("id") * a + F.lit((k + 1) * b), F.lit(10007)) / F.lit(10007.0) * 2 - 1
    ids = vocab.select(F.col("id").cast("long").alias("id"))
    emb = ids.select("id", F.array(*[rule(k, 7919, 104729) for k in range(dim)]).alias("v"))
    out = ids.select("id", F.array(*[rule(k, 104729, 7919) / dim ** 0.5 for k in range(dim)]).alias("u"), F.lit(0.0).alias("b"))
    return emb, out


def drawn_ids(center: np.ndarray, context: np.ndarray, draw: int, step: int, n_ids: int) -> np.ndarray:
    """Ids of 0..n_ids - 1, id i with probability ln((i + 2) / (i + 1)) / ln(n_ids + 1), by a hash of the arguments."""
    h = (center * 40503 + context * 30011 + (draw * 20021 + step * 10007 + 1)) % PRIME
    for _ in range(3):
        h = h * FACTOR % PRIME
    picked = np.floor(np.exp(h / float(PRIME) * math.log(n_ids + 1.0))).astype(np.int64) - 1
    return np.clip(picked, 0, n_ids - 1)


def expected_log(target: np.ndarray, negatives: int, n_ids: int) -> np.ndarray:
    """ln of how often a target is drawn for a pair: what noise-contrastive estimation takes off a score."""
    return np.log(negatives * np.log((target + 2.0) / (target + 1.0)) / math.log(n_ids + 1.0))


def cells(rows: int) -> int:
    """Blocks of ids on either side, so that a cell of the grid holds about ``CELL_ROWS`` rows."""
    return max(1, math.ceil(math.sqrt(rows / CELL_ROWS)))


def _block(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _id_block(c: Column, n: int) -> Column:
    return F.pmod(F.pmod(c * FACTOR, F.lit(PRIME)), F.lit(n)).cast("int")


def _id_blocks(ids: np.ndarray, n: int) -> np.ndarray:
    """``_id_block`` of an array."""
    return ids * FACTOR % PRIME % n


# ------------------------------------------------------------------ pieces: (center, target, mark) of a cell as bytes
# mark is twice the number of pairs, one more if they are of the text

def _piece(center: np.ndarray, target: np.ndarray, mark: np.ndarray) -> bytes:
    """Rows in the order of the centers, which are kept as steps; ids take 31 bits."""
    raw = packed(np.diff(center, prepend=0)) + packed(target) + packed(mark)
    return len(center).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _rows(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(piece[:8], "little")
    raw = pa.decompress(piece[8:], 12 * n, codec="zstd", asbytes=True)
    steps, target, mark = (x.astype(np.int64) for x in unpacked(raw[4 * n * k:4 * n * (k + 1)] for k in range(3)))
    return np.cumsum(steps), target, mark


PIECES = pa.schema([("c", pa.int32()), ("t", pa.int32()), ("piece", pa.binary())])


def _pieces(found: Iterable[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows (c, t, piece) of cells and their (center, target, mark), which stand by center."""
    rows = [(c, t, _piece(*(x[k:k + PIECE_ROWS] for x in columns))) for c, t, *columns in found for k in range(0, len(columns[0]), PIECE_ROWS)]
    return pa.Table.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows) if rows else [[]] * 3, PIECES.types)], schema=PIECES)


def _dealt(c: np.ndarray, t: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each cell's part of the columns, in their order."""
    if not len(c):
        return
    order = np.argsort(c * (t.max() + 1) + t, kind="stable")
    c, t, columns = c[order], t[order], [x[order] for x in columns]
    starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])]))
    for low, high in zip(starts, np.append(starts[1:], len(c))):
        yield int(c[low]), int(t[low]), *[x[low:high] for x in columns]


def _counted(center: np.ndarray, target: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs by center, and how often each stands there."""
    key = (center << 32) | target
    if times is None:
        key, times = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, times = key[starts], np.add.reduceat(times, starts) if len(starts) else times
    return key >> 32, key & 0xFFFFFFFF, times


def pair_counts(pairs: DataFrame, blocks: int) -> DataFrame:
    """(c, t, piece): the distinct pairs and their counts, by the cells of a grid. A task counts some millions of pairs at a time
    before they are dealt to their cell, as bytes."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            center, target, times = _counted(*(np.concatenate(x) for x in zip(*held)))
            yield from _pieces(_dealt(_id_blocks(center, blocks), _id_blocks(target, blocks), center, target, 2 * times + 1)).to_batches()
        for b in batches:
            held.append([x.to_numpy().astype(np.int64) for x in b.columns])
            n += b.num_rows
            if n >= COUNT_ROWS:
                yield from cut()
                held, n = [], 0
        if held:
            yield from cut()

    def merged(found: pa.Table) -> pa.Table:
        center, target, mark = (np.concatenate(x) for x in zip(*map(_rows, found["piece"].to_pylist())))
        center, target, times = _counted(center, target, mark >> 1)
        return _pieces([(found["c"][0].as_py(), found["t"][0].as_py(), center, target, 2 * times + 1)])

    kinds = "c int, t int, piece binary"
    return pairs.select("center", "context").mapInArrow(local, kinds).groupBy("c", "t").applyInArrow(merged, kinds)


def _sums(rows: Iterable[tuple[np.ndarray, ...]], known: pa.Table, dim: int) -> pa.Table:
    """(side, id, d0.., db) of rows (center, target, y, e, w), some at a time, that meet the parameters (side, id, x0.., b)."""
    side = known["side"].to_numpy()
    parts = []
    for k in (0, 1):
        some = known.filter(pa.array(side == k))
        ids, order = np.unique(some["id"].to_numpy(), return_index=True)
        parts.append((ids, np.stack([some[f"x{m}"].to_numpy()[order] for m in range(dim)], axis=1), some["b"].to_numpy()[order]))
    (cids, v, _), (tids, u, b) = parts
    moved = [(np.zeros((dim + 1, len(ids))), np.zeros(len(ids), bool)) for ids in (cids, tids)]
    for center, target, y, e, w in rows:
        # rows of ids that have no parameters move nothing
        i, j = (np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0)) for ids, x in ((cids, center), (tids, target)))
        live = np.flatnonzero((cids[i] == center) & (tids[j] == target)) if len(cids) and len(tids) else np.zeros(0, np.int64)
        i, j = i[live], j[live]
        vi, uj = v[i], u[j]
        with np.errstate(over="ignore"):
            g = (y[live] - 1.0 / (1.0 + np.exp(-(np.einsum("rk,rk->r", vi, uj) + b[j] - e[live])))) * w[live]
        for (d, met), at, other in ((moved[0], i, uj), (moved[1], j, vi)):
            order = np.argsort(at, kind="stable")
            pull, starts = g[order], np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(starts):
                some = at[order[starts]]
                for m in range(dim):
                    d[m, some] += np.add.reduceat(pull * other[order, m], starts)
                d[dim, some] += np.add.reduceat(pull, starts)
                met[some] = True
    found = []
    for k, (ids, (d, met)) in enumerate(zip((cids, tids), moved)):
        some = np.flatnonzero(met)
        found.append(pa.table([pa.array(np.full(len(some), k, np.int32)), pa.array(ids[some].astype(np.int64)),
                               *[pa.array(x[some]) for x in d]], ["side", "id", *[f"d{m}" for m in range(dim)], "db"]))
    return pa.concat_tables(found)


def _sum_columns(dim: int) -> str:
    return ", ".join(["side int, id long", *[f"d{m} double" for m in range(dim)], "db double"])


def _parameters(emb: DataFrame, out: DataFrame, dim: int, blocks: int, targets: range) -> DataFrame:
    """(of_c, of_t, side, id, x0.., b): a copy of each id's parameters for every cell of its block and of the blocks ``targets``."""
    def copies(table: DataFrame, side: int, name: str, c: Column, t: Column, b: Column) -> DataFrame:
        return table.select(c.alias("of_c"), t.alias("of_t"), F.lit(side).alias("side"), "id",
                            *[F.get(name, F.lit(m)).cast("double").alias(f"x{m}") for m in range(dim)], b.alias("b"))
    own = _id_block(F.col("id"), blocks)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    some = F.explode(F.sequence(F.lit(targets.start), F.lit(targets.stop - 1)))
    there = out.where((own >= targets.start) & (own < targets.stop))
    return copies(emb, 0, "v", own, some, F.lit(0.0)).unionByName(copies(there, 1, "u", every, own, F.col("b")))


def gradients(rows: DataFrame, emb: DataFrame, out: DataFrame, dim: int, blocks: int) -> DataFrame:
    """(side, id, d0.., db): the sums of ``rows`` (center, target, y, e, w) over each cell of a grid of center and target blocks, which
    hold what moves a center's vector (side 0), a target's output and its bias (side 1). A row's pull is (y - sigmoid(v u + b - e)) w.

    A cell meets its rows with one copy of its blocks' parameters, so parameters travel once a block and not once a row. A
    frequent word's rows are spread over the cells of its block."""
    dealt = rows.select(_id_block(F.col("center"), blocks).alias("c"), _id_block(F.col("target"), blocks).alias("t"),
                        "center", "target", "y", "e", "w")

    def sums(met: pa.Table, known: pa.Table) -> pa.Table:
        return _sums([[met[c].to_numpy() for c in ("center", "target", "y", "e", "w")]], known, dim)
    params = _parameters(emb, out, dim, blocks, range(blocks))
    return dealt.groupBy("c", "t").cogroup(params.groupBy("of_c", "of_t")).applyInArrow(sums, _sum_columns(dim))


def pair_gradients(counts: DataFrame, emb: DataFrame, out: DataFrame, dim: int, blocks: int, targets: range, step: int, negatives: int,
                   n_ids: int, n_pairs: int) -> DataFrame:
    """``gradients`` of the pairs of ``counts`` (c, t, piece) and of the negatives drawn for them, as far as their targets lie in the
    blocks ``targets``. Rows travel as bytes; what a row weighs and expects follows from its target and mark."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, t, piece in zip(*(x.to_pylist() for x in b.columns)):
                if t in targets:
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((c, t, piece), PIECES.types)], schema=PIECES)
                center, context, mark = _rows(piece)
                for j in range(negatives):
                    drawn = drawn_ids(center, context, j, step, n_ids)
                    to = _id_blocks(drawn, blocks)
                    here = np.flatnonzero((to >= targets.start) & (to < targets.stop))
                    yield from _pieces(_dealt(np.full(len(here), c), to[here], center[here], drawn[here], mark[here] - 1)).to_batches()

    def sums(met: pa.Table, known: pa.Table) -> pa.Table:
        def rows() -> Iterator[tuple]:
            for piece in met["piece"]:
                center, target, mark = _rows(piece.as_py())
                yield center, target, mark & 1, expected_log(target, negatives, n_ids), (mark >> 1) / n_pairs
        return _sums(gathered(rows()), known, dim)

    def gathered(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, n = [], 0   # small pieces are taken together
        for x in rows:
            held.append(x)
            n += len(x[0])
            if n >= PIECE_ROWS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    params = _parameters(emb, out, dim, blocks, targets)
    return (counts.mapInArrow(dealt, "c int, t int, piece binary").groupBy("c", "t")
            .cogroup(params.groupBy("of_c", "of_t")).applyInArrow(sums, _sum_columns(dim)))


def train_step(counts: DataFrame, emb: DataFrame, out: DataFrame, dim: int, step: int, negatives: int, rate: float,
               n_ids: int, n_pairs: int, blocks: int) -> tuple[Scratch, Scratch]:
    """One full-batch step of gradient descent on the mean loss over all pairs.

    The grid is worked through some target blocks at a time: the copies of parameters and the sums of ``PASS_CELLS`` cells or more, a
    row of the grid at least, are on disk at once, and only each id's sum is kept of them."""
    width = max(1, -(-PASS_CELLS // blocks))
    names = [*[f"d{k}" for k in range(dim)], "db"]
    passes = []
    for low in range(0, blocks, width):
        some = pair_gradients(counts, emb, out, dim, blocks, range(low, min(low + width, blocks)), step, negatives, n_ids, n_pairs)
        passes.append(scratch_table(some.groupBy("side", "id").agg(*[F.sum(c).alias(c) for c in names]), "moves"))
    moves = reduce(DataFrame.unionByName, [p.df for p in passes])

    def moved(side: int, table: DataFrame, name: str, *others: Column) -> DataFrame:
        sums = moves.where(F.col("side") == side).groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
        d = F.array(*names[:-1])
        new = F.when(F.col("db").isNull(), F.col(name)).otherwise(F.zip_with(name, d, lambda x, y: x + rate * y)).alias(name)
        return table.withColumnRenamed("b", "bias").join(sums, "id", "left").select("id", new, *others)
    bias = (F.col("bias") + rate * F.coalesce("db", F.lit(0.0))).alias("b")
    found = scratch_table(moved(0, emb, "v"), "emb"), scratch_table(moved(1, out, "u", bias), "out")
    for p in passes:
        p.drop()
    return found


def word_vectors(pairs: DataFrame, vocab: DataFrame, dim: int, steps: int, negatives: int = 1, rate: float = 1.0) -> DataFrame:
    """(id, vector): unit vectors of every word of ``vocab`` (id, ...) after ``steps`` steps over ``pairs`` (center, context)."""
    n = pairs.count()   # a number
    blocks = cells(n * (1 + negatives))
    counts = scratch_table(pair_counts(pairs, blocks), "pairs")
    emb, out = first_vectors(vocab, dim)
    n_ids = emb.count()
    last: list[Scratch] = []
    for step in range(steps):
        tables = train_step(counts.df, emb, out, dim, step, negatives, rate, n_ids, n, blocks)
        for t in last:
            t.drop()
        last, (emb, out) = list(tables), (t.df for t in tables)
    counts.drop()
    for t in last[1:]:
        t.drop()
    return emb.select("id", l2_normalize("v").alias("vector"))


def document_means(ids: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``means_of_documents`` of rows (doc_id, id)."""
    return means_of_documents(ids.groupBy("doc_id").agg(F.collect_list("id").alias("ids")), vectors, dim)


def means_of_documents(documents: DataFrame, vectors: DataFrame, dim: int, tokens: int | None = None) -> DataFrame:
    """(doc_id, n, m): of the ids of each document's rows (doc_id, ids) that have a vector (id, v), how many, and the mean vector; a
    component that is null takes no part in its mean.

    Documents are dealt to blocks of about ``MEAN_ROWS`` ids and written once, with each block's distinct ids. A block looks each of
    those up once, and its sums stand in one task for its documents alone, however many documents there are. ``tokens`` is the number of
    all ids, counted if not given. Vectors travel as they are stored (floats as floats); sums are doubles."""
    if tokens is None:
        documents = written(documents, "documents")
        tokens = documents.agg(F.sum(F.size("ids"))).first()[0] or 0
    blocks = max(1, math.ceil(tokens / MEAN_ROWS))
    kind, of = documents.schema["doc_id"].dataType, documents.schema["ids"].dataType.elementType
    # a shuffle gives a group of its own to a block, and more blocks than tasks keep them alike
    dealt = documents.select(_block(F.col("doc_id"), blocks).alias("block"), "doc_id", "ids")

    def needed(rows: pa.Table) -> pa.Table:
        found = pa.array(np.unique(rows["ids"].combine_chunks().flatten().drop_null().to_numpy()), to_arrow_type(of))
        n, block = len(found), rows["block"][0].as_py()
        docs = rows["doc_id"].combine_chunks()
        lists = rows["ids"].combine_chunks()
        return pa.table([pa.array(np.full(len(docs) + n, block, np.int32)), pa.concat_arrays([pa.nulls(len(docs), found.type), found]),
                         pa.concat_arrays([docs, pa.nulls(n, docs.type)]), pa.concat_arrays([lists, pa.nulls(n, lists.type)])],
                        ["block", "id", "doc_id", "ids"])

    kinds = f"block int, id {of.simpleString()}, doc_id {kind.simpleString()}, ids array<{of.simpleString()}>"
    table = scratch_table(dealt.groupBy("block").applyInArrow(needed, kinds), "dealt").df
    component = vectors.schema["v"].dataType.elementType.simpleString()
    wanted = table.where("id is not null").select("block", F.col("id").cast(vectors.schema["id"].dataType).alias("id"))
    found = lookup_vectors(wanted, vectors).select(F.col("block").alias("at"), F.col("id").alias("of"), F.array(
        *[F.get("v", F.lit(k)) for k in range(dim)]).cast(f"array<{component}>").alias("v"))

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n", pa.int64()), ("m", pa.list_(pa.float64()))])

    def means(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows or not known.num_rows:
            return schema.empty_table()
        known = known.sort_by("of")
        uids, first, times = np.unique(known["of"].to_numpy(), return_index=True, return_counts=True)
        flat = known["v"].combine_chunks().flatten()
        x = flat.fill_null(0).to_numpy().reshape(-1, dim)
        valid = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim) if flat.null_count else None
        if len(uids) < len(x):   # an id may have several vectors
            x = np.add.reduceat(x.astype(np.float64), first)
            valid = np.add.reduceat(valid.astype(np.int64), first) if valid is not None else None
        lists = rows["ids"].combine_chunks()
        sizes, tokens = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten()
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if tokens.null_count:
            row, tokens = row[tokens.is_valid().to_numpy(zero_copy_only=False)], tokens.drop_null()
        tokens = tokens.to_numpy()
        at = np.minimum(np.searchsorted(uids, tokens), len(uids) - 1).astype(np.int32)
        live = uids[at] == tokens
        at, row = at[live], row[live]
        coded = rows["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        doc = coded.indices.to_numpy()
        n, out = np.zeros(len(coded.dictionary), np.int64), np.zeros((len(coded.dictionary), dim))
        seen = np.zeros((len(n), dim), np.int64)
        # a row's ids stand together: whole rows at a time
        ends = np.cumsum(np.bincount(row, minlength=len(sizes)))
        low = 0
        while low < len(at):
            high = max(ends[np.searchsorted(ends, low, "right")], ends[max(np.searchsorted(ends, low + MEAN_CHUNK, "right") - 1, 0)])
            some, of_row = at[low:high], row[low:high]
            starts = np.flatnonzero(np.concatenate([[True], of_row[1:] != of_row[:-1]]))
            docs = doc[of_row[starts]]
            np.add.at(n, docs, np.add.reduceat(times[some], starts))
            np.add.at(out, docs, np.add.reduceat(x[some].astype(np.float64), starts))
            if valid is not None:
                np.add.at(seen, docs, np.add.reduceat(valid[some].astype(np.int64), starts))
            low = high
        seen = np.repeat(n[:, None], dim, 1) if valid is None else seen
        some = np.flatnonzero(n)   # documents without a vector give no row
        out, gone = out[some] / np.maximum(seen[some], 1), seen[some] == 0
        offsets = pa.array(np.arange(0, (len(some) + 1) * dim, dim, dtype=np.int32))
        return pa.table([coded.dictionary.take(pa.array(some)), pa.array(n[some]),
                         pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), mask=gone.ravel()))], ["doc_id", "n", "m"])

    docs = table.where("id is null").select("block", "doc_id", "ids")
    return docs.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(
        means, f"doc_id {kind.simpleString()}, n long, m array<double>")
