"""Documents as codes of a dictionary for each block: what is looked up by word travels once a block and word, not once a token.

A block is what a task reads at a time. ``code_documents`` writes one row a document (its words as places in the block's
dictionary) and one row a distinct word of the block; ``decode`` brings the words' ids back to the block's documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import Scratch, scratch_table


@dataclass
class Coded:
    """``documents`` (block, place, key, size, codes) and ``words`` (block, code, word, n, docs): how often a word stands in the block
    and in how many of its documents. ``place`` tells rows of one key apart and follows the input."""
    table: Scratch

    @property
    def documents(self) -> DataFrame:
        return self.table.df.where("place is not null").select("block", "place", "key", "size", "codes")

    @property
    def words(self) -> DataFrame:
        return self.table.df.where("word is not null").select("block", "code", "word", "n", "docs")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 0..2^32 - 1 by planes of bytes, the high ones first: those are mostly zero and compress to little."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[::-1]).tobytes()


def unpacked(data: Iterable[bytes | None]) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(x or b"", np.uint8).reshape(4, -1)[::-1].T).view("<u4").ravel() for x in data]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, key, words) of a batch -> its documents and its distinct words; documents without a word give no codes."""
    for b in batches:
        if not b.num_rows:
            continue
        place, key, words = b.columns
        sizes = words.value_lengths().fill_null(0).to_numpy()
        coded = words.flatten().dictionary_encode(null_encoding="encode")
        ends = np.cumsum(sizes)
        codes = coded.indices.to_numpy()
        block, n = place[0].as_py(), len(coded.dictionary)
        counts = np.bincount(codes, minlength=n)
        once = np.unique(np.repeat(np.arange(b.num_rows), sizes) * max(n, 1) + codes) % max(n, 1)
        held = np.bincount(once, minlength=n)
        rows = b.num_rows
        both = rows + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(both, block, np.int64)),
             pa.concat_arrays([place, pa.nulls(n, place.type)]), pa.concat_arrays([key, pa.nulls(n, key.type)]),
             pa.concat_arrays([pa.array(sizes.astype(np.int32)), pa.nulls(n, pa.int32())]),
             pa.array([packed(codes[e - s:e]) for s, e in zip(sizes, ends)] + [None] * n, pa.binary()),
             pa.concat_arrays([pa.nulls(rows, pa.int32()), pa.array(np.arange(n, dtype=np.int32))]),
             pa.concat_arrays([pa.nulls(rows, pa.string()), coded.dictionary.cast(pa.string())]),
             *[pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(x.astype(np.int64))]) for x in (counts, held)]],
            ["block", "place", "key", "size", "codes", "code", "word", "n", "docs"])


def code_documents(doc_toks: DataFrame, key: str = "doc_id") -> Coded:
    """Rows (key, words) coded and written once. Rows without an array of words are documents of no word."""
    placed = doc_toks.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"), "words")
    kind = placed.schema["key"].dataType.simpleString()
    rows = placed.mapInArrow(_coded, f"block long, place long, key {kind}, size int, codes binary, code int, word string, n long, docs long")
    return Coded(scratch_table(rows, "coded"))


def word_ids(coded: Coded, vocab: DataFrame) -> DataFrame:
    """(block, code, id) of the words that ``vocab`` (word, id) has."""
    return coded.words.select("block", "code", "word").join(vocab.select("word", F.col("id").cast("int").alias("id")), "word").select(
        "block", "code", "id")


def decode(documents: DataFrame, ids: DataFrame, carried: str, starts: DataFrame | None = None) -> DataFrame:
    """(carried, ids): the codes of ``documents`` (block, place, size, codes, carried) as the ids that ``ids`` (block, code, id) has
    for them, 0 without one. With ``starts`` (block, place, start) ``carried`` is "start" and comes from there. Documents without a
    word are left out."""
    numbered = starts is not None
    kind = (starts if numbered else documents).schema[carried].dataType
    known = ids.select(F.col("block").alias("of"), "code", F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("place"))
    if numbered:
        known = known.unionByName(starts.select(F.col("block").alias("of"), F.lit(None).cast("int").alias("code"), F.col("start").alias("id"), "place"))

    def decoded(docs: pa.Table, known: pa.Table) -> pa.Table:
        codes = unpacked(docs["codes"].to_pylist())
        words = known.filter(known["code"].is_valid())
        to = np.zeros(max(int(c.max()) for c in codes) + 1 if codes else 0, np.int32)   # a block's codes are dense
        to[words["code"].to_numpy()] = words["id"].to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, pa.array(to[np.concatenate(codes)] if codes else to))
        if numbered:
            firsts = known.filter(known["place"].is_valid()).sort_by("place")
            kept = pa.array(firsts["id"].to_numpy()[np.searchsorted(firsts["place"].to_numpy(), docs["place"].to_numpy())])
        else:
            kept = docs[carried]
        return pa.table([kept, ids], [carried, "ids"])

    some = documents.where("size > 0").select("block", "place", "codes", *([] if numbered else [carried]))
    return some.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        decoded, f"`{carried}` {kind.simpleString()}, ids array<int>")
