"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n ** 2`` (feed-forward
and attention). In windows of a partition, documents go in descending length to
the lowest-cost sequence with room. Tokens that fit nowhere whole are cut over
the fullest-free sequences, so every full-length sequence is filled; a
window's last tokens move on to the next window. At the end of a partition
the rest is cut at its binary digits: sequences of a power of two need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .tokens import ids_with_end

CAPACITY = 4096
WINDOW_TOKENS = 2_000_000    # tokens packed together: bounds a task's memory
LINEAR, QUADRATIC = 1.0, 1.0 / 4096   # a full sequence's attention costs as much as its linear part
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long, cost double")

# a piece: (document row, start in its document, length)
Piece = tuple[int, int, int]


def balance(pieces: list[Piece], n_sequences: int, capacity: int = CAPACITY,
            linear: float = LINEAR, quadratic: float = QUADRATIC
            ) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill ``n_sequences`` sequences; also what did not fit.

    Descending lengths (ties: as given), each to the sequence of lowest cost
    among those with room for the whole piece; the rest is cut into the
    largest free spaces.
    """
    free = np.full(n_sequences, capacity, dtype=np.int64)
    cost = np.zeros(n_sequences)
    out: list[list[Piece]] = [[] for _ in range(n_sequences)]

    def put(seq: int, piece: Piece) -> None:
        out[seq].append(piece)
        free[seq] -= piece[2]
        cost[seq] += linear * piece[2] + quadratic * piece[2] ** 2

    rest: list[Piece] = []
    for p in sorted(pieces, key=lambda p: -p[2]):
        room = np.flatnonzero(free >= p[2]) if n_sequences else ()
        if len(room):
            put(int(room[np.argmin(cost[room])]), p)
        else:
            rest.append(p)
    left: list[Piece] = []
    for doc, start, length in rest:
        while length:
            seq = int(np.argmax(free)) if n_sequences else -1
            take = min(length, int(free[seq])) if n_sequences else 0
            if not take:
                left.append((doc, start, length))
                break
            put(seq, (doc, start, take))
            start, length = start + take, length - take
    return out, left


def binary_tail(pieces: list[Piece]) -> list[list[Piece]]:
    """Cut what is left over into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out: list[list[Piece]] = []
    queue = sorted(pieces, key=lambda p: -p[2])[::-1]
    for size in sizes:
        seq: list[Piece] = []
        while size:
            doc, start, length = queue.pop()
            take = min(size, length)
            seq.append((doc, start, take))
            size -= take
            if take < length:
                queue.append((doc, start + take, length - take))
        out.append(seq)
    return out


class Packer:
    """Packs one partition's documents, window by window."""

    def __init__(self, partition: int, capacity: int, window: int):
        self.capacity, self.window = capacity, window
        self.next_id = partition << 40
        self.docs: dict[int, tuple[int | None, bytes]] = {}
        self.pieces: list[Piece] = []
        self.tokens = self.rows = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        self.docs[self.rows] = (doc_id, ids)
        n = len(ids) // 4
        self.pieces += [(self.rows, s, min(self.capacity, n - s))
                        for s in range(0, n, self.capacity)]
        self.rows += 1
        self.tokens += n
        if self.tokens >= self.window:
            yield self.flush(last=False)

    def flush(self, last: bool) -> list[tuple]:
        full, left = balance(self.pieces, self.tokens // self.capacity, self.capacity)
        out = [r for seq in full for r in self._rows(seq)]
        if last:
            out += [r for seq in binary_tail(left) for r in self._rows(seq)]
            left = []
        self.pieces, self.tokens = left, sum(p[2] for p in left)
        self.docs = {p[0]: self.docs[p[0]] for p in left}
        return out

    def _rows(self, seq: list[Piece]) -> Iterator[tuple]:
        offset, total = 0, sum(p[2] for p in seq)
        for doc, start, length in seq:
            doc_id, ids = self.docs[doc]
            yield (doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]),
                   len(ids) // 4, self.next_id, offset, total,
                   LINEAR * length + QUADRATIC * length ** 2)
            offset += length
        self.next_id += 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                   window: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text).

    Rows are tokenized and packed where they are read: nothing is shuffled and
    a task holds one window. Sequence ids are unique: partition number, then
    a running number; they rise, window by window, in the order of the frame's partitions and rows. A null or empty text is the end id alone; null or repeated doc_ids
    are packed row by row like any other; an empty table gives no rows; other columns
    are not read. Documents longer than ``capacity`` are cut at its multiples first.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), capacity, window)
        kinds = [pa.int64()] * 8 + [pa.float64()]

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = ids_with_end(tokenizer, part.column(1).to_pylist(), end_id)
                for doc_id, i in zip(part.column(0).to_pylist(), ids):
                    for rows in packer.add(doc_id, i):
                        yield frame(rows)
        yield frame(packer.flush(last=True))

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(pack, SCHEMA)


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, just read from Parquet files that Spark wrote, range-partitioned and sorted by where they
    stand: the number of the task that wrote the file, the file, the row in it. A plain scan deals files out by size."""
    part, file, row = (fresh(docs.columns, f"written_{x}") for x in ("part", "file", "row"))
    at = docs.metadataColumn("_metadata")
    placed = docs.select(
        "*", F.regexp_extract(at["file_name"], r"^part-([0-9]+)", 1).try_cast("long").alias(part),
        at["file_name"].alias(file), at["row_index"].alias(row))
    return placed.repartitionByRange(part, file, row).sortWithinPartitions(part, file, row).select(*docs.columns)
