"""Token ids in ORC files: integer run-length encoding, row index, Bloom filters.

Documents are range-partitioned by id, tokenized in their partition and written in
ascending id order, one file per range. ORC stores the ids' integer columns
run-length encoded, keeps minima and maxima per stripe and row group, and a
Bloom filter on ``doc_id``: a reader splits files at stripes, and a look-up of ids skips
stripes and row groups by this metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialize import scratch_path
from .tokens import ids_with_end

STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000        # rows of a row group, the unit that an index entry skips
ORC_OPTIONS = {
    "orc.compress": "ZSTD", "orc.stripe.size": str(STRIPE_BYTES),
    "orc.row.index.stride": str(INDEX_ROWS), "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
ROWS_SCHEMA = "doc_id long, part long, row long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write (doc_id, part, row, n_tokens, ids) of every row of ``docs`` to ``path``.

    ``part`` grows with doc_id and ``row`` within a part, so (part, row) is the order of
    the ids in the whole corpus: null ids first, then ascending, ties by place in the input, which also
    spreads a frequent id over ranges. A null text counts as empty; a very long one is a row like others. The text is
    shuffled once.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("place")]
    ranged = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
              .withColumn("place", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("at", F.monotonically_increasing_id())
              .select("doc_id", "text", F.shiftright("at", 33).alias("part"),
                      F.col("at").bitwiseAND((1 << 33) - 1).alias("row")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = ids_with_end(tokenizer, part.column(1).to_pylist(), end_id)
                n = np.array([len(i) // 4 for i in ids], "int64")
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32")), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(n), lists],
                    ["doc_id", "part", "row", "n_tokens", "ids"])

    ranged.mapInArrow(encode, ROWS_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids``, only theirs: the filter reaches the files' stripe
    statistics, row index and Bloom filters."""
    rows = spark.read.schema(ROWS_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def stream_offsets(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the written rows: ``start`` sums
    inside a part, and over one total per part."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            # the checksum and the length come from the ids read back
            values = memoryview(lists.values.to_numpy().astype("<i4", copy=False))
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype("int64")), pa.array(crc, pa.int64())],
                ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    seen = rows.select("doc_id", "part", "row", "ids").mapInArrow(
        digest, "doc_id long, part long, row long, n_tokens long, ids_crc32 long")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    # one total per range partition: a bounded side
    return (seen.join(F.broadcast(totals), "part")
            .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(local), F.lit(0)))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2,
                path: str | None = None) -> DataFrame:
    """Write ``docs`` as ORC (to a new folder under the shared checkpoint folder if ``path`` is
    None), read the files back and return one row per document row. An empty table
    gives empty files and no rows; only doc_id and text are read."""
    path = path or scratch_path(spark, "token-orc")
    write_tokens(docs, path, tokenizer, end_id)
    return stream_offsets(read_tokens(spark, path))
