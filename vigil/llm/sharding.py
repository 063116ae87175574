"""Proportional stratified interleaving into shards.

Rows of each source are put in a seeded order; a row's fractional rank is its
place in that order over the source's rows. Sorted by fractional rank, every
stretch holds the sources in the proportions of the whole table, so cutting
the order into equal counts gives shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rownumber import number_rows

SHARDS = 8
SEED = 20


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum, fraction) of every row.

    Counts of shards differ by at most one (law ``rows``); of each source, a shard's count is within
    two rows of its proportion. A null text counts as empty, a null source is a source of its own;
    repeated rows and null ids are placed like others; very long texts are rows like others; other columns are not read,
    whatever their names; an empty table gives no rows. A source may hold any
    share of the rows: both orders are range-partitioned, and only digests, not texts, are shuffled.
    """
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[stratum].cast("string").alias("stratum"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # equal rows are told apart by their place in the input
    rows = rows.withColumns({"draw": F.xxhash64(F.lit(seed), "doc_id", "text_crc32"),
                             "place": F.monotonically_increasing_id()})
    ranked = number_rows(rows, [F.col("draw"), F.asc_nulls_first("doc_id"), F.col("place")],
                         key=["stratum"], out="rank")
    counts = rows.groupBy(F.col("stratum").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    mixed = ranked.join(counts, F.col("stratum").eqNullSafe(F.col("s"))).withColumn(
        "fraction", (F.col("rank") + 0.5) / F.col("n")).drop("s", "n")
    placed = number_rows(mixed, [F.col("fraction"), F.asc_nulls_first("stratum"), F.col("rank")], out="position")
    n = docs.select(F.count(F.lit(1))).scalar()
    # exact integer division; the first position of shard s is ceil(s * n / shards)
    placed = placed.withColumn("rows", n).withColumn("shard", F.expr(f"(position * {shards}) div rows"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"position - (shard * rows + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "stratum", "fraction")
