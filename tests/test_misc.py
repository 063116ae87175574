"""Small helpers: labels, registry, vector lookup, standardization, ordinals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators.rownumber import number_rows
from vigil.plans import channel, learn, text


def test_chart_label():
    assert channel.chart_label("pct_site_orders") == "Pct Site Orders"


def test_registry_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "client string")
    assert [r.short_name for r in channel.client_registry(df).collect()] == ["a", "b"]


def test_embedding_lookup(spark):
    d = spark.createDataFrame([(0, "x y x z")], "doc_id bigint, text string")
    toks = text.clean_tokens(d)
    vocab = text.build_vocabulary(toks, 3)
    vec = spark.createDataFrame([("x", [1.0]), ("y", [2.0]), ("z", [3.0])],
                                "word string, vector array<double>")
    got = {r.pos: r.vector for r in text.embedding_lookup(text.encode(toks, vocab), vec, vocab)
           .collect()}
    assert got == {0: [1.0], 1: [2.0], 2: [1.0], 3: None}


def test_standardize(spark):
    df = spark.createDataFrame([([1.0, 10.0],), ([3.0, 30.0],)], "features array<double>")
    out = np.array([r.features for r in learn.standardize(df).collect()])
    assert out.mean(axis=0) == pytest.approx([0, 0])
    assert out.std(axis=0, ddof=1) == pytest.approx([1, 1])


def test_number_rows_per_key_with_null_keys_and_one_shared_value(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id") * 10**12 + 7,
        F.when(F.col("id") % 5 > 0, F.lit(1.0)).alias("v")).toDF("k", "id", "v")
    got = number_rows(df, [F.asc_nulls_first("v"), F.asc("id")], key=["k"])
    assert got.columns == ["k", "id", "v", "offset"]
    pdf = got.toPandas().sort_values(["v", "id"], na_position="first")
    assert len(pdf) == 3000
    for _, g in pdf.groupby("k", dropna=False):
        assert list(g.offset) == list(range(len(g)))


def test_number_rows_sums_sizes_over_sparse_ids(spark):
    df = spark.range(0, 2000).select(F.xxhash64("id").alias("id"), (F.col("id") % 3 + 1).alias("w"))
    got = number_rows(df, [F.asc("id")], size="w")
    pdf = got.toPandas().sort_values("id")
    assert list(pdf.offset) == list(pdf.w.cumsum() - pdf.w)
    assert number_rows(df.limit(0), [F.asc("id")]).count() == 0

def test_island_id_counts_flag_changes(spark):
    from vigil.operators.windows import island_id, ordered, run_length
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("c", i + 1, f) for i, f in enumerate(flags)],
                               "k string, rn int, f int")
    w = ordered(["k"], ["rn"])
    got = df.select("rn", island_id("f", w).alias("isl"), run_length("f", "rn", w).alias("run")) \
        .orderBy("rn").collect()
    assert [r.isl for r in got] == [1, 1, 2, 3, 3, 3, 4, 4, 5]
    assert [r.run for r in got] == [1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_run_length_never_exceeds_rows_seen(spark):
    import random
    from vigil.operators.windows import ordered, run_length
    rng = random.Random(9)
    rows = [(k, i + 1, rng.choice([0, 1, 1])) for k in ("a", "b", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, rn int, f int")
    got = df.select("k", "rn", "f", run_length("f", "rn", ordered(["k"], ["rn"])).alias("run"))
    for k in ("a", "b", "c"):
        seq = sorted((r.rn, r.f, r.run) for r in got.where(F.col("k") == k).collect())
        expect = 0
        for rn, f, run in seq:
            expect = expect + 1 if f else 0
            assert run == expect and 0 <= run <= rn
