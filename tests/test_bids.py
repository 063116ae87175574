"""Bid changes: top products, what-if counts, tiers."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.plans import bids

DAY = dt.date(2024, 3, 1)


def bid_frame(spark, rows):
    return spark.createDataFrame(
        [(c, DAY, p, v) for c, p, v in rows],
        "client string, date date, product_id string, prediction double")


def config(spark):
    return spark.createDataFrame([("acme", 1, 0.5), ("zen", 2, 0.3)],
                                 "short_name string, site_id bigint, "
                                 "percent_prediction_threshold double")


def test_list_clients_hides_short_names(spark):
    df = bid_frame(spark, [("acme", "1", 1.0), ("zen", "2", 1.0), ("abcd", "3", 2.0)])
    assert [r.client for r in bids.list_clients(df).collect()] == ["abcd", "acme"]


def test_top_products_dedupes_and_decodes(spark):
    import base64
    df = bid_frame(spark, [("acme", p, v) for p, v in
                           [("a", 9.0), ("a", 8.0), ("b", 7.0), ("c", 6.0), ("d", 5.0),
                            ("e", 4.0), ("f", 1.0), ("g", None)]])
    good = base64.b64encode(b'{"price": "1.50", "cost": "1.00", "title": "T", '
                            b'"image_url": "u"}').decode()
    bad = base64.b64encode(b"{oops").decode()
    cat = spark.createDataFrame(
        [(1, p, "br", "cat", bad if p == "b" else good) for p in "abcdefg"],
        "site_id bigint, product_id string, brand string, category string, catalog_json string")
    got = bids.daily_top_products(df, config(spark), cat, "acme", DAY).collect()
    assert [(r.product_id, r.rank) for r in got] == [("a", 1), ("b", 3), ("c", 4), ("d", 5)]
    assert got[0].price == "1.50" and got[1].price is None
    assert bids.pick_product(bids.top_products(df), 0).collect()[0].product_id == "a"


def brute_increases(preds, threshold):
    s = pd.Series(preds, dtype=float)
    rank = s.rank(method="first", ascending=False)
    pct = rank / len(s)
    return int((pct < threshold).sum())


@pytest.mark.parametrize("seed", range(4))
def test_what_if_matches_pandas_rank(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    preds = [None if rng.random() < .2 else float(rng.randint(0, 5)) for _ in range(n)]
    df = bid_frame(spark, [("acme", str(i), p) for i, p in enumerate(preds)])
    got = {round(r.threshold, 9): r.increases
           for r in bids.threshold_what_if(df, config(spark), "acme", DAY).collect()}
    for f in bids.THRESHOLD_GRID:
        t = f * 0.5
        assert got[round(t, 9)] == brute_increases(preds, t), (t, preds)


def test_rank_percentile_ties_and_nulls(spark):
    df = bid_frame(spark, [("acme", "b", 1.0), ("acme", "a", 1.0), ("acme", "c", None)])
    got = {r.product_id: (r.predicted_cm_rank, r.predicted_cm_percentile)
           for r in bids.rank_percentile(df).collect()}
    assert got == {"a": (1, 1 / 3), "b": (2, 2 / 3), "c": (None, None)}


def test_tiers(spark):
    df = spark.createDataFrame([(5.0,), (5.5,), (6.0,), (100.0,), (0.0,), (1.0,), (0.5,)],
                               "p double")
    got = [r.t for r in df.select(bids.tier("p").alias("t")).collect()]
    assert got == ["tier_1", None, "tier_2", "tier_20", None, "tier_1", None]


def test_tier_summary(spark):
    rows = [(1, DAY, "m", p, 1.0, 2.0, p / 100, p / 50) for p in (1.0, 3.0, 5.5, 7.0)]
    perf = spark.createDataFrame(rows, "site_id bigint, prediction_date date, model_id string, "
                                       "percentile double, cost double, revenue double, "
                                       "cum_percent_cost double, cum_percent_revenue double")
    got = {r.tier: (r.cost, r.cum_percent_revenue)
           for r in bids.tier_summary(perf, "2024-02-16").collect()}
    assert got == {"tier_1": (2.0, 0.06), "tier_2": (1.0, 0.14)}
    assert bids.tier_summary(perf, "2024-03-02").count() == 0


def test_rank_percentile_equals_a_full_sort(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = []
    for c in ("acme", "zen"):
        for i in range(700 if c == "acme" else 40):
            v = None if rng.random() < .05 else float(rng.integers(0, 60))
            rows.append((c, f"p{i:04d}", v))
    df = bid_frame(spark, rows)
    got = {(r.client, r.product_id): (r.predicted_cm_rank, r.predicted_cm_percentile)
           for r in bids.rank_percentile(df).collect()}
    pdf = pd.DataFrame(rows, columns=["client", "product_id", "prediction"])
    for c, g in pdf.groupby("client"):
        g = g.sort_values("product_id")
        r = g["prediction"].rank(method="first", ascending=False)
        # pandas breaks ties by position; rows are in product id order
        for pid, rank in zip(g.product_id, r):
            exp = None if np.isnan(rank) else int(rank)
            assert got[(c, pid)][0] == exp
            if exp is not None:
                assert got[(c, pid)][1] == pytest.approx(exp / len(g))


def test_rank_percentile_keeps_null_keys(spark):
    df = bid_frame(spark, [("acme", "a", 1.0), ("acme", "b", 2.0)]).unionByName(
        bid_frame(spark, [("acme", "c", 3.0)]).withColumn("client", F.lit(None).cast("string")))
    got = {(r.client, r.product_id): r.predicted_cm_rank for r in bids.rank_percentile(df).collect()}
    assert got == {("acme", "b"): 1, ("acme", "a"): 2, (None, "c"): 1}


def test_pick_counts_displayed_products(spark):
    shown = spark.createDataFrame([("acme", DAY, 1, "a"), ("acme", DAY, 3, "b"), ("acme", DAY, 5, "c"),
                                   ("zen", DAY, 2, "d")], "client string, date date, rank int, product_id string")
    assert [r.product_id for r in bids.pick_product(shown, 2).collect()] == ["c"]


def test_tiers_partition_integer_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("p"))
    got = {int(r.p): r.t for r in df.select("p", bids.tier("p").alias("t")).collect()}
    assert all(got[p] == f"tier_{(p + 4) // 5}" for p in range(1, 101))
    assert sorted({t for t in got.values()}, key=lambda t: int(t[5:])) == \
        [f"tier_{i}" for i in range(1, 21)]
