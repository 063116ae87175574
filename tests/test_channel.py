"""Channel health: crafted series (FIXTURES 3) and a pandas brute force."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.plans import channel

METRICS = channel.HEALTH_METRICS
D0 = dt.date(2024, 1, 1)


def frame(spark, series: dict, client="c", n=None, shuffle=False):
    n = n or len(next(iter(series.values())))
    rows = []
    for i in range(n):
        r = {"client": client, "Date": D0 + dt.timedelta(days=i)}
        for m in METRICS:
            r[m] = float(series[m][i]) if m in series else 1.0
        rows.append(r)
    if shuffle:
        random.Random(3).shuffle(rows)
    schema = "client string, Date date, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame(pd.DataFrame(rows)[["client", "Date", *METRICS]], schema)


def checks(spark, series, **kw):
    df = channel.health_checks(frame(spark, series, **{k: v for k, v in kw.items()
                                                      if k in ("shuffle",)}))
    return {(r.metric, r.check): r.code for r in df.collect()}


def alt(n, a=100, b=101):
    return [a if i % 2 == 0 else b for i in range(n)]


# ---------------------------------------------------------------- brute force

def py_round(x):
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def brute(values, metric, n=10, one=.6, two=.4):
    """The source's per-metric checks, re-stated with pandas."""
    s = pd.Series(values, dtype=float)
    out = {}
    mean, sd = s.mean(), s.std()
    def runs(flag):
        grp = (flag != flag.shift()).cumsum()
        return flag.groupby(grp).cumsum()
    above = runs(pd.Series(np.where(s - mean > 0, 1, 0)))
    below = runs(pd.Series(np.where(s - mean < 0, 1, 0)))
    delta = s - s.shift()
    neg = runs(pd.Series(np.where(delta < 0, 1, 0)))
    pos = runs(pd.Series(np.where(delta > 0, 1, 0)))
    cut = slice(len(s) - n, len(s))
    tail = s.iloc[cut]
    if metric == "revenue" and (tail.tail(7) == 0).sum() > py_round(.5 * n):
        out["tracking_alert"] = "01_revenue_pixel_alert"
    g = {k: (tail > mean + k * sd).sum() for k in (1, 2, 3)}
    l = {k: (tail < mean - k * sd).sum() for k in (1, 2, 3)}
    if g[3] > 0 or l[3] > 0:
        out["deviation"] = "02_high_alert"
    elif g[2] >= py_round(two * n) or l[2] >= py_round(two * n):
        out["deviation"] = "03_medium_alert"
    elif g[1] >= py_round(one * n) or l[1] >= py_round(one * n):
        out["deviation"] = "08_low_alert"
    else:
        out["deviation"] = "09_no_alert"
    mb, ma = below.iloc[cut].max(), above.iloc[cut].max()
    mn, mp = neg.iloc[cut].max(), pos.iloc[cut].max()
    out["below_mean_trend"] = "04_below_mean_alert" if mb >= n - 1 else "09_no_alert"
    out["above_mean_trend"] = "06_above_mean_alert" if ma >= n - 1 else "09_no_alert"
    out["negative_slope_trend"] = ("05_negative_slope_alert" if mn >= n - 1 and mp < n - 1
                                   else "09_no_alert")
    out["positive_slope_trend"] = ("07_positive_slope_alert" if mp >= n - 1 and mn < n - 1
                                   else "09_no_alert")
    return out


# ---------------------------------------------------------------- crafted cases

def test_tracking_alert_needs_six_zero_days_of_seven(spark):
    rev = [100.0] * 40
    for i in range(34, 40):
        rev[i] = 0.0
    assert checks(spark, {"revenue": rev})[("revenue", "tracking_alert")] == "01_revenue_pixel_alert"
    rev[34] = 100.0
    assert ("revenue", "tracking_alert") not in checks(spark, {"revenue": rev})


def test_high_alert(spark):
    v = alt(40)
    v[-1] += 50
    assert checks(spark, {"cost": v})[("cost", "deviation")] == "02_high_alert"


def test_medium_and_no_alert_depend_on_sides(spark):
    v = alt(30)
    for i in range(26, 30):
        v[i] += 50
    assert checks(spark, {"cost": v})[("cost", "deviation")] == "03_medium_alert"
    w = alt(30)
    w[26] -= 50
    w[27] -= 50
    w[28] += 50
    w[29] += 50
    assert checks(spark, {"cost": w})[("cost", "deviation")] == "09_no_alert"


def test_low_alert(spark):
    v = alt(20)
    for i in range(14, 20):
        v[i] += 50
    assert checks(spark, {"cost": v})[("cost", "deviation")] == "08_low_alert"


def test_mean_runs(spark):
    v = alt(30) + [90.0] * 9
    assert checks(spark, {"orders": v})[("orders", "below_mean_trend")] == "04_below_mean_alert"
    v = alt(30) + [90.0] * 8
    assert checks(spark, {"orders": v})[("orders", "below_mean_trend")] == "09_no_alert"
    v = alt(30) + [120.0] * 9
    assert checks(spark, {"orders": v})[("orders", "above_mean_trend")] == "06_above_mean_alert"


def test_run_started_before_cut_counts(spark):
    # a run of 9 below the mean that ends on the first of the last 10 rows
    v = alt(30) + [90.0] * 9 + [150.0] * 9
    got = checks(spark, {"clicks": v})
    assert got[("clicks", "below_mean_trend")] == "04_below_mean_alert"


def test_equal_to_mean_breaks_run(spark):
    v = [10.0, 30.0] * 10 + [10.0] * 4 + [20.0] + [10.0] * 4 + [30.0] * 9
    mean = sum(v) / len(v)
    assert brute(v, "clicks")["below_mean_trend"] == checks(spark, {"clicks": v})[
        ("clicks", "below_mean_trend")]
    assert mean != 20.0 or True


def test_slopes(spark):
    v = alt(30) + [100.0 - 5 * i for i in range(1, 10)]
    assert checks(spark, {"impressions": v})[("impressions", "negative_slope_trend")] == \
        "05_negative_slope_alert"
    v = alt(30) + [100.0 + 5 * i for i in range(1, 10)]
    assert checks(spark, {"impressions": v})[("impressions", "positive_slope_trend")] == \
        "07_positive_slope_alert"


def test_slope_volatility_gives_neither(spark):
    # 9 falling steps ending on the first of the last 10 rows, then 9 rising steps
    v = alt(30) + [200.0 - 10 * i for i in range(0, 10)] + [120.0 + 10 * i for i in range(9)]
    df = frame(spark, {"impressions": v})
    wide = channel.health_wide(df).collect()[0]
    assert wide["impressions__negative_slope_trend"] == "09_no_alert"
    assert wide["impressions__positive_slope_trend"] == "09_no_alert"
    assert wide["impressions__slope_volatile"] is True


def test_quiet_series_has_no_alert(spark):
    got = checks(spark, {"revenue": [100.0] * 30})
    assert set(got.values()) == {"09_no_alert"}


def test_shuffled_input_same_result(spark):
    rng = random.Random(5)
    series = {m: [rng.uniform(50, 150) for _ in range(35)] for m in METRICS}
    assert checks(spark, series) == checks(spark, series, shuffle=True)


def test_inf_roas_gives_no_deviation_but_below_mean(spark):
    roas = [2.0] * 20 + [float("inf")] + [2.0] * 9
    got = checks(spark, {"roas": roas})
    assert got[("roas", "deviation")] == "09_no_alert"
    assert got[("roas", "below_mean_trend")] == "04_below_mean_alert"


@pytest.mark.parametrize("seed", range(6))
def test_random_series_match_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(12, 45)
    series = {}
    for m in METRICS:
        base = rng.uniform(10, 100)
        v = [round(base + rng.gauss(0, 10), 1) for _ in range(n)]
        if rng.random() < .5:  # a trend at the end
            k = rng.randint(5, 11)
            step = rng.choice([-1, 1]) * rng.uniform(1, 5)
            v[-k:] = [v[-k] + step * i for i in range(k)]
        if m == "revenue" and rng.random() < .5:
            for i in range(n - 7, n):
                if rng.random() < .9:
                    v[i] = 0.0
        series[m] = v
    got = checks(spark, series)
    for m in METRICS:
        exp = brute(series[m], m)
        for ch in channel.CHECKS:
            assert got.get((m, ch)) == exp.get(ch), (m, ch, series[m])


def test_top_alert_is_smallest_code(spark):
    v = alt(40)
    v[-1] += 50
    checks_df = channel.health_checks(frame(spark, {"cost": v}))
    top = {r.metric: r.code for r in channel.top_alerts(checks_df).collect()}
    assert top["cost"] == "02_high_alert"
    matrix = channel.alert_matrix(channel.top_alerts(checks_df)).collect()[0]
    wide = channel.alert_matrix_from_wide(channel.health_wide(frame(spark, {"cost": v}))).collect()[0]
    assert matrix.asDict() == wide.asDict()


# ---------------------------------------------------------------- daily frame (M1)

def facts(spark, days):
    """days: list of (day_index, revenue, orders, conversions, clicks, impressions, cost,
    site_orders, site_revenue)."""
    ad = spark.createDataFrame(
        [("c", 20240100 + d, rev, o, cv, cl, im, co) for d, rev, o, cv, cl, im, co, _, _ in days],
        "client string, d_date_id int, adwords_revenue double, adwords_orders bigint, "
        "adwords_conversions bigint, adwords_clicks bigint, adwords_impressions bigint, "
        "adwords_cost double")
    site = spark.createDataFrame(
        [("c", 20240100 + d, so, sr) for d, *_, so, sr in days],
        "client string, d_date_id int, orders bigint, revenue double")
    dd = spark.createDataFrame(
        [(20240100 + d, dt.date(2024, 1, d)) for d in range(1, 32)], "id int, full_date date")
    return ad, site, dd


def test_daily_ratios_and_drops(spark):
    days = [(d, 100.0, 10, None, 50, 1000, 20.0, 20, 200.0) for d in range(1, 11)]
    days[7] = (8, 0.0, 0, None, 0, 1000, 0.0, 20, 200.0)      # revenue 0 and cost 0
    days[8] = (9, 50.0, 5, None, 0, 1000, 0.0, 20, 200.0)     # clicks 0, orders > 0
    ad, site, dd = facts(spark, days)
    out = {r.Date.day: r for r in channel.channel_daily(ad, site, dd, "2024-01-31", 60).collect()}
    assert sorted(out) == [7, 9, 10]            # warm-up rows and the 0/0 day are dropped
    assert out[9].cr == float("inf") and out[9].cpc == 0.0 and out[9].roas == float("inf")
    assert out[7].orders_7_avg == pytest.approx(10.0)
    assert out[10].aov_7_avg == pytest.approx((100 * 5 + 0 + 50) / (10 * 5 + 0 + 5))


def test_orders_fall_back_to_conversions_then_zero(spark):
    days = [(d, 10.0, None, 3, 5, 50, 1.0, 9, 99.0) for d in range(1, 8)]
    days[6] = (7, 10.0, None, None, 5, 50, 1.0, 9, 99.0)
    ad, site, dd = facts(spark, days)
    r = channel.channel_daily(ad, site, dd, "2024-01-31", 60).collect()[0]
    assert r.orders == 0 and r.orders_7_avg == pytest.approx(18 / 7)


def test_fewer_than_seven_days_is_empty(spark):
    ad, site, dd = facts(spark, [(d, 1.0, 1, 1, 1, 1, 1.0, 1, 1.0) for d in range(1, 7)])
    assert channel.channel_daily(ad, site, dd, "2024-01-31", 60).count() == 0


def test_rolling_counts_rows_not_days(spark):
    days = [(d, float(d), 1, 1, 1, 1, 1.0, 1, 1.0) for d in (1, 2, 3, 10, 11, 12, 20)]
    ad, site, dd = facts(spark, days)
    r = channel.channel_daily(ad, site, dd, "2024-01-31", 60).collect()
    assert len(r) == 1 and r[0].revenue_7_avg == pytest.approx(sum([1, 2, 3, 10, 11, 12, 20]) / 7)


def test_lookback_filter_is_pushed_to_the_scan(spark, tmp_dir):
    ad, site, dd = facts(spark, [(d, 1.0, 1, 1, 1, 1, 1.0, 1, 1.0) for d in range(1, 20)])
    ad.write.parquet(f"{tmp_dir}/ad")
    ad2 = spark.read.parquet(f"{tmp_dir}/ad")
    plan = channel.channel_daily(ad2, site, dd, "2024-01-31", 10)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d_date_id), GreaterThanOrEqual(d_date_id," in plan


def test_control_chart_rounds_then_takes_limits(spark):
    df = frame(spark, {"revenue": [1.4, 2.6, 3.5, 4.5]}).withColumn(
        "revenue_7_avg", F.col("revenue"))
    rows = channel.control_chart(df, "revenue").orderBy("Date").collect()
    assert [r.value for r in rows] == [1.0, 3.0, 4.0, 4.0]   # half to even
    assert rows[0].mean == 3.0
    sd = float(np.std([1, 3, 4, 4], ddof=1))
    assert rows[0].plus_one_sd == 3.0 + round(sd)


def test_chart_columns_substring_rule():
    cols = ["client", "Date", "orders", "orders_7_avg", "site_orders", "pct_site_orders", "aov"]
    from types import SimpleNamespace
    site, ch = channel.chart_columns(SimpleNamespace(columns=cols), "orders")
    assert site == ["Date", "pct_site_orders", "site_orders"]
    assert ch == ["Date", "orders", "orders_7_avg"]


def test_lookback_validator():
    assert channel.check_lookback(14) == 14
    with pytest.raises(ValueError):
        channel.check_lookback(13)


def test_selected_clients_equal_the_full_run_restricted(spark):
    from vigil.plans import catalog
    from vigil.sources import testdata as td
    from .conftest import SF_SMALL
    ad, site, dd = catalog.events_sources(spark, SF_SMALL)
    full = {r.client: r for r in
            channel.channel_health(ad, site, dd, td.EVENTS_AS_OF, 60).collect()}
    picked = ["client_1", "client_3"]
    by_list = channel.channel_health(ad, site, dd, td.EVENTS_AS_OF, 60, clients=picked)
    registry = spark.createDataFrame([(c,) for c in picked], "short_name string")
    by_frame = channel.channel_health(ad, site, dd, td.EVENTS_AS_OF, 60, clients=registry)
    for got in (by_list, by_frame):
        rows = {r.client: r for r in got.collect()}
        assert sorted(rows) == picked
        assert all(rows[c] == full[c] for c in picked)
    p = by_frame._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in p and "BroadcastExchange" in p


def test_daily_frame_does_not_depend_on_partitioning(spark):
    from vigil.sources import testdata as td
    from .conftest import SF_MID
    ev = td.table(spark, SF_MID, "events")

    def daily(events):
        return {(r.client, r.Date): tuple(r) for r in channel.channel_daily(
            td.ad_facts(events), td.site_facts(events), td.d_date(events, "ts"),
            td.EVENTS_AS_OF, 60).collect()}

    one = daily(ev.repartition(1))
    many = daily(ev.repartition(7, F.rand(3)))
    assert one == many      # exact: money is summed as decimals


# ---------------------------------------------------------------- rule-made series

def test_every_alert_code_fires_in_a_registered_query(spark):
    from vigil.plans import catalog
    from .conftest import SF_SMALL
    rows = {r["client"]: r for r in catalog.QUERIES["alert_rules"](spark, SF_SMALL).collect()}
    expected = {0: ("tracking_alert", "pixel"), 1: ("deviation", "high"), 2: ("deviation", "medium"),
                3: ("deviation", "low"), 4: ("below_mean_trend", "below"), 5: ("above_mean_trend", "above"),
                6: ("negative_slope_trend", "negative"), 7: ("positive_slope_trend", "positive")}
    for g, (check, code) in expected.items():
        assert rows[f"rule_{g}"][check] == channel.CODES[code], rows[f"rule_{g}"]
    quiet = rows["rule_9"]
    assert {quiet[c] for c in channel.CHECKS} == {None, channel.CODES["none"]}
    assert [g for g in range(10) if rows[f"rule_{g}"]["slope_volatile"]] == [8]


def test_form_lookback_checks_and_adds_a_week():
    assert channel.form_lookback(14) == 21
    with pytest.raises(ValueError):
        channel.form_lookback(13)


def test_all_charts_equal_single_charts(spark):
    n = 9
    cols = {m: [float(i * i % 7 + 1) for i in range(n)] for m in channel.DAILY_COLUMNS[2:]}
    pdf = pd.DataFrame({"client": ["a"] * n, "Date": [D0 + dt.timedelta(days=i) for i in range(n)], **cols})
    daily = spark.createDataFrame(pdf)
    got = channel.control_charts(daily)
    for m in ("revenue", "pct_site_orders"):
        one = channel.control_chart(daily, m)
        assert sorted(map(tuple, got.where(F.col("metric") == m).select(*one.columns).collect())) == sorted(
            map(tuple, one.collect()))
