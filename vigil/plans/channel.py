"""Channel health: daily frame, run/limit checks, alert roll-up, charts.

Plan shape of the flagship (``channel_health``):

  ad facts --partial agg by (client, day id)--+-- join on (client, day id),
  site facts --agg by (client, day id)--------+   no new exchange --> join
  d_date (broadcast, one row per calendar day) --> one exchange on
  client: rolling frames, mean/sd, run lengths, last-N cut all share the
  ordered partition --> aggregate per client (same partitioning, no new
  exchange) --> codes.

The raw fact scan is the only large input; it is reduced by map-side
partial aggregation before any shuffle, so a client holding a third of
all rows costs one partial aggregate per input split, not one hot task.
After that, a client has at most ``lookback`` rows.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import half_even, nan_to_null, ratio, ratio_or_zero
from ..operators.windows import ordered, rolling_mean, rolling_sum, run_length, whole
from ..sources.testdata import date_id

# Fixed values of the source application.
HEALTH_METRICS = ["revenue", "cost", "orders", "clicks", "impressions", "roas"]
CHART_METRICS_SITE = ["pct_site_orders", "pct_site_revenue"]
CHART_METRICS = ["revenue", "cost", "clicks", "orders", "impressions", "aov", "cr", "ctr", "cos_m",
                 "cpc", "pct_site_revenue", "pct_site_orders"]
LOOKBACK_DAYS = 60
LAST_N = 10
ONE_DEV_SHARE = 0.6
TWO_DEV_SHARE = 0.4
PIXEL_DAYS = 7
PIXEL_SHARE = 0.5
MIN_CHART_LOOKBACK = 14
FORM_EXTRA_DAYS = 7

BASE = ["orders", "revenue", "clicks", "impressions", "cost"]
DAILY_COLUMNS = (
    ["client", "Date", "revenue", "orders", "clicks", "impressions", "cost",
     "site_orders", "site_revenue", "pct_site_orders", "pct_site_revenue",
     "aov", "cr", "ctr", "cpc"]
    + [f"{c}_7_avg" for c in BASE]
    + ["aov_7_avg", "cr_7_avg", "ctr_7_avg", "cpc_7_avg",
       "cos_m", "cos_m_7_avg", "roas", "roas_7_avg"]
)

# Alert codes sort by severity: the smallest code of a metric is its alert.
CODES = {
    "pixel": "01_revenue_pixel_alert",
    "high": "02_high_alert",
    "medium": "03_medium_alert",
    "below": "04_below_mean_alert",
    "negative": "05_negative_slope_alert",
    "above": "06_above_mean_alert",
    "positive": "07_positive_slope_alert",
    "low": "08_low_alert",
    "none": "09_no_alert",
}
CHECKS = ["tracking_alert", "deviation", "below_mean_trend", "above_mean_trend",
          "negative_slope_trend", "positive_slope_trend"]


def py_round(x: float) -> int:
    """Round half away from zero (the source's interpreter rule)."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def _as_date(as_of) -> F.Column:
    return F.lit(as_of if isinstance(as_of, date) else date.fromisoformat(str(as_of)))


# --------------------------------------------------------------- M1

def select_clients(facts: DataFrame, clients) -> DataFrame:
    """The facts of the selected clients only (all when ``None``).

    A list of names becomes an ``IN`` filter below the aggregation (pushed
    to the scan where ``client`` is a stored column); a registry frame
    (``short_name`` or ``client`` column) is a semi join, which the planner
    broadcasts under its measured-size threshold. Either way one job covers every selected client.
    """
    if clients is None:
        return facts
    if isinstance(clients, DataFrame):
        name = "short_name" if "short_name" in clients.columns else "client"
        reg = clients.select(F.col(name).alias("client")).distinct()
        return facts.join(reg, "client", "left_semi")
    return facts.where(F.col("client").isin(list(clients)))


def channel_daily(ad: DataFrame, site: DataFrame, d_date: DataFrame,
                  as_of, lookback: int = LOOKBACK_DAYS, clients=None) -> DataFrame:
    """Daily channel frame per client: sums, ratios, 7-row trailing metrics.

    ``ad``: f_product_adgroup_performance (client, d_date_id, adwords_*),
    ``site``: f_site_performance (client, d_date_id, orders, revenue), one
    row per client and day; ``d_date``: (id, full_date). Only days in
    ``[as_of - lookback, as_of]`` are read; the bound is also applied to
    the yyyyMMdd key so it reaches the fact scans as a pushed filter.
    """
    start = F.date_sub(_as_date(as_of), lookback)
    end = _as_date(as_of)
    lo, hi = date_id(start), date_id(end)
    # one row per calendar day: a proven, tiny bound, so broadcast is safe
    dd = F.broadcast(
        d_date.where((F.col("full_date") >= start) & (F.col("full_date") <= end))
        .select(F.col("id").alias("d_date_id"), F.col("full_date").alias("Date")))

    ad, site = select_clients(ad, clients), select_clients(site, clients)
    acct = (
        ad.where((F.col("d_date_id") >= lo) & (F.col("d_date_id") <= hi))
        .groupBy("client", "d_date_id")
        .agg(
            F.sum("adwords_revenue").cast("double").alias("revenue"),
            F.sum(F.coalesce("adwords_orders", "adwords_conversions", F.lit(0))).alias("orders"),
            F.sum("adwords_clicks").alias("clicks"),
            F.sum("adwords_impressions").alias("impressions"),
            F.sum("adwords_cost").cast("double").alias("cost"),
        )
    )
    # the site query selects non-aggregated columns under GROUP BY date;
    # the contract is one site row per client and day, so max() is exact
    st = (
        site.where((F.col("d_date_id") >= lo) & (F.col("d_date_id") <= hi))
        .groupBy("client", "d_date_id")
        .agg(F.max("orders").alias("site_orders"),
             F.max("revenue").cast("double").alias("site_revenue"))
    )
    # both sides are already hash-partitioned by (client, d_date_id) by their
    # aggregations, so this join adds no exchange; the day comes last
    jd = acct.join(st, ["client", "d_date_id"], "inner").join(dd, "d_date_id").drop("d_date_id")

    # daily ratios are taken before the zero fill, so 0/0 becomes 0, inf stays
    jd = jd.select(
        "client", "Date",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
          ["revenue", "orders", "clicks", "impressions", "cost", "site_orders", "site_revenue"]],
        ratio_or_zero("orders", "site_orders").alias("pct_site_orders"),
        ratio_or_zero("revenue", "site_revenue").alias("pct_site_revenue"),
        ratio_or_zero("revenue", "orders").alias("aov"),
        ratio_or_zero("orders", "clicks").alias("cr"),
        ratio_or_zero("clicks", "impressions").alias("ctr"),
        ratio_or_zero("cost", "clicks").alias("cpc"),
    )
    w = ordered(["client"], ["Date"])
    rolled = jd.select(
        "*",
        *[rolling_mean(c, w, 7).alias(f"{c}_7_avg") for c in BASE],
        *[rolling_sum(c, w, 7).alias(f"sum_{c}") for c in BASE],
    )
    out = rolled.select(
        "*",
        ratio("sum_revenue", "sum_orders").alias("aov_7_avg"),
        ratio("sum_orders", "sum_clicks").alias("cr_7_avg"),
        ratio("sum_clicks", "sum_impressions").alias("ctr_7_avg"),
        ratio("sum_cost", "sum_clicks").alias("cpc_7_avg"),
        ratio("cost", "revenue").alias("cos_m"),
        ratio("sum_cost", "sum_revenue").alias("cos_m_7_avg"),
        ratio("revenue", "cost").alias("roas"),
        ratio("sum_revenue", "sum_cost").alias("roas_7_avg"),
    )
    # rows still holding a NULL are the six warm-up rows and 0/0 days
    return out.select(*DAILY_COLUMNS).dropna(how="any")


# --------------------------------------------------------------- M2-M5

def health_wide(daily: DataFrame, metrics: list[str] = HEALTH_METRICS,
                n: int = LAST_N, one_dev: float = ONE_DEV_SHARE,
                two_dev: float = TWO_DEV_SHARE, pixel_days: int = PIXEL_DAYS,
                pixel_share: float = PIXEL_SHARE) -> DataFrame:
    """One row per client: a code column per (metric, check).

    Limits (mean +- k sd) come from the whole frame of the client, counts
    and run maxima from its last ``n`` rows; runs are measured on the full
    frame first, so a run may start before the cut. Codes of checks that
    did not fire are ``09_no_alert``; the tracking check exists for
    ``revenue`` only and is NULL unless it fires.
    """
    w = ordered(["client"], ["Date"])
    wall = whole(["client"])
    rows = daily.select("client", "Date", *metrics)
    rows = rows.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(wall).alias("_cnt"),
    )
    per_row = []
    for m in metrics:
        v = F.col(m)
        mean = nan_to_null(F.avg(v).over(wall))
        sd = nan_to_null(F.stddev_samp(v).over(wall))
        prev = F.lag(v).over(w)
        per_row += [
            mean.alias(f"{m}__mean"), sd.alias(f"{m}__sd"),
            F.when(v > mean, 1).otherwise(0).alias(f"{m}__fa"),
            F.when(v < mean, 1).otherwise(0).alias(f"{m}__fb"),
            F.when(v < prev, 1).otherwise(0).alias(f"{m}__fn"),
            F.when(v > prev, 1).otherwise(0).alias(f"{m}__fp"),
        ]
    flagged = rows.select("*", *per_row)
    runs = []
    for m in metrics:
        for s in ("a", "b", "n", "p"):
            runs.append(run_length(f"{m}__f{s}", "_rn", w).alias(f"{m}__r{s}"))
    runs_df = flagged.select("*", *runs)

    last_n = (F.col("_cnt") - F.col("_rn")) < n
    in_pixel = (F.col("_cnt") - F.col("_rn")) < min(pixel_days, n)
    aggs = []
    for m in metrics:
        v, mean, sd = F.col(m), F.col(f"{m}__mean"), F.col(f"{m}__sd")
        for k in (1, 2, 3):
            aggs.append(F.count_if(last_n & (v > mean + k * sd)).alias(f"{m}__gt{k}"))
            aggs.append(F.count_if(last_n & (v < mean - k * sd)).alias(f"{m}__lt{k}"))
        for s in ("a", "b", "n", "p"):
            aggs.append(F.max(F.when(last_n, F.col(f"{m}__r{s}"))).alias(f"{m}__mr{s}"))
        if m == "revenue":
            aggs.append(F.count_if(in_pixel & (v == 0)).alias(f"{m}__zero"))
    stats = runs_df.groupBy("client").agg(*aggs)

    t1, t2 = py_round(one_dev * n), py_round(two_dev * n)
    tz = py_round(pixel_share * n)
    out = [F.col("client")]
    for m in metrics:
        c = lambda s: F.col(f"{m}__{s}")
        none = F.lit(CODES["none"])
        dev = (
            F.when((c("gt3") > 0) | (c("lt3") > 0), F.lit(CODES["high"]))
            .when((c("gt2") >= t2) | (c("lt2") >= t2), F.lit(CODES["medium"]))
            .when((c("gt1") >= t1) | (c("lt1") >= t1), F.lit(CODES["low"]))
            .otherwise(none)
        )
        neg_hit, pos_hit = c("mrn") >= n - 1, c("mrp") >= n - 1
        out += [
            (F.when(c("zero") > tz, F.lit(CODES["pixel"])) if m == "revenue"
             else F.lit(None).cast("string")).alias(f"{m}__tracking_alert"),
            dev.alias(f"{m}__deviation"),
            F.when(c("mrb") >= n - 1, F.lit(CODES["below"])).otherwise(none)
            .alias(f"{m}__below_mean_trend"),
            F.when(c("mra") >= n - 1, F.lit(CODES["above"])).otherwise(none)
            .alias(f"{m}__above_mean_trend"),
            F.when(neg_hit & ~pos_hit, F.lit(CODES["negative"])).otherwise(none)
            .alias(f"{m}__negative_slope_trend"),
            F.when(pos_hit & ~neg_hit, F.lit(CODES["positive"])).otherwise(none)
            .alias(f"{m}__positive_slope_trend"),
            (neg_hit & pos_hit).alias(f"{m}__slope_volatile"),
        ]
    return stats.select(*out)


def health_checks(daily: DataFrame, metrics: list[str] = HEALTH_METRICS,
                  **params) -> DataFrame:
    """Long form ``(client, metric, check, code)`` of every check that exists."""
    wide = health_wide(daily, metrics, **params)
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(ch).alias("check"),
                 F.col(f"{m}__{ch}").alias("code"))
        for m in metrics for ch in CHECKS
    ])
    return (wide.select("client", F.explode(items).alias("x"))
            .select("client", "x.metric", "x.check", "x.code")
            .where(F.col("code").isNotNull()))


def top_alerts(checks: DataFrame) -> DataFrame:
    """Most severe code per client and metric (codes sort by severity)."""
    return checks.groupBy("client", "metric").agg(F.min("code").alias("code"))


def alert_matrix_from_wide(wide: DataFrame, metrics: list[str] = HEALTH_METRICS) -> DataFrame:
    """Client x metric matrix of the most severe code, without a shuffle."""
    return wide.select(
        "client",
        *[F.least(*[F.col(f"{m}__{ch}") for ch in CHECKS]).alias(m) for m in metrics])


def alert_matrix(top: DataFrame, metrics: list[str] = HEALTH_METRICS) -> DataFrame:
    """Pivot of ``top_alerts`` output (explicit value list: no extra job)."""
    return top.groupBy("client").pivot("metric", metrics).agg(F.first("code"))


def channel_health(ad: DataFrame, site: DataFrame, d_date: DataFrame, as_of,
                   lookback: int = LOOKBACK_DAYS, metrics: list[str] = HEALTH_METRICS,
                   clients=None, **params) -> DataFrame:
    """Flagship: one alert code per client and health metric (of the
    selected ``clients``; all by default)."""
    daily = channel_daily(ad, site, d_date, as_of, lookback, clients)
    return alert_matrix_from_wide(health_wide(daily, metrics, **params), metrics)


# --------------------------------------------------------------- M8

def check_lookback(lookback: int) -> int:
    """The form rejects a look-back under 14 days (14 itself passes)."""
    if int(lookback) < MIN_CHART_LOOKBACK:
        raise ValueError("The lookback must be longer than 14 days")
    return int(lookback)


def form_lookback(lookback: int) -> int:
    """Days the form reads for a look-back: it adds the warm-up rows that the 7-row frames lose."""
    return check_lookback(lookback) + FORM_EXTRA_DAYS


def chart_level(metric: str) -> str:
    return "site" if metric in CHART_METRICS_SITE else "channel"


def control_chart(daily: DataFrame, metric: str, level: str | None = None,
                  precision: int | None = -1) -> DataFrame:
    """Control-chart frame: value (and its 7-row mean), mean, +-1/2/3 sd.

    ``precision=-1`` picks the chart default (2 for site metrics, 0 for
    channel metrics): values are rounded half-even first, mean and sd are
    taken over rounded values and ``k * sd`` is rounded separately.
    ``precision=None`` is the unrounded form.
    """
    level = level or chart_level(metric)
    if precision == -1:
        precision = 2 if level == "site" else 0
    rnd = (lambda c: half_even(c, precision)) if precision is not None else (lambda c: c)
    cols = [F.col("client"), F.col("Date"), rnd(F.col(metric)).alias("value")]
    if level == "channel":
        cols.append(rnd(F.col(f"{metric}_7_avg")).alias("value_7_avg"))
    base = daily.select(*cols)
    wall = whole(["client"])
    mean = rnd(nan_to_null(F.avg("value").over(wall)))
    sd = nan_to_null(F.stddev_samp("value").over(wall))
    out = base.select("*", mean.alias("mean"), sd.alias("_sd"))
    bands = []
    for k, name in ((1, "one"), (2, "two"), (3, "three")):
        step = rnd(F.col("_sd") * k)
        bands += [(F.col("mean") + step).alias(f"plus_{name}_sd"),
                  (F.col("mean") - step).alias(f"minus_{name}_sd")]
    return out.select(*[c for c in out.columns if c != "_sd"], *bands)


def control_charts(daily: DataFrame, metrics: list[str] = CHART_METRICS) -> DataFrame:
    """The rounded control charts of all ``metrics``, in long form with a ``metric`` column.

    The daily frame is read once and unpivoted, so all charts share one exchange on (client,
    metric); ``value_7_avg`` is NULL for site metrics.
    """
    rows = []
    for m in metrics:
        site = chart_level(m) == "site"
        p = 2 if site else 0
        avg7 = F.lit(None).cast("double") if site else half_even(F.col(f"{m}_7_avg"), p)
        rows.append(F.struct(F.lit(m).alias("metric"), half_even(F.col(m).cast("double"), p).alias("value"),
                             avg7.alias("value_7_avg")))
    long = daily.select("client", "Date", F.explode(F.array(*rows)).alias("x")).select("client", "Date", "x.*")
    rnd = lambda c: F.when(F.col("metric").isin(CHART_METRICS_SITE), half_even(c, 2)).otherwise(half_even(c, 0))
    wall = whole(["client", "metric"])
    out = long.select("*", rnd(nan_to_null(F.avg("value").over(wall))).alias("mean"),
                      nan_to_null(F.stddev_samp("value").over(wall)).alias("_sd"))
    bands = []
    for k, name in ((1, "one"), (2, "two"), (3, "three")):
        step = rnd(F.col("_sd") * k)
        bands += [(F.col("mean") + step).alias(f"plus_{name}_sd"), (F.col("mean") - step).alias(f"minus_{name}_sd")]
    return out.select(*long.columns, "mean", *bands)


def chart_columns(daily: DataFrame, variable: str) -> tuple[list[str], list[str]]:
    """Columns whose name contains ``variable``: (site side, channel side), sorted."""
    names = [c for c in daily.columns if variable in c]
    site = [c for c in names if "site" in c] + ["Date"]
    channel = [c for c in names if "site" not in c] + ["Date"]
    return sorted(site), sorted(channel)


def chart_top(frame: DataFrame, value: str = "value") -> DataFrame:
    """Axis top of the older chart form: 1.1 x the maximum per client."""
    return frame.groupBy("client").agg((F.max(value) * 1.1).alias("y_max"))


def chart_label(metric: str) -> str:
    """Title of a chart axis: words of the metric name capitalized."""
    return " ".join(w.capitalize() for w in metric.replace("_", " ").split(" "))


def client_registry(clients: DataFrame, name: str = "client") -> DataFrame:
    """The client list sorted by short name (credentials are not part of it)."""
    return clients.select(F.col(name).alias("short_name")).distinct().orderBy("short_name")
