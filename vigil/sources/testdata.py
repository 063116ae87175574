"""Driver testdata -> the logical tables the jobs read (design notes 7.2).

The source application read ad facts from one database per client, model
evaluations from dated CSV files, bid changes from object-store folders and
a product catalog from Hive. None of that ships with it, so every logical
table here is derived by Spark from the driver's parquet tables; its size
grows with them. Each derivation has a twin in ``vigil.plans.sqlgen``
(DuckDB SQL) that must give the same rows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the derivation (mirrored in the oracle SQL).
N_CLIENTS = 5               # client = 'client_' || user_id % 5
CHANNEL_MAX_K = 50          # events with props.k < 50 are ad-channel traffic
ORDERS_NULL_EVERY = 7       # adwords_orders is NULL when event_id % 7 = 0
CONVERSIONS_NULL_EVERY = 14  # adwords_conversions is NULL when event_id % 14 = 0
EVENTS_AS_OF = "2024-01-30"  # last day of the events table
PROMOTED_DISCOUNT = 0.05    # lineitem lines with l_discount >= .05 are ad-channel
MONEY = "decimal(18,2)"     # money columns of the relational fact tables
HISTORY_AS_OF = "2001-11-04"  # last ship day in lineitem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def date_id(d) -> F.Column:
    """yyyyMMdd integer key of a date or timestamp column."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def client_of(events: DataFrame) -> F.Column:
    return F.concat(F.lit("client_"), (F.col("user_id") % N_CLIENTS).cast("string"))


def money(c) -> F.Column:
    """Money as a relational source holds it: an exact decimal, so sums do
    not depend on the order rows arrive in (nor on the partitioning)."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def ad_facts(events: DataFrame) -> DataFrame:
    """f_product_adgroup_performance: one row per ad-channel event."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    is_p = (et == "purchase").cast("bigint")
    zero = F.lit(0).cast(MONEY)
    return (
        events.where(et.isin("view", "click", "purchase") & (k < CHANNEL_MAX_K))
        .select(
            client_of(events).alias("client"),
            date_id("ts").alias("d_date_id"),
            F.when(et == "purchase", money("value")).otherwise(zero).alias("adwords_revenue"),
            F.when(F.col("event_id") % ORDERS_NULL_EVERY == 0, F.lit(None).cast("bigint"))
            .otherwise(is_p).alias("adwords_orders"),
            F.when(F.col("event_id") % CONVERSIONS_NULL_EVERY == 0, F.lit(None).cast("bigint"))
            .otherwise(is_p).alias("adwords_conversions"),
            (et == "click").cast("bigint").alias("adwords_clicks"),
            (et == "view").cast("bigint").alias("adwords_impressions"),
            F.when(et == "click", money("value")).otherwise(zero).alias("adwords_cost"),
        )
    )


def site_facts(events: DataFrame) -> DataFrame:
    """f_site_performance: all purchases of a client's site, one row per day."""
    return (
        events.where(F.col("event_type") == "purchase")
        .groupBy(client_of(events).alias("client"), date_id("ts").alias("d_date_id"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(money("value")).alias("revenue"))
    )


def d_date(df: DataFrame, ts: str) -> DataFrame:
    """Date dimension (id yyyyMMdd, full_date) over the days present in ``df``."""
    return (df.select(F.to_date(ts).alias("full_date")).distinct()
            .select(date_id("full_date").alias("id"), "full_date"))


def day_bounds(ts: str, as_of: str, lookback: int) -> F.Column:
    """Whether a time stamp lies on one of the days [as_of - lookback, as_of]."""
    last = date.fromisoformat(as_of)
    first, after = last - timedelta(days=lookback), last + timedelta(days=1)
    stamp = lambda d: F.lit(d.isoformat()).cast("timestamp")
    return (F.col(ts) >= stamp(first)) & (F.col(ts) < stamp(after))


def calendar(spark: SparkSession, as_of: str, lookback: int) -> DataFrame:
    """Date dimension (id yyyyMMdd, full_date) of the days [as_of - lookback, as_of]."""
    last = F.lit(as_of).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, lookback), last)).alias("full_date"))
    return days.select(date_id("full_date").alias("id"), "full_date")


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its customer's market segment as ``client``.

    lineitem joins orders, which joins customer; both are equi-joins on
    keys and left to the planner (AQE turns a side into a broadcast only
    when its measured size is under the threshold).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", F.col("c_mktsegment").alias("client"))
    return li.join(oc, li.l_orderkey == oc.o_orderkey).drop("o_orderkey")


def history_days(lines: DataFrame) -> DataFrame:
    """Client-days of the lineitem history: sums over promoted lines (ad
    channel) and over all lines (site)."""
    ad = F.col("l_discount") >= PROMOTED_DISCOUNT
    gain = money("l_extendedprice") * (1 - money("l_discount"))
    return lines.groupBy("client", date_id("l_shipdate").alias("d_date_id")).agg(
        F.count_if(ad).alias("promoted"),
        F.sum(F.when(ad, gain)).alias("adwords_revenue"),
        F.sum(F.when(ad, F.col("l_quantity").cast("bigint"))).alias("adwords_clicks"),
        F.sum(F.when(ad, (F.col("l_quantity") * 10).cast("bigint"))).alias("adwords_impressions"),
        F.sum(F.when(ad, money("l_extendedprice") * money("l_tax"))).alias("adwords_cost"),
        F.count(F.lit(1)).alias("orders"),
        F.sum(gain).alias("revenue"))


def history_ad_facts(days: DataFrame) -> DataFrame:
    """Ad facts by client-day: days with a promoted line."""
    return days.where(F.col("promoted") > 0).select(
        "client", "d_date_id", "adwords_revenue", F.col("promoted").alias("adwords_orders"),
        F.lit(None).cast("bigint").alias("adwords_conversions"),
        "adwords_clicks", "adwords_impressions", "adwords_cost")


def history_site_facts(days: DataFrame) -> DataFrame:
    """Site facts by client-day."""
    return days.select("client", "d_date_id", "orders", "revenue")


# ------------------------------------------------------------ rule-made daily series

N_RULES = 10  # client = 'rule_' || o_custkey % 10
#: Value of a day (SQL of both engines): ``g`` the rule, ``age`` the days of the client that follow, ``base`` 100-102.
#: Rules 0-9: zeros, a jump, four days past 2 sd, seven past 1 sd, below the mean, above it, falling, rising,
#: rising then falling, nothing.
RULE_VALUE = """CASE
  WHEN g = 0 AND age < 7 THEN 0
  WHEN g = 1 AND age = 0 THEN 100000
  WHEN g = 2 AND age < 4 THEN 103.2
  WHEN g = 3 AND age < 7 THEN 102.3
  WHEN g = 3 AND age < 10 THEN 100
  WHEN g = 4 AND age < 9 THEN 100.6
  WHEN g = 5 AND age < 9 THEN 101.4
  WHEN g = 6 AND age < 10 THEN 100.55 + age * 0.1
  WHEN g = 7 AND age < 10 THEN 101.45 - age * 0.1
  WHEN g = 8 AND age < 10 THEN 100.55 + age * 0.1
  WHEN g = 8 AND age < 19 THEN 102.35 - age * 0.1
  ELSE base END"""


def rule_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, Date, revenue): the days on which a client's customers ordered, valued by the client's rule."""
    days = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % N_RULES).cast("int").alias("g"), F.to_date("o_orderdate").alias("Date")).distinct()
    # a client has at most one row per calendar day
    age = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("Date"))) - 1
    days = days.select("g", "Date", age.alias("age"),
                       (F.datediff("Date", F.lit("1992-01-01").cast("date")) % 3 + 100).alias("base"))
    return days.select(F.concat(F.lit("rule_"), F.col("g").cast("string")).alias("client"), "Date",
                       F.expr(RULE_VALUE).cast("double").alias("revenue"))


# ------------------------------------------------------------ model evals

MODEL_TYPES = ["gbm", "rf", "glm"]     # type = MODEL_TYPES[s_suppkey % 3]
PLATFORMS = ["web", "mobile"]          # ud   = PLATFORMS[s_suppkey % 2]
VI_VARIABLES = ["price", "brand", "size", "season"]


def model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_eval: one evaluated model run per supplier.

    ``vi`` is a Python dict literal, as the source wrote it: every 5th row
    has a ``u''`` key, every 7th a ``None`` value, every 11th a text value.
    Every 13th run has no RMSE.
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    typ = F.element_at(F.array(*[F.lit(t) for t in MODEL_TYPES]), (k % 3 + 1).cast("int"))
    ud = F.element_at(F.array(*[F.lit(t) for t in PLATFORMS]), (k % 2 + 1).cast("int"))
    short = F.lower(F.col("n_name"))
    num = lambda m: ((k * m) % 100).cast("string")
    vi = F.concat(
        F.lit("{'price': "), num(37),
        F.when(k % 5 == 0, F.lit(", u'brand': ")).otherwise(F.lit(", 'brand': ")), num(53),
        F.lit(", 'size': "), F.when(k % 7 == 0, F.lit("None")).otherwise(num(71)),
        F.lit(", 'season': "), F.when(k % 11 == 0, F.lit("'x'")).otherwise(num(89)),
        F.lit("}"))
    # nation has 25 rows in every scale: a fixed, proven broadcast size
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.concat_ws("_", short, typ, ud).alias("model"),
        k.cast("string").alias("model_id"),
        short.alias("short_name"),
        typ.alias("type"),
        ud.alias("ud"),
        F.when(k % 13 != 0, F.abs(F.col("s_acctbal")) / 1000).alias("rmse"),
        vi.alias("vi"),
        (k * 100).cast("string").alias("training"),
        (k * 25).cast("string").alias("testing"),
        F.lit("2024-01-01").alias("start"),
        F.lit("2024-01-30").alias("end"),
    )


# ------------------------------------------------------------ bid changes

BID_CLIENTS = ["acme", "bolt", "zen", "delta", "echo"]  # client = BID_CLIENTS[l_partkey % 5]
SITE_ID_BASE = 100                                      # site_id = 100 + l_partkey % 5
BASE_THRESHOLDS = [0.2, 0.25, 0.3, 0.35, 0.4]           # per client, same order
BROKEN_JSON_EVERY = 97                                  # catalog_json unreadable


def bid_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bid_changes(client, date, product_id, prediction): one row per line."""
    li = table(spark, sf_dir, "lineitem")
    pk = F.col("l_partkey")
    return li.select(
        F.element_at(F.array(*[F.lit(c) for c in BID_CLIENTS]), (pk % 5 + 1).cast("int"))
        .alias("client"),
        F.to_date("l_shipdate").alias("date"),
        pk.cast("string").alias("product_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))
         - F.col("l_extendedprice") * 0.9).alias("prediction"),
    )


def site_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_config(short_name, site_id, percent_prediction_threshold) per client."""
    part = table(spark, sf_dir, "part")
    g = (part.select((F.col("p_partkey") % 5).cast("int").alias("g")).distinct())
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), F.col("g") + 1)
    return g.select(pick(BID_CLIENTS).alias("short_name"),
                    (F.col("g") + SITE_ID_BASE).cast("bigint").alias("site_id"),
                    pick(BASE_THRESHOLDS).alias("percent_prediction_threshold"))


def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_catalog(site_id, product_id, brand, category, catalog_json).

    ``catalog_json`` is base64 of UTF-8 JSON holding price, cost, title and
    image_url; every 97th product carries unreadable JSON.
    """
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    js = F.concat(
        F.lit('{"price": "'), F.format_string("%.2f", F.col("p_retailprice")),
        F.lit('", "cost": "'), F.format_string("%.2f", F.col("p_retailprice") - F.col("p_size")),
        F.lit('", "title": "'), F.col("p_name"),
        F.lit('", "image_url": "https://img.example.com/'), pk.cast("string"),
        F.lit('.jpg"}'))
    js = F.when(pk % BROKEN_JSON_EVERY == 0, F.lit("{oops")).otherwise(js)
    return p.select(
        (pk % 5 + SITE_ID_BASE).cast("bigint").alias("site_id"),
        pk.cast("string").alias("product_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.base64(F.encode(js, "UTF-8")).alias("catalog_json"),
    )


def prediction_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prediction_performance: ready-made percentile rows, one per line.

    percentile = (l_partkey % 1001) / 10, so it covers 0..100 including the
    fractional gaps between tiers.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_partkey") % 5 + SITE_ID_BASE).cast("bigint").alias("site_id"),
        F.to_date("l_shipdate").alias("prediction_date"),
        F.concat(F.lit("model_"), (F.col("l_linenumber") % 2).cast("string")).alias("model_id"),
        ((F.col("l_partkey") % 1001) / 10.0).alias("percentile"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("cost"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_tax") * 10).alias("cum_percent_cost"),
        (F.col("l_discount") * 10).alias("cum_percent_revenue"),
    )
