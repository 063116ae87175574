"""Bid changes: client/date listing, daily top products with catalog
details, threshold what-if, and prediction-tier summaries.

``bids``: (client, date, product_id, prediction[, file_path]) as read by
``vigil.sources.files.read_bid_changes`` or derived from the testdata.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Fixed values of the source application.
TOP_K = 5
MIN_CLIENT_NAME = 4                      # names of 3 characters or fewer are hidden
THRESHOLD_GRID = [0.7, 0.8, 1.0, 1.2, 1.3]
DEFAULT_GRID_INDEX = 2
N_TIERS = 20
TIER_WIDTH = 5
PREDICTION_DAYS = 14
CATALOG_FIELDS = ["price", "cost", "title", "image_url"]


# ------------------------------------------------------------------ M12

def list_clients(bids: DataFrame) -> DataFrame:
    return (bids.select("client").distinct()
            .where(F.length("client") >= MIN_CLIENT_NAME).orderBy("client"))


def list_dates(bids: DataFrame, client: str | None = None) -> DataFrame:
    src = bids if client is None else bids.where(F.col("client") == client)
    return src.select("client", "date").distinct().orderBy("client", "date")


# ------------------------------------------------------------------ M13

def top_products(bids: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top ``k`` rows by prediction per (client, date); ties by product id.

    ``row_number() <= k`` plans as a WindowGroupLimit, and Spark applies a
    partial limit before the exchange, so a hot (client, date) sends only
    ``k`` rows per input split. A product appearing twice keeps its best
    rank (the source's IN-list merged duplicates).
    """
    tie = [c for c in ("file_path",) if c in bids.columns] + ["product_id"]
    w = Window.partitionBy("client", "date").orderBy(
        F.desc_nulls_last("prediction"), *[F.col(c) for c in tie])
    top = bids.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("client", "date", "product_id").agg(F.min("rank").alias("rank"))


def catalog_fields(catalog: DataFrame) -> DataFrame:
    """Decode base64 JSON: unreadable JSON gives NULL fields."""
    js = F.decode(F.unbase64("catalog_json"), "UTF-8")
    return catalog.select(
        "site_id", "product_id", "brand", "category",
        *[F.get_json_object(js, f"$.{f}").alias(f) for f in CATALOG_FIELDS])


def daily_top_products(bids: DataFrame, config: DataFrame, catalog: DataFrame,
                       client: str | None = None, date=None, k: int = TOP_K) -> DataFrame:
    """(client, date, rank, product_id, brand, category, price, cost, title,
    image_url) for the top ``k`` bid changes of each client and day.

    With a single client and date the top set has at most ``k`` rows, a
    proven bound, and is broadcast into the catalog; over many days the
    planner picks the join from measured sizes.
    """
    src = bids
    if client is not None:
        src = src.where(F.col("client") == client)
    if date is not None:
        src = src.where(F.col("date") == F.lit(date).cast("date"))
    top = top_products(src, k).join(
        config.select(F.col("short_name").alias("client"), "site_id"), "client")
    if client is not None and date is not None:
        top = F.broadcast(top)
    cat = catalog_fields(catalog)
    return (top.join(cat, ["site_id", "product_id"], "inner")
            .select("client", "date", "rank", "product_id", "brand", "category",
                    *CATALOG_FIELDS)
            .orderBy("client", "date", "rank"))


def pick_product(top: DataFrame, n: int) -> DataFrame:
    """The n-th displayed product of each client-day (0-based, as the form
    numbers them); ranks may have gaps, displayed places have none. A
    client-day displays at most the top k."""
    shown = Window.partitionBy("client", "date").orderBy("rank", "product_id")
    return (top.withColumn("_shown", F.row_number().over(shown))
            .where(F.col("_shown") == n + 1).drop("_shown"))


# ------------------------------------------------------------------ M14

def _count_under(n_ranked: F.Column, n: F.Column, t: F.Column) -> F.Column:
    """#{r in 1..n_ranked : r / n < t} in float arithmetic.

    Ranks with method 'first' are a permutation of 1..n_ranked, so the
    count needs no sort: start above the answer and step down while the
    float test fails (at most two steps).
    """
    c = F.least(n_ranked, F.greatest(F.lit(0), F.floor(t * n).cast("bigint") + 1))
    for _ in range(2):
        c = F.when((c > 0) & ((c.cast("double") / n) >= t), c - 1).otherwise(c)
    return c.cast("bigint")


def threshold_what_if(bids: DataFrame, config: DataFrame, client: str | None = None,
                      date=None, grid: list[float] = THRESHOLD_GRID) -> DataFrame:
    """(client, date, threshold, increases).

    A product's percentile is its rank (prediction descending, first come
    first ranked) over the row count of its file set; NULL predictions get
    no rank but count in the denominator. ``increases`` is the number of
    products whose percentile is strictly under ``threshold`` = grid value
    x the client's current threshold. Only counts cross the shuffle.
    """
    src = bids
    if client is not None:
        src = src.where(F.col("client") == client)
    if date is not None:
        src = src.where(F.col("date") == F.lit(date).cast("date"))
    counts = src.groupBy("client", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count("prediction").alias("n_ranked"))
    cfg = config.select(F.col("short_name").alias("client"),
                        F.col("percent_prediction_threshold").alias("current"))
    g = F.array(*[F.lit(float(x)) for x in grid])
    out = counts.join(cfg, "client").select(
        "client", "date", "n", "n_ranked", F.explode(g).alias("factor"), "current")
    out = out.withColumn("threshold", F.col("factor") * F.col("current"))
    return out.select("client", "date", "threshold",
                      _count_under(F.col("n_ranked"), F.col("n").cast("double"),
                                   F.col("threshold")).alias("increases"))


def rank_percentile(bids: DataFrame) -> DataFrame:
    """Per-row rank and percentile within (client, date): prediction
    descending, ties by arrival (file path, then product id); a NULL
    prediction gets a NULL rank but counts in the denominator.

    Ranked rows are numbered over range partitions of the whole order, so a
    hot (client, date), or one prediction shared by all its rows, is spread
    over many tasks.
    """
    from ..operators.rownumber import number_rows
    tie = [c for c in ("file_path",) if c in bids.columns] + ["product_id"]
    keys = ["client", "date"]
    # the NULL predictions of a (client, date) come last and take no rank
    numbered = number_rows(bids, [F.desc_nulls_last("prediction"), *[F.asc_nulls_first(c) for c in tie]],
                           key=keys, out="_off")
    rank = F.when(F.col("prediction").isNotNull(), (F.col("_off") + 1).cast("int"))
    counts = bids.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    on = F.col("client").eqNullSafe(F.col("_client")) & F.col("date").eqNullSafe(F.col("_date"))
    out = numbered.join(counts, on).withColumn("predicted_cm_rank", rank)
    return out.withColumn("predicted_cm_percentile", F.col("predicted_cm_rank") / F.col("_n")).select(
        *bids.columns, "predicted_cm_rank", "predicted_cm_percentile")


# ------------------------------------------------------------------ M15

def tier(percentile) -> F.Column:
    """'tier_i' when 5i-4 <= p <= 5i for i in 1..20, else NULL (gaps, 0)."""
    p = F.col(percentile) if isinstance(percentile, str) else percentile
    i = F.ceil(p / TIER_WIDTH)
    ok = (i >= 1) & (i <= N_TIERS) & (p >= i * TIER_WIDTH - (TIER_WIDTH - 1))
    return F.when(ok, F.concat(F.lit("tier_"), i.cast("string")))


def prediction_choices(perf: DataFrame, since) -> DataFrame:
    """Distinct (site_id, prediction_date) since a date."""
    return (perf.where(F.col("prediction_date") >= F.lit(since).cast("date"))
            .select("site_id", "prediction_date").distinct())


def tier_summary(perf: DataFrame, since) -> DataFrame:
    """Per (site, date, model, tier): summed cost and revenue, max
    cumulative shares. Rows whose percentile falls in no tier are left out."""
    src = perf.where(F.col("prediction_date") >= F.lit(since).cast("date"))
    return (src.withColumn("tier", tier("percentile")).where(F.col("tier").isNotNull())
            .groupBy("site_id", "prediction_date", "model_id", "tier")
            .agg(F.sum("cost").alias("cost"), F.sum("revenue").alias("revenue"),
                 F.max("cum_percent_cost").alias("cum_percent_cost"),
                 F.max("cum_percent_revenue").alias("cum_percent_revenue")))
