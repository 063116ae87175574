"""Registered queries: each runs a job over the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB
SQL over the same tables) are checked side by side. ``finalize`` gives
every result the same outer shape as ``sqlgen.final``: dates as
yyyy-MM-dd text and doubles rounded to 6 places, because two engines sum
floats in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import testdata as td
from . import channel, sqlgen

ROUND = sqlgen.ROUND

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # the oracle's rounding: half away from zero of x * 10^ROUND
            scale = F.lit(10.0 ** ROUND)
            c = F.round(c.cast("double") * scale, 0) / scale + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- sources

EVENTS_LOOKBACK = 60      # the longest look-back of a query over events
HISTORY_LOOKBACK = 2600  # the whole 2,499-day lineitem history


def events_sources(spark: SparkSession, sf_dir: str):
    """Facts of the look-back only: the bound is on the stored time stamp, so
    it reaches the scan, before the day key is derived from it."""
    ev = td.table(spark, sf_dir, "events")
    ev = ev.where(td.day_bounds("ts", td.EVENTS_AS_OF, EVENTS_LOOKBACK))
    return td.ad_facts(ev), td.site_facts(ev), td.calendar(spark, td.EVENTS_AS_OF, EVENTS_LOOKBACK)


def history_sources(spark: SparkSession, sf_dir: str):
    """One join and one aggregation of the history serve both fact tables:
    its client-days are checkpointed (days x market segments)."""
    from ..operators.materialize import materialize
    days = materialize(td.history_days(td.history_lines(spark, sf_dir)))
    return (td.history_ad_facts(days), td.history_site_facts(days),
            td.calendar(spark, td.HISTORY_AS_OF, HISTORY_LOOKBACK))


# ---------------------------------------------------------------- channel

DAILY_KINDS = ([("client", "s"), ("Date", "d"), ("revenue", "f"), ("orders", "i"),
                ("clicks", "i"), ("impressions", "i"), ("cost", "f"), ("site_orders", "i"),
                ("site_revenue", "f")]
               + [(c, "f") for c in channel.DAILY_COLUMNS[9:]])

@register("channel_daily", sqlgen.daily_sql("events", td.EVENTS_AS_OF, 60, DAILY_KINDS))
def q_channel_daily(spark, sf_dir):
    ad, site, dd = events_sources(spark, sf_dir)
    return finalize(channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60))


@register("channel_health",
          sqlgen.health_matrix_sql("events", td.EVENTS_AS_OF, 60, channel.HEALTH_METRICS))
def q_channel_health(spark, sf_dir):
    ad, site, dd = events_sources(spark, sf_dir)
    return finalize(channel.channel_health(ad, site, dd, td.EVENTS_AS_OF, 60))


PICKED_CLIENTS = ["client_1", "client_3"]


@register("channel_health_selected", "SELECT * FROM (" + sqlgen.health_matrix_sql(
    "events", td.EVENTS_AS_OF, 60, channel.HEALTH_METRICS) + ") AS h WHERE client IN ('client_1', 'client_3')")
def q_channel_health_selected(spark, sf_dir):
    """The alert matrix of selected clients, filtered below the aggregation."""
    ad, site, dd = events_sources(spark, sf_dir)
    return finalize(channel.channel_health(ad, site, dd, td.EVENTS_AS_OF, 60, clients=PICKED_CLIENTS))


@register("channel_health_registry", "SELECT * FROM (" + sqlgen.health_matrix_sql(
    "events", td.EVENTS_AS_OF, 60, channel.HEALTH_METRICS) + ") AS h WHERE client IN ('client_1', 'client_3')")
def q_channel_health_registry(spark, sf_dir):
    """The clients to look at are rows of a registry frame."""
    ad, site, dd = events_sources(spark, sf_dir)
    ev = td.table(spark, sf_dir, "events")
    registry = channel.client_registry(ev.select(td.client_of(ev).alias("client")))
    wanted = registry.where(F.col("short_name").isin(PICKED_CLIENTS)).select(F.col("short_name").alias("client"))
    return finalize(channel.channel_health(ad, site, dd, td.EVENTS_AS_OF, 60, clients=wanted))


@register("alert_pivot", sqlgen.health_matrix_sql("events", td.EVENTS_AS_OF, 60, channel.HEALTH_METRICS))
def q_alert_pivot(spark, sf_dir):
    """The client x metric matrix pivoted from one row per client, metric and check."""
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60)
    return finalize(channel.alert_matrix(channel.top_alerts(channel.health_checks(daily))))


@register("health_checks",
          sqlgen.health_checks_sql("events", td.EVENTS_AS_OF, 60, channel.HEALTH_METRICS))
def q_health_checks(spark, sf_dir):
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60)
    return finalize(channel.health_checks(daily))


@register("channel_health_history",
          sqlgen.health_matrix_sql("history", td.HISTORY_AS_OF, HISTORY_LOOKBACK,
                                   channel.HEALTH_METRICS))
def q_channel_health_history(spark, sf_dir):
    ad, site, dd = history_sources(spark, sf_dir)
    return finalize(channel.channel_health(ad, site, dd, td.HISTORY_AS_OF, HISTORY_LOOKBACK))


@register("alert_rules", sqlgen.alert_rules_sql())
def q_alert_rules(spark, sf_dir):
    """M2-M5 on series made by rule, so that every alert code fires."""
    wide = channel.health_wide(td.rule_days(spark, sf_dir), ["revenue"])
    return finalize(wide.select("client", *[F.col(f"revenue__{c}").alias(c)
                                            for c in [*channel.CHECKS, "slope_volatile"]]))


# ---------------------------------------------------------------- charts (M8)

def _chart_sql(metric: str, level: str, precision: int | None, lookback: int = 60, cols_only: bool = False):
    r = (lambda x: f"round_even({x}, {precision})") if precision is not None else (lambda x: x)
    v7 = f", {r(metric + '_7_avg')} AS value_7_avg" if level == "channel" else ""
    bands = ", ".join(
        f"mean + {r(f'sd * {k}')} AS plus_{n}_sd, mean - {r(f'sd * {k}')} AS minus_{n}_sd"
        for k, n in ((1, "one"), (2, "two"), (3, "three")))
    inner = (f"WITH {sqlgen.source_ctes('events')},{sqlgen.daily_ctes(td.EVENTS_AS_OF, lookback)},\n"
             f"base AS (SELECT client, Date, {r(metric)} AS value{v7} FROM daily),\n"
             f"m AS (SELECT *, {r(sqlgen.nan_null('avg(value) OVER (PARTITION BY client)'))} AS mean,"
             f" {sqlgen.nan_null('stddev_samp(value) OVER (PARTITION BY client)')} AS sd FROM base)\n"
             f"SELECT client, Date, value{', value_7_avg' if v7 else ''}, mean, {bands} FROM m")
    cols = [("client", "s"), ("Date", "d"), ("value", "f")]
    if v7:
        cols.append(("value_7_avg", "f"))
    cols += [("mean", "f")] + [(f"{s}_{n}_sd", "f") for n in ("one", "two", "three")
                               for s in ("plus", "minus")]
    return (inner, [c for c, _ in cols]) if cols_only else sqlgen.final(inner, cols)


def _charts_sql(lookback: int) -> str:
    parts, kinds = [], [("client", "s"), ("Date", "d"), ("metric", "s"), ("value", "f"), ("value_7_avg", "f"),
                        ("mean", "f")]
    bands = [(f"{s}_{n}_sd", "f") for n in ("one", "two", "three") for s in ("plus", "minus")]
    for m in channel.CHART_METRICS:
        level = channel.chart_level(m)
        inner, cols = _chart_sql(m, level, 2 if level == "site" else 0, lookback, cols_only=True)
        v7 = "value_7_avg" if "value_7_avg" in cols else "CAST(NULL AS DOUBLE) AS value_7_avg"
        parts.append(f"SELECT client, Date, '{m}' AS metric, value, {v7}, mean, "
                     f"{', '.join(b for b, _ in bands)} FROM ({inner}) AS c")
    return sqlgen.final("\nUNION ALL ".join(parts), kinds + bands)


FORM_LOOKBACK = 30   # days asked for in the form, which reads 7 more


@register("control_charts", _charts_sql(FORM_LOOKBACK + 7))
def q_control_charts(spark, sf_dir):
    """M8 for all twelve metrics of the form, with its look-back check and its seven days more."""
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, channel.form_lookback(FORM_LOOKBACK))
    return finalize(channel.control_charts(daily))


@register("control_chart_plain", _chart_sql("aov", "channel", None))
def q_control_chart_plain(spark, sf_dir):
    """M8 in the older, unrounded form."""
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60)
    return finalize(channel.control_chart(daily, "aov", precision=None))


@register("control_chart_channel", _chart_sql("revenue", "channel", 0))
def q_control_chart_channel(spark, sf_dir):
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60)
    return finalize(channel.control_chart(daily, "revenue"))


@register("control_chart_site", _chart_sql("pct_site_orders", "site", 2))
def q_control_chart_site(spark, sf_dir):
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60)
    return finalize(channel.control_chart(daily, "pct_site_orders"))


@register("chart_top", sqlgen.final(
    f"WITH {sqlgen.source_ctes('events')},{sqlgen.daily_ctes(td.EVENTS_AS_OF, 60)}\n"
    "SELECT client, max(revenue) * 1.1 AS y_max FROM daily GROUP BY client",
    [("client", "s"), ("y_max", "f")]))
def q_chart_top(spark, sf_dir):
    ad, site, dd = events_sources(spark, sf_dir)
    daily = channel.channel_daily(ad, site, dd, td.EVENTS_AS_OF, 60)
    return finalize(channel.chart_top(daily, "revenue"))


@register("client_registry", sqlgen.final(
    f"SELECT DISTINCT {sqlgen.client_expr()} AS short_name FROM events", [("short_name", "s")]))
def q_client_registry(spark, sf_dir):
    ev = td.table(spark, sf_dir, "events")
    return finalize(channel.client_registry(ev.select(td.client_of(ev).alias("client"))))


@register("registry_positions", sqlgen.registry_positions_sql())
def q_registry_positions(spark, sf_dir):
    """The registry's order as a column."""
    from ..operators.rownumber import number_rows
    ev = td.table(spark, sf_dir, "events")
    clients = channel.client_registry(ev.select(td.client_of(ev).alias("client")))
    numbered = number_rows(clients, [F.asc("short_name")], out="before")
    return finalize(numbered.select("short_name", (F.col("before") + 1).cast("int").alias("position")))


# ---------------------------------------------------------------- models

from . import bids, models  # noqa: E402

SEL_A = ("nation_9", "rf", "web")
SEL_B = ("nation_6", "glm", "mobile")
SEL_NONE = ("nowhere", "gbm", "web")


@register("rank_models", sqlgen.rank_models_sql())
def q_rank_models(spark, sf_dir):
    return finalize(models.rank_models(td.model_eval(spark, sf_dir)))


@register("importance", sqlgen.importance_sql())
def q_importance(spark, sf_dir):
    return finalize(models.importance(td.model_eval(spark, sf_dir)))


ONE_MODEL = "nation_9_rf_web"


@register("importance_model", "SELECT * FROM (" + sqlgen.importance_sql() + f") AS i WHERE model = '{ONE_MODEL}'")
def q_importance_model(spark, sf_dir):
    """One model's importances."""
    return finalize(models.importance(td.model_eval(spark, sf_dir), ONE_MODEL))


@register("model_eval_file", sqlgen.rank_models_sql())
def q_model_eval_file(spark, sf_dir):
    """The evaluations written as a dated CSV and read back by day, then ranked."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    day, folder = "2024-01-30", scratch_path(spark, "model-eval")
    (td.model_eval(spark, sf_dir).select(*files.MODEL_EVAL_SCHEMA.fieldNames())
     .write.option("header", True).option("quote", '"').option("escape", '"')
     .csv(files.model_eval_path(folder, day)))
    return finalize(models.rank_models(files.read_model_eval(spark, folder, day)))


@register("comparison_choices", sqlgen.choices_sql())
def q_comparison_choices(spark, sf_dir):
    return finalize(models.comparison_choices(td.model_eval(spark, sf_dir)))


@register("compare_metrics", sqlgen.compare_metrics_sql(SEL_A, SEL_NONE))
def q_compare_metrics(spark, sf_dir):
    return finalize(models.compare_metrics(td.model_eval(spark, sf_dir), SEL_A, SEL_NONE))


@register("compare_importance", sqlgen.compare_importance_sql(SEL_A, SEL_B, "left"))
def q_compare_importance(spark, sf_dir):
    return finalize(models.compare_importance(td.model_eval(spark, sf_dir), SEL_A, SEL_B, "left"))


# ---------------------------------------------------------------- bids

PERF_SINCE = "1995-01-01"  # the whole prediction history


@register("bid_clients", sqlgen.bid_clients_sql())
def q_bid_clients(spark, sf_dir):
    return finalize(bids.list_clients(td.bid_changes(spark, sf_dir)))


@register("bid_dates", sqlgen.bid_dates_sql())
def q_bid_dates(spark, sf_dir):
    return finalize(bids.list_dates(td.bid_changes(spark, sf_dir)))


def _bid_files(spark, sf_dir):
    """Bids as an object store holds them: a folder per client and month, two parts whose columns stand in different
    order, and one with a row too wide, which must not be read."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    root = scratch_path(spark, "bid-files")
    bids_ = td.bid_changes(spark, sf_dir).select("client", F.trunc("date", "month").alias("date"), "product_id", "prediction")
    odd = F.pmod(F.xxhash64("product_id"), F.lit(2)) == 1
    files.write_bid_part(bids_.where(~odd), root, "raw_0.csv")
    files.write_bid_part(bids_.where(odd).withColumn("note", F.lit("a, b")), root, "raw_1.csv", ("note", "prediction", "product_id"))
    wide = bids_.select("client", "date", F.concat(F.lit("x,y"), "product_id").alias("product_id"), "prediction").where(
        F.col("product_id").endswith("7"))
    wide.select("client", "date").distinct().select(
        F.concat_ws("/", "client", F.date_format("date", "yyyy-MM-dd"), F.lit("raw_2.csv")).alias("name"),
        F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("product_id,prediction").alias("line")),
                          F.struct(F.lit(1).alias("at"), F.lit("p,1.0").alias("line")),
                          F.struct(F.lit(2).alias("at"), F.lit("p,1.0,2.0").alias("line")))).alias("x")).select(
        "name", "x.at", "x.line").transform(lambda lines: _write_lines(lines, root))
    return root


def _write_lines(lines, root):
    from ..sources.named_files import write_lines
    write_lines(lines, root)
    return lines


@register("bid_changes_file", sqlgen.monthly_bids_sql())
def q_bid_changes_file(spark, sf_dir):
    """Parts read by the names in their first lines, unreadable ones left out."""
    from ..sources import files
    parts = files.read_bid_changes(spark, _bid_files(spark, sf_dir))
    return finalize(parts.select("client", "date", "product_id", "prediction"))


@register("bid_partitions_file", sqlgen.monthly_bids_sql("client, date"))
def q_bid_partitions_file(spark, sf_dir):
    """Clients and days from the paths of the parts."""
    from ..sources import files
    found = files.list_bid_partitions(spark, _bid_files(spark, sf_dir))
    return finalize(found.select("client", F.col("date").cast("date").alias("date")))


@register("daily_top_products", sqlgen.top_products_sql())
def q_daily_top_products(spark, sf_dir):
    return finalize(bids.daily_top_products(
        td.bid_changes(spark, sf_dir), td.site_config(spark, sf_dir),
        td.product_catalog(spark, sf_dir)))


@register("site_config_file", sqlgen.site_config_sql())
def q_site_config_file(spark, sf_dir):
    """The client records written as the lines of one JSON array (a line per client) and read back."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    path = scratch_path(spark, "site-config")
    cfg = td.site_config(spark, sf_dir)
    last = cfg.select(F.max("short_name")).scalar()
    rows = cfg.select(F.concat(F.lit("1"), "short_name").alias("at"), F.concat(
        F.to_json(F.struct(*cfg.columns)), F.when(F.col("short_name") < last, ",").otherwise("")).alias("line"))
    ends = spark.createDataFrame([("0", "["), ("2", "]")], "at string, line string")
    _write_lines(rows.union(ends).select(F.lit("site_config.json").alias("name"), "at", "line"), path)
    return finalize(files.read_site_config(spark, path))


ONE_CLIENT, ONE_DAY = "acme", "1996-01-02"


@register("daily_top_products_one", "SELECT * FROM (" + sqlgen.top_products_sql()
          + f") AS t WHERE client = '{ONE_CLIENT}' AND date = '{ONE_DAY}'")
def q_daily_top_products_one(spark, sf_dir):
    """One client's day, filtered below the ranking."""
    return finalize(bids.daily_top_products(
        td.bid_changes(spark, sf_dir), td.site_config(spark, sf_dir),
        td.product_catalog(spark, sf_dir), ONE_CLIENT, ONE_DAY))


@register("threshold_what_if", sqlgen.threshold_sql(bids.THRESHOLD_GRID))
def q_threshold_what_if(spark, sf_dir):
    return finalize(bids.threshold_what_if(td.bid_changes(spark, sf_dir),
                                           td.site_config(spark, sf_dir)))


@register("bid_rank_percentile", sqlgen.rank_percentile_sql())
def q_bid_rank_percentile(spark, sf_dir):
    return finalize(bids.rank_percentile(td.bid_changes(spark, sf_dir)))


@register("tier_summary", sqlgen.tier_summary_sql(PERF_SINCE))
def q_tier_summary(spark, sf_dir):
    return finalize(bids.tier_summary(td.prediction_performance(spark, sf_dir), PERF_SINCE))


@register("prediction_choices", sqlgen.prediction_choices_sql(PERF_SINCE))
def q_prediction_choices(spark, sf_dir):
    return finalize(bids.prediction_choices(td.prediction_performance(spark, sf_dir), PERF_SINCE))


PICK_ORDINAL = 2  # the third product on the page (the form counts from 0)


@register("product_pick", sqlgen.top_products_sql(pick=PICK_ORDINAL))
def q_product_pick(spark, sf_dir):
    top = bids.daily_top_products(td.bid_changes(spark, sf_dir), td.site_config(spark, sf_dir),
                                  td.product_catalog(spark, sf_dir))
    return finalize(bids.pick_product(top, PICK_ORDINAL))


# ---------------------------------------------------------------- text

from . import search, text  # noqa: E402


def _docs(spark, sf_dir):
    return td.table(spark, sf_dir, "documents").select("doc_id", "text")


def _doc_tokens(spark, sf_dir):
    """Token arrays of all documents, tokenized once and written: the
    vocabulary, the encoding and the stream positions all read them."""
    from ..operators.materialize import written
    return written(text.doc_tokens(_docs(spark, sf_dir)), "tokens")


def _coded(spark, sf_dir):
    """The coded documents and their vocabulary: nothing else reads the words."""
    from ..operators.coded import code_documents
    coded = code_documents(text.doc_tokens(_docs(spark, sf_dir)))
    return coded, text.coded_vocabulary(coded)


def _toks(doc_toks):
    return doc_toks.select("doc_id", F.posexplode("words").alias("pos", "word"))


def _vocab_parts(spark, sf_dir):
    toks = _toks(_doc_tokens(spark, sf_dir))
    vocab = text.build_vocabulary(toks)
    return toks, vocab


@register("clean_tokens", sqlgen.clean_tokens_sql())
def q_clean_tokens(spark, sf_dir):
    return finalize(text.clean_tokens(_docs(spark, sf_dir)))


@register("complaint_tokens", sqlgen.clean_tokens_sql())
def q_complaint_tokens(spark, sf_dir):
    """Documents written as a quoted, multi-line complaints CSV, read back and cleaned."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    path = scratch_path(spark, "complaints")
    (_docs(spark, sf_dir).toDF("Complaint ID", "Consumer complaint narrative").write.option("header", True)
     .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return finalize(text.clean_tokens(files.read_complaints(spark, path)))


@register("vocabulary", sqlgen.vocabulary_sql())
def q_vocabulary(spark, sf_dir):
    return finalize(_vocab_parts(spark, sf_dir)[1])


@register("lexicon_file", sqlgen.vocabulary_sql())
def q_lexicon_file(spark, sf_dir):
    """K2: the lexicon saved and read back."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    path = scratch_path(spark, "lexicon")
    files.write_table(_vocab_parts(spark, sf_dir)[1], path)
    return finalize(spark.read.parquet(path))


@register("vocab_stats", sqlgen.vocab_stats_sql())
def q_vocab_stats(spark, sf_dir):
    toks, vocab = _vocab_parts(spark, sf_dir)
    return finalize(text.vocab_stats(toks, text.encode(toks, vocab)))


@register("distinct_words", sqlgen.distinct_words_sql())
def q_distinct_words(spark, sf_dir):
    """Distinct words of each source, exact and by sketches that are stored and merged: each source's estimate, and that
    of all sources together, within three standard errors."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    docs = td.table(spark, sf_dir, "documents").select("source", "text")
    path = scratch_path(spark, "sketches")
    files.write_table(text.word_sketches(docs, "source"), path)
    stored = spark.read.parquet(path)
    words = docs.where("text is not null").select("source", F.explode(text.tokens(F.col("text"))).alias("word"))
    exact = words.groupBy("source").agg(F.count_distinct("word").alias("words"))
    bound = 3 * 1.04 / 2 ** (text.SKETCH_BITS / 2)
    near = lambda estimate, n: F.abs(estimate - n) <= bound * n
    merged = text.distinct_estimate(stored).select("estimate").scalar()
    each = text.distinct_estimate(stored, ["source"]).withColumnRenamed("source", "of")
    rows = exact.join(each, F.col("source").eqNullSafe(F.col("of")))
    total = words.select(F.count_distinct("word")).scalar()
    return finalize(rows.select("source", "words", near(F.col("estimate"), F.col("words")).alias("near"),
                                near(merged, total).alias("merged_near")))


@register("documents_files", sqlgen.documents_files_sql())
def q_documents_files(spark, sf_dir):
    """Every document as a file of its own, in one of four charsets; read by a glob, numbered by path, decoded, cleaned.
    A folder holds the documents of a thousand ids, which leaves the paths in the order of the ids."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    path = scratch_path(spark, "document-files")
    docs = _docs(spark, sf_dir).where("text is not null")
    kind, latin = F.col("doc_id") % 4, F.rlike("text", F.lit(r"\A[\x00-\xFF]*\z"))
    content = (F.when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
               .when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
               .when((kind == 3) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")))
    name = F.format_string("%019d.txt", "doc_id")
    files.write_documents(docs.select(F.concat_ws("/", F.substring(name, 1, 16), name).alias("name"), content.alias("content")), path)
    read = files.read_documents(spark, f"{path}/*/*.txt")
    return finalize(text.clean_tokens(read.select("doc_id", "text")))


@register("document_vectors", sqlgen.document_vectors_sql(64))
def q_document_vectors(spark, sf_dir):
    """Vectors stored by id, looked up for every encoded token, and their mean for each document."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    from ..operators.coded import decode, word_ids
    from .vectors import means_of_documents
    vectors = td.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    buckets = max(files.VECTOR_BUCKETS, -(-vectors.count() // files.BUCKET_ROWS))
    store = spark.table(files.write_vectors(vectors, scratch_path(spark, "vectors"), buckets=buckets))
    coded, vocab = _coded(spark, sf_dir)
    tokens = coded.documents.agg(F.sum("size")).first()[0] or 0   # a number
    means = means_of_documents(decode(coded.documents, word_ids(coded, vocab.where("id > 0")), "key").withColumnRenamed("key", "doc_id"),
                               store, 64, tokens)
    coded.table.drop()
    return finalize(means.select("doc_id", "n", F.posexplode("m").alias("i", "value")))


VECTOR_DIM, VECTOR_STEPS, VECTOR_NEGATIVES, VECTOR_RATE = 8, 2, 1, 100.0


@register("word_vectors", sqlgen.word_vectors_sql(VECTOR_DIM, VECTOR_STEPS, VECTOR_NEGATIVES, VECTOR_RATE))
def q_word_vectors(spark, sf_dir):
    """Two steps of noise-contrastive training over all pairs of the token stream."""
    from . import vectors
    coded, vocab = _coded(spark, sf_dir)
    pairs = text.skipgram_pairs(coded, vocab, 1, 2)
    coded.table.drop()
    found = vectors.word_vectors(pairs, vocab, VECTOR_DIM, VECTOR_STEPS, VECTOR_NEGATIVES, VECTOR_RATE)
    return finalize(found.select("id", F.posexplode("vector").alias("i", "value")))


@register("skipgram_pairs", sqlgen.skipgram_sql(1))
def q_skipgram_pairs(spark, sf_dir):
    coded, vocab = _coded(spark, sf_dir)
    pairs = text.skipgram_pairs(coded, vocab, 1, 2)
    coded.table.drop()
    return finalize(pairs)


@register("skipgram_within", sqlgen.skipgram_within_sql(2))
def q_skipgram_within(spark, sf_dir):
    """W12 with a window of two, inside documents only."""
    coded, vocab = _coded(spark, sf_dir)
    pairs = text.skipgram_pairs(coded, vocab, 2, 4, within_document=True)
    coded.table.drop()
    return finalize(pairs)


def _query_texts(spark, sf_dir):
    q = td.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text.query_terms(q)


@register("search_bm25", sqlgen.search_sql("bm25"))
def q_search_bm25(spark, sf_dir):
    index = search.index_documents(_docs(spark, sf_dir), "bm25")
    return finalize(search.search(index, _query_texts(spark, sf_dir)))


@register("search_cosine", sqlgen.search_sql("cosine"))
def q_search_cosine(spark, sf_dir):
    index = search.index_documents(_docs(spark, sf_dir), "cosine")
    return finalize(search.search(index, _query_texts(spark, sf_dir)))


@register("search_bm25_indexed", sqlgen.search_sql("bm25"))
def q_search_bm25_indexed(spark, sf_dir):
    """K4: the index is written under the session's shared checkpoint folder, read back by its path alone, and searched:
    first for one half of the queries, then for the other, from the same files."""
    from ..operators.materialize import scratch_path
    path = scratch_path(spark, "index")
    search.write_index(text.doc_tokens(_docs(spark, sf_dir)), path, "bm25")
    qt, even = _query_texts(spark, sf_dir), F.col("query_id") % 2 == 0
    halves = [search.search(search.read_index(spark, path), qt.where(c)) for c in (even, ~even | even.isNull())]
    return finalize(halves[0].unionByName(halves[1]))


# ---------------------------------------------------------------- learn

from . import learn, timesheet  # noqa: E402

N_CLASSES = 10
EMBED_DIM = 64
HIDDEN = 8


def _emb(spark, sf_dir):
    return td.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def _centroid_scores(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    return learn.score(emb, learn.centroid_model(emb))


@register("classifier_scores", sqlgen.classifier_scores_sql())
def q_classifier_scores(spark, sf_dir):
    s = _centroid_scores(spark, sf_dir)
    return finalize(s.select(F.col("id").alias("vec_id"), "label", "prediction", "log_prob"))


@register("classifier_eval", sqlgen.classifier_eval_sql())
def q_classifier_eval(spark, sf_dir):
    return finalize(learn.evaluate(_centroid_scores(spark, sf_dir)))


@register("batch_gradient", sqlgen.batch_gradient_sql(EMBED_DIM, HIDDEN, N_CLASSES))
def q_batch_gradient(spark, sf_dir):
    wts = learn.rule_weights(spark, EMBED_DIM, HIDDEN, N_CLASSES)
    return finalize(learn.batch_gradient(_emb(spark, sf_dir), wts))


NET_STEPS, NET_RATE, NET_L2 = 2, 0.001, 0.01


@register("network_steps", sqlgen.network_steps_sql(EMBED_DIM, HIDDEN, N_CLASSES, NET_STEPS, NET_RATE, NET_L2))
def q_network_steps(spark, sf_dir):
    """The weights after two full-batch steps with an L2 term, and the cost before each."""
    wts, costs = learn.train_network(_emb(spark, sf_dir), learn.rule_weights(spark, EMBED_DIM, HIDDEN, N_CLASSES),
                                     NET_STEPS, NET_RATE, NET_L2)
    paid = spark.createDataFrame([("cost", s, 0, c) for s, c in enumerate(costs)], learn.NETWORK)
    return finalize(wts.unionByName(paid))


@register("classifier_outputs", sqlgen.classifier_outputs_sql())
def q_classifier_outputs(spark, sf_dir):
    """rectified logit, probability and one-hot target of every class."""
    from ..functions.expr import one_hot, relu
    s = _centroid_scores(spark, sf_dir)
    each = s.select(F.col("id").alias("vec_id"), one_hot("label", N_CLASSES).alias("target"), F.explode(
        F.arrays_zip("classes", "logits", "probability")).alias("x"))
    return finalize(each.select("vec_id", F.col("x.classes").alias("class"), relu("x.logits").alias("relu"),
                                F.col("x.probability").alias("probability"), F.get("target", "x.classes").alias("target")))


@register("holdout_orders", sqlgen.holdout_orders_sql(1000))
def q_holdout_orders(spark, sf_dir):
    """W13 over a table of more rows than are held out."""
    orders = td.table(spark, sf_dir, "orders")
    test = learn.holdout_flag(orders, "o_orderkey", HOLDOUT)
    return finalize(orders.select("o_orderkey", F.when(test, "test").otherwise("train").alias("split")))


# Fixed values of the source's training scripts.
HOLDOUT = 1000  # the last 1,000 rows are held out
BATCH = 32      # mini-batch size; the incomplete last batch is dropped


@register("holdout_split", sqlgen.holdout_sql(HOLDOUT))
def q_holdout_split(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    test = learn.holdout_flag(emb, "id", HOLDOUT)
    return finalize(emb.select(F.col("id").alias("vec_id"), "label",
                               F.when(test, "test").otherwise("train").alias("split")))


@register("mini_batches", sqlgen.mini_batches_sql(BATCH))
def q_mini_batches(spark, sf_dir):
    b = learn.mini_batches(_emb(spark, sf_dir), "id", BATCH)
    return finalize(b.select(F.col("id").alias("vec_id"), "label",
                             F.col("batch").cast("bigint").alias("batch")))


@register("standardized_features", sqlgen.standardized_sql())
def q_standardized_features(spark, sf_dir):
    s = learn.standardize(_emb(spark, sf_dir))
    return finalize(s.select(F.col("id").alias("vec_id"), "label",
                             F.posexplode("features").alias("i", "z")))


@register("mlp_holdout_eval")
def q_mlp_holdout_eval(spark, sf_dir):
    """Spark ML perceptron on the first 80% of vec ids, scored on the rest
    (not SQL-expressible: iterative training)."""
    emb = _emb(spark, sf_dir)
    cut = emb.select(F.percentile_approx("id", 0.8)).scalar()
    train, test = emb.where(F.col("id") <= cut), emb.where(F.col("id") > cut)
    model = learn.fit_mlp(train, EMBED_DIM, HIDDEN, N_CLASSES, max_iter=50)
    pred = learn.mlp_predict(model, test)
    return finalize(pred.agg(F.count(F.lit(1)).alias("n"),
                             F.avg((F.col("label") == F.col("prediction")).cast("double"))
                             .alias("accuracy")))


@register("unit_embeddings", sqlgen.unit_embeddings_sql())
def q_unit_embeddings(spark, sf_dir):
    """every vector divided by its Euclidean norm, one row per component."""
    from ..functions.expr import l2_normalize
    e = td.table(spark, sf_dir, "embeddings")
    unit = e.select("vec_id", l2_normalize(F.col("embedding").cast("array<double>")).alias("u"))
    return finalize(unit.select("vec_id", F.posexplode("u").alias("i", "value")))


# ---------------------------------------------------------------- timesheet

def _timesheet(spark, sf_dir):
    ev = td.table(spark, sf_dir, "events")
    starts = ev.where(F.col("event_type") == "click").select(
        F.col("user_id"), "event_id",
        F.concat(F.lit("project_"), F.get_json_object("props", "$.k")).alias("project"),
        F.col("ts").alias("start"))
    ends = ev.where(F.col("event_type") == "purchase").select(
        "user_id", "event_id", F.col("ts").alias("end"))
    return timesheet.timesheet(starts, ends, key="user_id", order=["event_id"])


@register("timesheet", sqlgen.timesheet_sql())
def q_timesheet(spark, sf_dir):
    return finalize(_timesheet(spark, sf_dir))


@register("timesheet_file", sqlgen.timesheet_sql())
def q_timesheet_file(spark, sf_dir):
    """K1: the sheet written as CSV, a folder per day, and read back."""
    from ..operators.materialize import scratch_path
    from ..sources import files
    path, sheet = scratch_path(spark, "timesheet"), _timesheet(spark, sf_dir)
    files.write_timesheet(sheet, path)
    return finalize(files.read_timesheet(spark, path, sheet.schema))


def _event_stream(spark, sf_dir):
    """The events table as a stream of stopwatch events."""
    path = f"{sf_dir}/events.parque[t]"   # a pattern: the table may be one file or a folder
    ev = spark.readStream.schema(td.table(spark, sf_dir, "events").schema).parquet(path)
    is_start = F.col("event_type") == "click"
    return ev.where(F.col("event_type").isin("click", "purchase")).select(
        F.col("user_id").cast("string").alias("key"), F.when(is_start, "start").otherwise("end").alias("kind"), "ts",
        F.when(is_start, F.concat(F.lit("project_"), F.get_json_object("props", "$.k"))).alias("project"),
        F.col("event_id").alias("seq"))


def _by_user(pairs):
    return pairs.select(F.col("key").cast("long").alias("user_id"), "k", "Project", "Start", "End", "Time Spent")


STREAM_TTL = "3 days"


@register("timesheet_stream", sqlgen.timesheet_sql())
def q_timesheet_stream(spark, sf_dir):
    """All events replayed as a stream; the pairs it emits and the rows that its state still holds."""
    from ..streaming import timesheet_stream as ts
    emitted, checkpoint = ts.replay(_event_stream(spark, sf_dir), "36500 days")
    return finalize(_by_user(emitted.unionByName(ts.open_rows(spark, checkpoint))))


@register("timesheet_stream_expired", sqlgen.timesheet_sql(STREAM_TTL, "1 hour"))
def q_timesheet_stream_expired(spark, sf_dir):
    """What the stream emits by itself, rows without a partner once the watermark has passed them."""
    from ..streaming import timesheet_stream as ts
    return finalize(_by_user(ts.replay(_event_stream(spark, sf_dir), STREAM_TTL)[0]))
