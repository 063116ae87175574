"""Model monitoring: ranking by RMSE, variable importance, comparison.

``model_eval`` rows: model, model_id, short_name, type, ud, rmse, vi
(a Python dict literal), training, testing, start, end. "The first row"
of the source is made deterministic: the smallest (rmse, model_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rownumber import number_rows

# Fixed values of the source application.
INVALID = "Invalid selection, please try again"
METRIC_FIELDS = ["training", "testing", "rmse", "start", "end"]


def rank_models(evals: DataFrame) -> DataFrame:
    """All models with their ``rank`` by RMSE ascending, NULL last (numbered
    over range partitions), then model id."""
    order = [F.asc_nulls_last("rmse"), F.asc_nulls_first("model_id")]
    ranked = number_rows(evals.select("model_id", "short_name", "type", "rmse"), order, out="rank")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).orderBy("rank")


def parse_vi(vi) -> F.Column:
    """Dict literal -> map<string, double>.

    ``u''`` key prefixes are stripped and ``None`` becomes JSON null first;
    values parse as text and are cast one by one, so one non-numeric value
    turns only itself NULL, not the whole map.
    """
    v = F.regexp_replace(F.col(vi) if isinstance(vi, str) else vi,
                         "([{,]\\s*)u(['\"])", "$1$2")
    v = F.regexp_replace(v, ":\\s*None\\b", ": null")
    m = F.from_json(v, "map<string,string>", {"allowSingleQuotes": "true"})
    return F.transform_values(m, lambda k, x: x.try_cast("double"))


def best_runs(evals: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest (rmse, model_id) row per key, a NULL rmse last, as an
    aggregate (map-side partial min, so a key holding a third of all rows is
    still one small combine per split)."""
    best = F.min_by(F.struct(*[F.col(c) for c in evals.columns]),
                    F.struct(F.col("rmse").isNull(), F.col("rmse"), F.col("model_id")))
    return evals.groupBy(*keys).agg(best.alias("r")).select("r.*")


def importance(evals: DataFrame, model: str | None = None) -> DataFrame:
    """(model, variables, importance, position) of each model's best run,
    ordered by importance descending (NULL last), then name."""
    src = evals if model is None else evals.where(F.col("model") == model)
    best = best_runs(src, ["model"])
    out = best.select("model", F.explode(parse_vi("vi")).alias("variables", "importance"))
    # one run's map holds a bounded handful of variables
    w = Window.partitionBy("model").orderBy(F.desc_nulls_last("importance"), "variables")
    return out.withColumn("position", F.row_number().over(w)).orderBy("model", "position")


def comparison_choices(evals: DataFrame) -> DataFrame:
    """Distinct values offered for client, type and platform (long form)."""
    items = F.array(
        F.struct(F.lit("client").alias("field"), F.col("short_name").alias("value")),
        F.struct(F.lit("type").alias("field"), F.col("type").alias("value")),
        F.struct(F.lit("platform").alias("field"), F.col("ud").alias("value")))
    return evals.select(F.explode(items).alias("c")).select("c.*").distinct()


def _selections(spark: SparkSession, sel_a, sel_b) -> DataFrame:
    return spark.createDataFrame(
        [("a", *sel_a), ("b", *sel_b)],
        "side string, sel_short_name string, sel_type string, sel_ud string")


def _selected(evals: DataFrame, *picks) -> DataFrame:
    """One row per side: its first matching run or NULLs (left join from the
    two-row selection frame; only runs of the two selections are scanned on
    and reduced to one row each before the join)."""
    wanted = F.lit(False)
    for short, typ, ud in picks:
        wanted = wanted | ((F.col("short_name") == short) & (F.col("type") == typ)
                           & (F.col("ud") == ud))
    best = best_runs(evals.where(wanted), ["short_name", "type", "ud"])
    sel = _selections(evals.sparkSession, *picks)
    cond = ((sel.sel_short_name == best.short_name) & (sel.sel_type == best.type)
            & (sel.sel_ud == best.ud))
    return sel.join(best, cond, "left")


def compare_metrics(evals: DataFrame, sel_a, sel_b) -> DataFrame:
    """(side, model, field, value): the five run metrics of each selection,
    transposed to rows; a selection without a match gives one row
    holding the invalid-selection message."""
    s = _selected(evals, sel_a, sel_b)
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"),
                 F.col(f).cast("string").alias("value"))
        for f in METRIC_FIELDS])
    miss = F.array(F.struct(F.lit(None).cast("string").alias("field"),
                            F.lit(INVALID).alias("value")))
    rows = F.when(F.col("model").isNull(), miss).otherwise(fields)
    return s.select("side", "model", F.explode(rows).alias("x")).select(
        "side", "model", "x.field", "x.value")


def compare_importance(evals: DataFrame, sel_a, sel_b, lead: str | None = "left") -> DataFrame:
    """(side, variables, importance, position).

    Each side lists its best run's importances. With ``lead='left'`` side a
    is numbered by importance (descending, NULL last, then name) and side b
    takes side a's number for the same variable; a variable that side a
    lacks keeps its name and gets a NULL position (sorted last). ``'right'``
    mirrors it; ``None`` numbers each side on its own. A selection without
    a match gives one row holding the invalid-selection message.
    """
    s = _selected(evals, sel_a, sel_b)
    kv = s.select("side", F.explode_outer(parse_vi("vi")).alias("variables", "importance"),
                  F.col("model"))
    # one selection's map holds a bounded handful of variables
    own = F.row_number().over(Window.partitionBy("side").orderBy(
        F.desc_nulls_last("importance"), "variables"))
    kv = kv.withColumn("own", F.when(F.col("model").isNotNull(), own))
    lead_side = {"left": "a", "right": "b"}.get(lead) if lead else None
    if lead_side is None:
        out = kv.withColumn("position", F.col("own"))
    else:
        ref = kv.where(F.col("side") == lead_side).select(
            "variables", F.col("own").alias("lead_pos"))
        out = (kv.join(ref, "variables", "left")
               .withColumn("position", F.when(F.col("side") == lead_side, F.col("own"))
                           .otherwise(F.col("lead_pos"))))
    out = out.withColumn("variables", F.when(F.col("model").isNull(), F.lit(INVALID))
                         .otherwise(F.col("variables")))
    return (out.select("side", "variables", "importance", F.col("position").cast("int"))
            .orderBy("side", F.asc_nulls_last("position"), "variables"))
