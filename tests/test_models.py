"""Model monitoring: dict-literal parsing, best run, comparison."""

import pytest
from pyspark.sql import functions as F

from vigil.plans import models


def evals(spark, rows):
    cols = ["model", "model_id", "short_name", "type", "ud", "rmse", "vi",
            "training", "testing", "start", "end"]
    return spark.createDataFrame(rows, ", ".join(
        f"`{c}` {'double' if c == 'rmse' else 'string'}" for c in cols))


def row(model, mid, short, typ, ud, rmse, vi):
    return (model, mid, short, typ, ud, rmse, vi, "100", "25", "2024-01-01", "2024-01-30")


@pytest.mark.parametrize("vi,expect", [
    ("{'a': 0.5}", {"a": 0.5}),
    ("{u'a': 0.5, u'b': 2}", {"a": 0.5, "b": 2.0}),
    ("{'a': None, 'b': 1}", {"a": None, "b": 1.0}),
    ("{'a': 'x', 'b': 1}", {"a": None, "b": 1.0}),
])
def test_parse_vi_nulls_only_the_bad_value(spark, vi, expect):
    got = spark.createDataFrame([(vi,)], "vi string").select(models.parse_vi("vi").alias("m"))
    assert got.collect()[0]["m"] == expect


def test_importance_uses_best_run_and_orders(spark):
    df = evals(spark, [row("m1", "1", "x", "gbm", "web", 0.5, "{'a': 1, 'b': 3}"),
                       row("m1", "2", "x", "gbm", "web", 0.4, "{'a': 2, 'b': None, 'c': 5}"),
                       row("m2", "3", "y", "rf", "web", 0.1, "{'z': 1}")])
    got = [(r.variables, r.importance) for r in models.importance(df, "m1").collect()]
    assert got == [("c", 5.0), ("a", 2.0), ("b", None)]


def test_rank_models_sorted(spark):
    df = evals(spark, [row("m", str(i), "x", "gbm", "web", r, "{}")
                       for i, r in enumerate([0.3, 0.1, 0.2])])
    assert [r.rmse for r in models.rank_models(df).collect()] == [0.1, 0.2, 0.3]


def test_a_run_without_rmse_comes_last_and_never_wins(spark):
    df = evals(spark, [row("m", "1", "x", "gbm", "web", None, "{'bad': 1}"),
                       row("m", "2", "x", "gbm", "web", 0.5, "{'good': 1}")])
    assert [(r["rank"], r.rmse) for r in models.rank_models(df).collect()] == [(1, 0.5), (2, None)]
    assert [(r.variables, r.position) for r in models.importance(df).collect()] == [("good", 1)]


def test_comparison_invalid_selection_and_one_sided_variable(spark):
    df = evals(spark, [row("m1", "1", "x", "gbm", "web", 0.5, "{'a': 1, 'b': 3}"),
                       row("m2", "2", "y", "rf", "web", 0.4, "{'a': 2, 'z': 9, 'b': 1}")])
    met = models.compare_metrics(df, ("x", "gbm", "web"), ("q", "gbm", "web")).collect()
    b = [r for r in met if r.side == "b"]
    assert len(b) == 1 and b[0].value == models.INVALID
    a = {r.field: r.value for r in met if r.side == "a"}
    assert a == {"training": "100", "testing": "25", "rmse": "0.5",
                 "start": "2024-01-01", "end": "2024-01-30"}
    imp = models.compare_importance(df, ("x", "gbm", "web"), ("y", "rf", "web"), "left").collect()
    side_b = [(r.variables, r.position) for r in imp if r.side == "b"]
    # b follows a's order (b=1, a=2); z, absent from a, keeps its name and goes last
    assert side_b == [("b", 1), ("a", 2), ("z", None)]
    right = models.compare_importance(df, ("x", "gbm", "web"), ("y", "rf", "web"), "right")
    side_a = [(r.variables, r.position) for r in right.collect() if r.side == "a"]
    assert side_a == [("a", 2), ("b", 3)]   # b orders z=1, a=2, b=3


def test_choices_are_distinct(spark):
    df = evals(spark, [row("m1", "1", "x", "gbm", "web", 0.5, "{}"),
                       row("m2", "2", "x", "gbm", "app", 0.4, "{}")])
    got = sorted((r.field, r.value) for r in models.comparison_choices(df).collect())
    assert got == [("client", "x"), ("platform", "app"), ("platform", "web"), ("type", "gbm")]
