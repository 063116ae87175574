"""Classifier scoring and evaluation, full-batch gradients, MLP training.

Features are ``array<double>`` rows. Weights are tables: a row for each class of a linear model, a row
for each number (param, i, j, value) of a network. Rows meet them over buckets, an equi-join that the planner
broadcasts while the weights are small and shuffles beyond; neither data nor weights pass the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import argmax, dot, softmax
from ..operators.materialize import materialize
from ..operators.rownumber import fresh

BUCKETS = 64          # buckets over which scored rows meet a model
GROUP_ROWS = 4096     # rows of a gradient task's group, about
NETWORK = "param string, i int, j int, value double"


def _vec(c) -> F.Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def _with_model(df: DataFrame, model: DataFrame, out: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the whole of a one-row ``model`` in every row, by an equi-join on a bucket."""
    b = fresh([*df.columns, out], "bucket")
    copies = model.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return df.withColumn(b, F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")).join(copies, b).drop(b)


# ------------------------------------------------------------------ fit

def class_centroids(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label, centroid): element-wise mean feature vector per class (an
    aggregate of (label, index) partial sums; no row leaves its task)."""
    ex = df.select(label, F.posexplode(_vec(features)).alias("i", "x"))
    per = ex.groupBy(label, "i").agg(F.avg("x").alias("m"))
    return per.groupBy(label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
        .alias("centroid"))


def centroid_model(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(c, w, b): a row for each class of the nearest-centroid classifier, logit_c = x . w + b with w the
    class's mean and b = -|w|^2 / 2."""
    return class_centroids(df, features, label).select(
        F.col(label).alias("c"), F.col("centroid").alias("w"), (-0.5 * dot("centroid", "centroid")).alias("b"))


# ------------------------------------------------------------------ M22

def score(df: DataFrame, model: DataFrame, features: str = "features",
          label: str = "label", key: str = "id") -> DataFrame:
    """(key, label, classes, logits, probability, prediction, log_prob) by a linear ``model`` (c, w, b): one dot product
    per class, JVM-side. ``classes`` names the places of the arrays; a label that no class has gets no log_prob."""
    whole = model.agg(F.array_sort(F.collect_list(F.struct("c", "w", "b"))).alias("_model"))
    met = _with_model(df.select(key, label, _vec(features).alias("_x")), whole, "_model")
    s = met.select(key, label, F.col("_model.c").alias("classes"),
                   F.transform("_model", lambda m: dot(F.col("_x"), m["w"]) + m["b"]).alias("logits"))
    lg = F.col("logits")
    m = F.array_max(lg)
    lse = m + F.ln(F.aggregate(lg, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    own = F.array_position("classes", F.col(label)) - 1
    return s.select(
        key, label, "classes", "logits",
        softmax(lg).alias("probability"),
        F.get("classes", argmax(lg)).alias("prediction"),
        (F.get(lg, own.cast("int")) - lse).alias("log_prob"))


def evaluate(pred: DataFrame, label: str = "label") -> DataFrame:
    """n, accuracy, error rate, log-likelihood (sum of ln p[label]) and mean
    cross-entropy (its negative mean)."""
    hit = (F.col(label) == F.col("prediction")).cast("double")
    return pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        (1 - F.avg(hit)).alias("error_rate"),
        F.sum("log_prob").alias("log_likelihood"),
        (-F.avg("log_prob")).alias("cross_entropy"))


def holdout_flag(df: DataFrame, key: str, last: int) -> F.Column:
    """True for the ``last`` rows by ``key`` (the ordered hold-out split).

    The cut is the smallest key of the top ``last`` keys: a distributed
    top-k (each task keeps ``last`` keys), used as a scalar subquery.
    """
    cut = df.select(key).orderBy(F.desc(key)).limit(last).select(F.min(key)).scalar()
    return F.col(key) >= cut


def mini_batches(df: DataFrame, key: str, batch: int) -> DataFrame:
    """Batch number floor(row / batch) in ``key`` order; the incomplete last
    batch is dropped."""
    from ..operators.rownumber import number_rows
    row = fresh([*df.columns, "batch"], "_row")
    numbered = number_rows(df, [F.asc_nulls_first(key)], out=row)
    n = df.select(F.count(F.lit(1))).scalar()
    full = F.floor(n / batch)
    return (numbered.withColumn("batch", F.floor(F.col(row) / batch))
            .where(F.col("batch") < full).drop(row))


# ------------------------------------------------------------------ M23

def rule_weights(spark: SparkSession, d: int, m: int, k: int) -> DataFrame:
    """(param, i, j, value): deterministic small weights for a d-m-k network (a fixed rule, so
    two engines can rebuild them)."""
    def table(param: str, rows: int, columns: int, value: str) -> DataFrame:
        return spark.range(rows * columns).select(
            F.lit(param).alias("param"), F.expr(f"cast(id div {columns} as int)").alias("i"),
            F.expr(f"cast(id % {columns} as int)").alias("j")).withColumn("value", F.expr(value))
    return (table("W1", d, m, "((i * 7 + j * 3) % 11 - 5) / 50.0D").union(table("b1", m, 1, "0.0D"))
            .union(table("W2", m, k, "((i * 5 + j * 3) % 7 - 3) / 20.0D")).union(table("b2", k, 1, "0.0D")))


def _matrices(weights: "pd.DataFrame") -> dict[str, np.ndarray]:
    out = {}
    for name, rows in weights.groupby("param"):
        m = np.zeros((int(rows["i"].max()) + 1, int(rows["j"].max()) + 1))
        m[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["value"].to_numpy()
        out[name] = m[:, 0] if name in ("b1", "b2") else m
    return out


def gradient_and_cost(df: DataFrame, weights: DataFrame, features: str = "features", label: str = "label",
                      tanh_derivative: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(param, i, j, value): full-batch gradient sums of the log-likelihood of a tanh-softmax net, and the row
    ('cost', 0, 0, its negative log-likelihood).

    dW2 = Z'(T - Y), db2 = sum(T - Y), dZ = (T - Y) W2' * Z', dW1 = X' dZ,
    db1 = sum(dZ), with Z' = 1 - Z^2 (``tanh_derivative``) or Z (1 - Z). Rows are dealt to groups of a
    bounded size, and the weights to each group; a group multiplies with NumPy and emits partial
    sums only, so the shuffle behind carries (param, i, j) partials, not rows. Rows with a null label or vector, or a label
    outside the net's classes, take no part.
    """
    rows = df.select(_vec(features).alias("x"), F.col(label).cast("int").alias("y")).where("x is not null and y is not null")
    groups = max(1, -(-rows.count() // group_rows))
    data = rows.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    copies = weights.select("param", "i", "j", "value").withColumn("group", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def part(pdf, wdf):
        import pandas as pd
        if pdf.empty or wdf.empty:
            return pd.DataFrame({"param": [], "i": [], "j": [], "value": []}).astype(
                {"param": object, "i": "int32", "j": "int32", "value": float})
        w = _matrices(wdf)
        k = len(w["b2"])
        y0 = pdf["y"].to_numpy()
        pdf = pdf[(y0 >= 0) & (y0 < k)]
        x, label_of = np.array(pdf["x"].tolist(), float).reshape(len(pdf), w["W1"].shape[0]), pdf["y"].to_numpy()
        z = np.tanh(x @ w["W1"] + w["b1"])
        a = z @ w["W2"] + w["b2"]
        a -= a.max(axis=1, keepdims=True, initial=-np.inf)
        y = np.exp(a)
        total = y.sum(axis=1, keepdims=True)
        diff = np.eye(k)[label_of] - y / total
        dz = (diff @ w["W2"].T) * ((1 - z * z) if tanh_derivative else z * (1 - z))
        cost = (np.log(total[:, 0]) - a[np.arange(len(a)), label_of]).sum()
        out = []
        for name, mat in {"W2": z.T @ diff, "b2": diff.sum(axis=0), "W1": x.T @ dz, "b1": dz.sum(axis=0),
                          "cost": np.array([cost])}.items():
            m2 = mat.reshape(mat.shape[0], -1)
            ii, jj = np.meshgrid(np.arange(m2.shape[0]), np.arange(m2.shape[1]), indexing="ij")
            out.append(pd.DataFrame({"param": name, "i": ii.ravel().astype("int32"),
                                     "j": jj.ravel().astype("int32"), "value": m2.ravel()}))
        return pd.concat(out, ignore_index=True)

    return (data.groupBy("group").cogroup(copies.groupBy("group")).applyInPandas(part, NETWORK)
            .groupBy("param", "i", "j").agg(F.sum("value").alias("value")))


def batch_gradient(df: DataFrame, weights: DataFrame, features: str = "features", label: str = "label",
                   tanh_derivative: bool = True) -> DataFrame:
    """The gradient sums alone."""
    return gradient_and_cost(df, weights, features, label, tanh_derivative).where("param <> 'cost'")


def train_network(df: DataFrame, weights: DataFrame, steps: int, rate: float, l2: float = 0.0, tolerance: float = 0.0,
                  features: str = "features", label: str = "label") -> tuple[DataFrame, list[float]]:
    """(weights, costs) after full-batch steps from ``weights`` (param, i, j, value).

    A step adds rate * (gradient of the log-likelihood - 2 * l2 * weight); the cost (A23) is the negative log-likelihood
    plus l2 times the sum of squared weights, before the step. Steps end early once the cost changes by no more than
    ``tolerance`` of itself. Weights are checkpointed each round, so a lost executor costs one round at most; one
    number a round reaches the driver. A table without a usable row leaves the weights as they are.
    """
    rows = materialize(df.select(features, label))
    now, costs = materialize(weights.select("param", "i", "j", "value")), []
    for _ in range(steps):
        found = materialize(gradient_and_cost(rows, now, features, label))
        squares = now.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
        cost = (found.where("param = 'cost'").agg(F.sum("value")).first()[0] or 0.0) + l2 * squares
        costs.append(cost)
        step = found.select("param", "i", "j", F.col("value").alias("gradient"))
        now = materialize(now.join(step, ["param", "i", "j"], "left").select(
            "param", "i", "j", (F.col("value") + rate * (F.coalesce("gradient", F.lit(0.0)) - 2 * l2 * F.col("value"))).alias("value")))
        if len(costs) > 1 and abs(costs[-2] - cost) <= tolerance * abs(cost):
            break
    return now, costs


# ------------------------------------------------------------------ M21

def fit_mlp(train: DataFrame, d: int, hidden: int, k: int, features: str = "features",
            label: str = "label", max_iter: int = 100, seed: int = 7):
    """Spark ML multilayer perceptron (sigmoid hidden layer, softmax out)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    data = train.select(array_to_vector(_vec(features)).alias("features"),
                        F.col(label).cast("double").alias("label"))
    mlp = MultilayerPerceptronClassifier(layers=[d, hidden, k], maxIter=max_iter, seed=seed,
                                         featuresCol="features", labelCol="label")
    return mlp.fit(data)


def mlp_predict(model, df: DataFrame, features: str = "features", label: str = "label",
                key: str = "id") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    data = df.select(key, F.col(label).cast("int").alias(label),
                     array_to_vector(_vec(features)).alias("features"))
    out = model.transform(data)
    return out.select(key, label, F.col("prediction").cast("int").alias("prediction"))



def standardize(df: DataFrame, features: str = "features") -> DataFrame:
    """Per-feature mean/variance scaling (Spark ML StandardScaler)."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    data = df.withColumn("_v", array_to_vector(_vec(features)))
    model = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(data)
    return model.transform(data).withColumn(features, vector_to_array("_s")).drop("_v", "_s")
