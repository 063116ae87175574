"""Scoring, evaluation, gradients (vs NumPy), hold-out and batches, MLP."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.expr import argmax, l2_normalize, one_hot, relu, sigmoid, softmax
from vigil.plans import learn

from .conftest import SF_SMALL


def emb(spark):
    return spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def test_array_functions(spark):
    r = spark.sql("select array(1.0D, 3.0D, 3.0D, 0.5D) a, 2 y, -1.5D x").select(
        softmax("a").alias("s"), argmax("a").alias("m"), one_hot("y", 4).alias("o"),
        l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
        sigmoid("x").alias("sg"), relu("x").alias("r")).collect()[0]
    assert sum(r.s) == pytest.approx(1.0)
    assert r.m == 1 and r.o == [0.0, 0.0, 1.0, 0.0] and r.n == [0.6, 0.8]
    assert r.sg == pytest.approx(1 / (1 + np.exp(1.5))) and r.r == 0.0


def test_scores_match_numpy(spark):
    df = emb(spark)
    model = learn.centroid_model(df)
    rows = sorted(model.collect(), key=lambda r: r["c"])
    w, b = np.array([r["w"] for r in rows]).T, np.array([r["b"] for r in rows])
    pdf = df.toPandas()
    x = np.stack(pdf.features.to_numpy()).astype(float)
    lg = x @ w + b
    pred = lg.argmax(axis=1)
    got = learn.score(df, model).toPandas().set_index("id").loc[pdf.id]
    assert (got.prediction.to_numpy() == pred).all()
    lse = lg.max(axis=1) + np.log(np.exp(lg - lg.max(axis=1, keepdims=True)).sum(axis=1))
    assert got.log_prob.to_numpy() == pytest.approx(lg[np.arange(len(x)), pdf.label] - lse)
    ev = learn.evaluate(learn.score(df, model)).collect()[0]
    assert ev.accuracy == pytest.approx((pred == pdf.label.to_numpy()).mean())
    assert ev.accuracy + ev.error_rate == pytest.approx(1.0)


def test_gradient_matches_numpy(spark):
    df = emb(spark)
    table = learn.rule_weights(spark, 64, 5, 10)
    got = {(r.param, r.i, r.j): r.value for r in learn.batch_gradient(df, table).collect()}
    wts = learn._matrices(table.toPandas())
    pdf = df.toPandas()
    x = np.stack(pdf.features.to_numpy()).astype(float)
    t = np.eye(10)[pdf.label.to_numpy()]
    z = np.tanh(x @ wts["W1"])
    a = z @ wts["W2"]
    y = np.exp(a - a.max(1, keepdims=True))
    y /= y.sum(1, keepdims=True)
    dz = ((t - y) @ wts["W2"].T) * (1 - z * z)
    assert got[("W2", 2, 3)] == pytest.approx((z.T @ (t - y))[2, 3])
    assert got[("W1", 7, 4)] == pytest.approx((x.T @ dz)[7, 4])
    assert got[("b1", 1, 0)] == pytest.approx(dz.sum(0)[1])
    assert got[("b2", 9, 0)] == pytest.approx((t - y).sum(0)[9])
    assert len(got) == 64 * 5 + 5 + 5 * 10 + 10


def test_holdout_is_the_sources_1000_last_rows(spark):
    from vigil.plans.catalog import HOLDOUT
    for rows in (1500, 500):   # a table of fewer rows is held out whole
        df = spark.range(rows)
        held = [r["id"] for r in df.where(learn.holdout_flag(df, "id", HOLDOUT)).collect()]
        assert sorted(held) == list(range(max(0, rows - 1000), rows))


def test_holdout_and_batches(spark):
    df = emb(spark)
    n = df.count()
    test = df.where(learn.holdout_flag(df, "id", 30))
    assert test.count() == 30
    assert test.agg(F.min("id")).collect()[0][0] == sorted(r.id for r in df.collect())[-30]
    b = learn.mini_batches(df, "id", 32)
    assert b.count() == (n // 32) * 32
    sizes = {r.batch: r.n for r in b.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {32}


def test_mlp_beats_chance(spark):
    df = emb(spark)
    model = learn.fit_mlp(df, 64, 16, 10, max_iter=200)
    pred = learn.mlp_predict(model, df)
    acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).collect()[0][0]
    assert acc > 0.2


def test_softmax_sums_to_one_and_argmax_is_the_max(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(0, 30, rng.integers(1, 12))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a array<double>")
    got = df.select("i", "a", softmax("a").alias("s"), argmax("a").alias("m")).collect()
    for r in got:
        assert sum(r.s) == pytest.approx(1.0)
        assert r.m == int(np.argmax(r.a))


def test_gradient_groups_do_not_change_the_sums(spark):
    df, table = emb(spark), learn.rule_weights(spark, 64, 5, 10)
    one = {(r.param, r.i, r.j): r.value for r in learn.gradient_and_cost(df, table).collect()}
    many = {(r.param, r.i, r.j): r.value for r in learn.gradient_and_cost(df, table, group_rows=37).collect()}
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v) for k, v in one.items())


def test_training_lowers_the_cost_and_stops(spark):
    df, start = emb(spark), learn.rule_weights(spark, 64, 5, 10)
    weights, costs = learn.train_network(df, start, 4, 0.01, l2=0.001)
    assert len(costs) == 4 and costs == sorted(costs, reverse=True)
    assert {(r.param, r.i, r.j) for r in weights.collect()} == {(r.param, r.i, r.j) for r in start.collect()}
    _, short = learn.train_network(df, start, 4, 0.01, tolerance=1.0)
    assert len(short) == 2
    nothing, free = learn.train_network(df.limit(0), start, 1, 0.01)
    assert free == [0.0] and {tuple(r) for r in nothing.collect()} == {tuple(r) for r in start.collect()}


def test_rows_without_a_usable_label_take_no_part(spark):
    start = learn.rule_weights(spark, 2, 2, 2)
    rows = [(1, [1.0, 0.5], 0), (2, [0.1, 2.0], 1)]
    odd = [(3, None, 1), (4, [1.0, 1.0], None), (5, [1.0, 1.0], 7), (6, [1.0, 1.0], -1)]
    schema = "id long, features array<double>, label int"
    a, b = ({(r.param, r.i, r.j): r.value for r in learn.gradient_and_cost(spark.createDataFrame(x, schema), start).collect()}
            for x in (rows, rows + odd))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v) for k, v in a.items())


def test_mini_batches_leave_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, 5 + i % 2, i) for i in range(10)], "id long, _row long, _part long")
    got = learn.mini_batches(df, "id", 5).collect()
    assert {(r["id"], r["_row"], r["_part"], r["batch"]) for r in got} == {(i, 5 + i % 2, i, i // 5) for i in range(10)}


# ------------------------------------------------------------------ word vectors

def test_word_vectors_follow_a_plain_version(spark):
    import math

    from vigil.plans import vectors
    pairs = [(0, 1), (1, 0), (1, 2), (2, 1), (1, 2), (3, 3), (0, 3), (3, 0)]
    vocab = spark.createDataFrame([(i,) for i in range(5)], "id long")
    dim, rate, negatives, n_ids = 3, 5.0, 2, 5
    got = {r.id: r.vector for r in vectors.word_vectors(
        spark.createDataFrame(pairs, "center int, context int"), vocab, dim, 2, negatives, rate).collect()}
    v = {i: [((i * 7919 + (k + 1) * 104729) % 10007) / 10007 * 2 - 1 for k in range(dim)] for i in range(5)}
    u = {i: [(((i * 104729 + (k + 1) * 7919) % 10007) / 10007 * 2 - 1) / math.sqrt(dim) for k in range(dim)] for i in range(5)}
    b = dict.fromkeys(range(5), 0.0)

    def drawn(c, t, j, step):
        h = (c * 40503 + t * 30011 + j * 20021 + step * 10007 + 1) % vectors.PRIME
        for _ in range(3):
            h = h * vectors.FACTOR % vectors.PRIME
        return max(0, min(n_ids - 1, math.floor(math.exp(h / vectors.PRIME * math.log(n_ids + 1))) - 1))
    for step in range(2):
        rows = [(c, t, 1.0) for c, t in pairs] + [(c, drawn(c, t, j, step), 0.0) for c, t in pairs for j in range(negatives)]
        dv, du, db = ({i: [0.0] * dim for i in range(5)} for _ in range(2)), None, dict.fromkeys(range(5), 0.0)
        dv, du = list(dv)
        for c, t, y in rows:
            s = sum(x * z for x, z in zip(v[c], u[t])) + b[t] - math.log(
                negatives * math.log((t + 2) / (t + 1)) / math.log(n_ids + 1))
            g = (y - 1 / (1 + math.exp(-s))) / len(pairs)
            dv[c] = [a + g * x for a, x in zip(dv[c], u[t])]
            du[t] = [a + g * x for a, x in zip(du[t], v[c])]
            db[t] += g
        for i in range(5):
            v[i] = [a + rate * x for a, x in zip(v[i], dv[i])]
            u[i] = [a + rate * x for a, x in zip(u[i], du[i])]
            b[i] += rate * db[i]
    for i in range(5):
        norm = math.sqrt(sum(x * x for x in v[i]))
        assert got[i] == pytest.approx([x / norm for x in v[i]])


def test_word_vectors_do_not_depend_on_the_grid(spark, monkeypatch):
    """Pairs meet parameters in the cells of a grid, and no table of pairs is joined."""
    from vigil.plans import vectors
    pairs = spark.createDataFrame([(i % 7, i * i % 11) for i in range(60)], "center int, context int")
    vocab = spark.createDataFrame([(i,) for i in range(11)], "id long")
    one = {r.id: r.vector for r in vectors.word_vectors(pairs, vocab, 3, 2, 2, 5.0).collect()}
    monkeypatch.setattr(vectors, "CELL_ROWS", 5)
    assert vectors.cells(120) == 5
    grid = {r.id: r.vector for r in vectors.word_vectors(pairs, vocab, 3, 2, 2, 5.0).collect()}
    assert grid.keys() == one.keys() == set(range(11)) and all(grid[i] == pytest.approx(one[i]) for i in one)
    emb, out = vectors.first_vectors(vocab, 3)
    rows = pairs.selectExpr("cast(center as long) center", "cast(context as long) target", "1.0D y", "0.0D e", "1.0D w")
    assert "Join" not in vectors.gradients(rows, emb, out, 3, 5)._jdf.queryExecution().executedPlan().toString()


def test_a_step_works_through_its_grid_in_passes(spark, monkeypatch):
    """Column by column of the grid, in pieces of a few rows: the same vectors, and no copy of a parameter beyond the pass."""
    from vigil.plans import vectors
    pairs = spark.createDataFrame([(i % 7, i * i % 11) for i in range(60)], "center int, context int")
    vocab = spark.createDataFrame([(i,) for i in range(11)], "id long")
    one = {r.id: r.vector for r in vectors.word_vectors(pairs, vocab, 3, 2, 2, 5.0).collect()}
    for name, n in (("CELL_ROWS", 20), ("PASS_CELLS", 1), ("PIECE_ROWS", 4), ("COUNT_ROWS", 7)):
        monkeypatch.setattr(vectors, name, n)
    assert vectors.cells(180) == 3
    passes = {r.id: r.vector for r in vectors.word_vectors(pairs, vocab, 3, 2, 2, 5.0).collect()}
    assert passes.keys() == one.keys() and all(passes[i] == pytest.approx(one[i]) for i in one)
    emb, out = vectors.first_vectors(vocab, 3)
    copies = vectors._parameters(emb, out, 3, 3, range(1, 2)).groupBy("side").count().collect()
    own = vocab.where(vectors._id_block(F.col("id"), 3) == 1).count()
    assert {r["side"]: r["count"] for r in copies} == {0: 11, 1: 3 * own}
    rows = vectors._rows(vectors._piece(*[np.array(x) for x in ([1, 1, 2 ** 31 - 1], [0, 2 ** 31 - 1, 5], [3, 2, 7])]))
    assert [list(x) for x in rows] == [[1, 1, 2 ** 31 - 1], [0, 2 ** 31 - 1, 5], [3, 2, 7]]


def test_document_means_follow_a_plain_version(spark, monkeypatch):
    """Blocks of documents, an id with two vectors, null components, documents without an id; no wide map of documents."""
    from vigil.plans import vectors
    monkeypatch.setattr(vectors, "MEAN_ROWS", 4)
    ids = spark.createDataFrame([(i % 6 or None, i * i % 9) for i in range(50)] + [(50, 99)], "doc_id long, id long")
    v = spark.createDataFrame([(i, [float(i), None if i % 3 == 0 else i / 2]) for i in range(9)] + [(4, [1.0, 2.0]), (1, None)],
                              "id long, v array<double>")
    means = vectors.document_means(ids, v, 2)
    want = ids.join(v, "id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array(
        *[F.avg(F.get("v", F.lit(k))) for k in range(2)]).alias("m"))
    got, plain = ({r.doc_id: (r.n, r.m) for r in f.collect()} for f in (means, want))
    assert got.keys() == plain.keys() and 50 not in got
    for k, (n, m) in plain.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(m)


def test_vectors_travel_as_stored_to_few_large_blocks(spark, monkeypatch):
    """Floats stay floats on their way, a block takes an id's vector once, rows of one document (or of none) are one mean."""
    from vigil.plans import vectors
    monkeypatch.setattr(vectors, "MEAN_CHUNK", 3)
    rows = [(i % 4 or None, [i % 5, 0, i % 3, 77]) for i in range(12)] + [(9, [77, 78]), (10, []), (11, None)]
    d = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    v = spark.createDataFrame([(i, [i / 8, float(-i)]) for i in range(5)], "id long, v array<float>")
    got = vectors.means_of_documents(d, v, 2)
    assert "double" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k, ids in rows:
        for i in ids or []:
            if i < 5:
                want.setdefault(k, []).append(i)
    found = {r.doc_id: (r.n, r.m) for r in got.collect()}
    assert found.keys() == want.keys()
    for k, ids in want.items():
        assert found[k][0] == len(ids) and found[k][1] == pytest.approx([sum(ids) / 8 / len(ids), -sum(ids) / len(ids)])
