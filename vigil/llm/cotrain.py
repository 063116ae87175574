"""Quality classifier by co-training of two views.

The content view sees what the text says (its letters in pairs, how many of its
words are distinct); the metadata view sees the page around it (language, source,
length, lines, kinds of characters, word lengths). Each is a logistic
regression. In rounds, each labels the documents it is sure of for the other: every unlabelled document
is scored in its partition, and Newton steps add up gradients and Hessians there. Both are
calibrated on labelled documents held out from training, and their
calibrated log-odds are combined into one score for every document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import scratch_path
from .common import texts_of

MAX_LABELLED = 6000      # labelled documents that the classifiers are fitted on, at most
HELD_OUT = 4             # one labelled document of so many is kept for calibration
ROUNDS = 3
SURE = 0.95              # calibrated confidence from which a view labels for the other
PER_ROUND = 0.2          # share of the unlabelled documents a view may label in a round, the surest
STEPS = 200              # the surest are told apart by their log-odds in steps of 1 / STEPS
MAX_ODDS = 12
FEW_PARTS = 64           # partial sums beyond are added up in groups before they reach the driver
CUT = 0.5                # documents scored below are rejected
SEED = 9
RIDGE = 1.0

N_PAIRS = 128
N_CONTENT = N_PAIRS + 2
LANGS = ("en", "fr", "de", "es")
N_SOURCE = 16
N_CLASSES = 7
N_META = N_CLASSES + 6 + len(LANGS) + N_SOURCE

# 0 white space, 1 line feed, 2 a-z, 3 A-Z, 4 digit, 5 other ASCII, 6 beyond
_CLASS = np.array([1 if b == 10 else 0 if b <= 32 else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90
                   else 4 if 48 <= b <= 57 else 5 if b < 128 else 6 for b in range(256)], np.uint8)


def features(text: bytes, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The content and the metadata view of a whole UTF-8 text; an empty text has zeros but for its page."""
    content, meta = np.zeros(N_CONTENT, np.float32), np.zeros(N_META, np.float32)
    if text:
        raw = np.frombuffer(text, np.uint8)
        pair = (raw[:-1].astype(np.uint32) * 31 + raw[1:]) * np.uint32(2654435761) >> np.uint32(25)
        content[:N_PAIRS] = np.sqrt(np.bincount(pair, minlength=N_PAIRS) / len(raw))
        words = text.split()
        n = max(1, len(words))
        distinct = len(set(words))
        content[N_PAIRS:] = distinct / n, math.log1p(n / max(1, distinct))
        kind = _CLASS[raw]
        meta[:N_CLASSES] = np.bincount(kind, minlength=N_CLASSES) / len(raw)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], kind < 2, [True]])))
        lengths = edge[1::2] - edge[::2]
        lines = text.split(b"\n")
        same = float((lengths[1:] == lengths[:-1]).mean()) if len(lengths) > 1 else 0.0
        meta[N_CLASSES:N_CLASSES + 6] = (
            math.log1p(len(raw)), math.log1p(len(lines)), math.log1p(len(raw) / len(lines)),
            len(set(lines)) / len(lines), float(lengths.mean()) / 10 if len(lengths) else 0.0, same)
    at = N_CLASSES + 6
    if lang in LANGS:
        meta[at + LANGS.index(lang)] = 1
    if source is not None:
        meta[at + len(LANGS) + sum(source.encode()) % N_SOURCE] = 1
    return content, meta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardized columns, by Newton steps."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> "Logistic":
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(float)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = sigmoid(z @ w)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
            w += move
            if np.abs(move).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]


@dataclass
class View:
    """A classifier and its calibration: P(good) = sigmoid(slope * logit + shift)."""
    model: Logistic
    slope: float
    shift: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.model.logit(x) + self.shift, -MAX_ODDS, MAX_ODDS)


def _calibrated(model: Logistic, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling on held-out documents, with his smoothed targets."""
    z = np.clip(model.logit(x), -50, 50)
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    fit = Logistic.fit(z[:, None], target, ridge=1e-3, steps=30)
    slope = fit.weights[0] / fit.scale[0]
    return View(model, float(slope), float(fit.weights[1] - slope * fit.mean[0]))


#: Features of a batch: the content and the metadata view, a row a document.
Pair = tuple[np.ndarray, np.ndarray]


@dataclass
class Round:
    """The views at a round's start and the step of log-odds from which each labels for the other."""
    views: tuple[View, View]
    cuts: tuple[int, int]

    def labels(self, x: Pair, v: int) -> np.ndarray:
        """What view ``v`` gives to the other: 1 or 0 where it is sure enough, else -1."""
        odds = self.views[v].log_odds(x[v])
        return np.where(_steps(odds) >= self.cuts[v], (odds >= 0).astype(float), -1.0)


def _steps(odds: np.ndarray) -> np.ndarray:
    """The confidence as a whole number; -1 if it is not sure."""
    size = np.abs(odds)
    return np.where(size >= math.log(SURE / (1 - SURE)), np.floor(size * STEPS), -1).astype(np.int64)


def given(x: Pair, past: list[Round]) -> Pair:
    """The pseudo-labels each view was given in ``past`` (-1: none); the first one stays."""
    out = np.full(len(x[0]), -1.0), np.full(len(x[0]), -1.0)
    for r in past:
        for v in (0, 1):
            out[1 - v][:] = np.where(out[1 - v] >= 0, out[1 - v], r.labels(x, v))
    return out


def unpacked(content: pa.Array, meta: pa.Array) -> Pair:
    return tuple(np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(-1, n).astype(float)
                 for c, n in ((content, N_CONTENT), (meta, N_META)))


def total(rows: DataFrame, part: Callable[[Pair], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all batches of ``rows`` (content, meta): a vector for each partition is all that moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = part((np.zeros((0, N_CONTENT)), np.zeros((0, N_META))))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                out = out + part(unpacked(some.column(0), some.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          pa.array([out.astype(float).tobytes()], pa.binary())], ["part", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        return pd.DataFrame({"part": group["part"].iloc[:1], "sums": [
            np.sum([np.frombuffer(s) for s in group["sums"]], axis=0).tobytes()]})

    sums, parts = rows.select("content", "meta").mapInArrow(run, "part long, sums binary"), rows.rdd.getNumPartitions()
    if parts > FEW_PARTS:
        sums = sums.groupBy(F.expr(f"part div {math.isqrt(parts)}")).applyInPandas(add, "part long, sums binary")
    found = sorted(sums.collect(), key=lambda r: r["part"])
    return np.sum([np.frombuffer(r["sums"]) for r in found], axis=0) if found else part(
        (np.zeros((0, N_CONTENT)), np.zeros((0, N_META))))


def _slope(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of a logistic regression, end to end."""
    t = z @ w
    p = sigmoid(t)
    return np.concatenate([[(np.logaddexp(0, t) - y * t).sum()], z.T @ (y - p),
                           ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def _columns(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([(x - mean) / scale, np.ones((len(x), 1))])


def fit_all(rows: DataFrame | None, past: list[Round], x: Pair, y: np.ndarray, models: list[Logistic],
            ridge: float = RIDGE, steps: int = 24, near: float = 1e-5) -> list[Logistic]:
    """Both views' regressions over the labelled rows and every pseudo-labelled row of ``rows``, from ``models`` on by
    Newton steps; a step that raises the loss is halved."""
    w, last = [m.weights for m in models], [(np.inf, m.weights) for m in models]
    sizes = [1 + len(v) + len(v) ** 2 for v in w]
    on = [True, True]
    for _ in range(steps):
        now = list(w)

        def part(b: Pair) -> np.ndarray:
            labels, out = given(b, past), []
            for u in (0, 1):
                some = labels[u] >= 0
                out.append(_slope(_columns(b[u][some], models[u].mean, models[u].scale), labels[u][some], now[u])
                           if on[u] else np.zeros(sizes[u]))
            return np.concatenate(out)

        both = total(rows, part) if rows is not None and past else np.zeros(sum(sizes))
        for u, sums in enumerate(np.split(both, [sizes[0]])):
            if not on[u]:
                continue
            d = len(w[u])
            sums = sums + _slope(_columns(x[u], models[u].mean, models[u].scale), y, w[u])
            penalty = np.full(d, ridge)
            penalty[-1] = 1e-3
            loss = sums[0] + (penalty * w[u] ** 2).sum() / 2
            if loss > last[u][0] + 1e-9 * abs(last[u][0]):
                w[u] = (w[u] + last[u][1]) / 2
                continue
            last[u] = loss, w[u]
            move = np.linalg.solve(sums[1 + d:].reshape(d, d) + np.diag(penalty), sums[1:1 + d] - penalty * w[u])
            w[u] = w[u] + move
            on[u] = bool(np.abs(move).max() >= near)
        if not any(on):
            break
    return [Logistic(m.mean, m.scale, v) for m, v in zip(models, w)]


def co_train(x: Pair, y: np.ndarray, held: Pair, y_held: np.ndarray, rows: DataFrame, rounds: int = ROUNDS
             ) -> tuple[tuple[View, View], list[Round]]:
    """Two views from labelled and held-out features and every unlabelled row of ``rows``; also what labelled them."""
    zero = [v.mean(axis=0) for v in x]
    moments = total(rows, lambda b: np.concatenate(
        [[len(b[0])], *[f(v - m) for v, m in zip(b, zero) for f in (lambda d: d.sum(axis=0), lambda d: (d ** 2).sum(axis=0))]]))
    free, n = int(moments[0]), moments[0] + len(y)
    models = []
    for v, m, at in zip(x, zero, (1, 1 + 2 * N_CONTENT)):
        once, twice = moments[at:at + v.shape[1]], moments[at + v.shape[1]:at + 2 * v.shape[1]]
        shift = (once + (v - m).sum(axis=0)) / n
        scale = np.sqrt(np.maximum((twice + ((v - m) ** 2).sum(axis=0)) / n - shift ** 2, 0))
        models.append(Logistic(m + shift, np.where(scale > 1e-7, scale, 1.0), np.zeros(v.shape[1] + 1)))
    past: list[Round] = []
    n_steps = MAX_ODDS * STEPS + 1

    def fit() -> tuple[View, View]:
        models[:] = fit_all(rows, past, x, y, models)
        return tuple(_calibrated(m, h, y_held) for m, h in zip(models, held))

    views = fit()
    for _ in range(rounds if free else 0):
        def counts(b: Pair) -> np.ndarray:
            labels, out = given(b, past), []
            for v in (0, 1):
                step = _steps(views[v].log_odds(b[v]))[labels[1 - v] < 0]
                out.append(np.bincount(step[step >= 0], minlength=n_steps))
            return np.concatenate(out).astype(float)

        cuts = []
        for found in np.split(total(rows, counts), 2):
            above = np.cumsum(found[::-1])[::-1]   # rows at a step or beyond
            fits = np.flatnonzero(above <= max(1, int(PER_ROUND * free)))
            # of equally sure rows none is preferred: if the surest step alone is more, it is taken whole
            cuts.append(int(min(fits.min() if len(fits) else n_steps, max(np.flatnonzero(found), default=n_steps))))
        past.append(Round(views, tuple(cuts)))
        views = fit()
    return views, past


def _marked(labels: DataFrame) -> DataFrame:
    """(id, y): labels of one document count as good if all are."""
    return labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("y"))


def with_features(docs: DataFrame) -> DataFrame:
    """(id, content, meta) of every row of ``docs`` (id, text, lang, source): both views as packed floats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [features(t, lang, source) for t, lang, source in zip(
                texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([c.tobytes() for c, _ in both], pa.binary()),
                 pa.array([m.tobytes() for _, m in both], pa.binary())], ["id", "content", "meta"])

    return docs.select("id", "text", "lang", "source").mapInArrow(run, "id long, content binary, meta binary")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("id"), docs["lang"].cast("string").alias("lang"),
                       docs["source"].cast("string").alias("source"), docs["text"].alias("text"))


def training_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, seed: int) -> pd.DataFrame:
    """Features of at most ``max_labelled`` labelled documents, those of the smallest seeded
    hashes. Ids are sampled before texts are read."""
    marked = _marked(labels)
    ids = docs.select(docs["doc_id"].cast("long").alias("id")).where("id is not null").distinct()
    draw = F.xxhash64(F.lit(seed), "id")
    # at most max_labelled rows: a bounded side
    some = F.broadcast(marked.join(ids, "id", "left_semi").orderBy(draw, "id").limit(max_labelled))
    found = with_features(_read(docs).join(some, "id", "left_semi"))
    # rows of one repeated id would be more than the sample's bound
    found = found.groupBy("id").agg(F.min("content").alias("content"), F.min("meta").alias("meta"))
    return found.join(some, "id").toPandas().sort_values("id", ignore_index=True)


def unlabelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(content, meta) of every row of ``docs`` without a label, rows without an id and repeated rows included;
    written once. Only features are shuffled, those without an id by their values."""
    marked = _marked(labels).select(F.lit(True).alias("has"), F.col("id").alias("marked"))
    rows = with_features(_read(docs)).withColumns(
        {"named": F.col("id").isNotNull(), "mark": F.coalesce("id", F.xxhash64("content", "meta"))})
    free = rows.join(marked, (F.col("named") == F.col("has")) & (F.col("mark") == F.col("marked")), "left_anti")
    path = scratch_path(docs.sparkSession, "unlabelled-features")
    free.select("content", "meta").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def fit_views(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED
              ) -> tuple[View, View] | None:
    """The two calibrated views; None if the labels do not show both classes in training and in the held-out part."""
    s = training_sample(docs, labels, max_labelled, seed)
    y = s["y"].to_numpy(float)
    held = np.arange(len(y)) % HELD_OUT == 0
    if min(len(set(y[~held])), len(set(y[held]))) < 2:
        return None
    x = unpacked(pa.array(s["content"], pa.binary()), pa.array(s["meta"], pa.binary()))
    views, _ = co_train(tuple(v[~held] for v in x), y[~held], tuple(v[held] for v in x), y[held],
                        unlabelled_rows(docs, labels))
    return views


def score_column(docs: DataFrame, views: tuple[View, View] | None) -> Column:
    """A struct (content, metadata, score) of P(good) for every row of ``docs``; without views all are null."""
    kind = "content double, metadata double, score double"
    if views is None:
        return F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")

    def score(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        odds = []
        for at in range(0, len(text), 512):
            both = [features((t or "").encode("utf-8", "replace"), a, b) for t, a, b in
                    zip(text[at:at + 512], lang[at:at + 512], source[at:at + 512])]
            odds.append([v.log_odds(np.array(x)) for v, x in zip(views, zip(*both))])
        c, m = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*odds) if odds else ((), ())))
        return pd.DataFrame({"content": sigmoid(c), "metadata": sigmoid(m), "score": sigmoid((c + m) / 2)})

    return F.pandas_udf(score, kind)(docs["text"], docs["lang"].cast("string"), docs["source"].cast("string"))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, kept) of every row of ``docs`` (doc_id, text, lang, source).

    ``score`` combines both calibrated views by the mean of their log-odds; ``kept`` if it is ``cut`` or more.
    Null texts are empty, null languages and sources are none; very long texts are read whole; repeated rows get equal scores;
    without enough labels scores are null and all rows are kept; other columns are not read, whatever their names; an empty
    table gives no rows.
    """
    s = docs.select("doc_id", score_column(docs, fit_views(docs, labels)).alias("s"))
    return s.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("s.content").alias("content_score"),
                    F.col("s.metadata").alias("metadata_score"), F.col("s.score").alias("score"),
                    F.coalesce(F.col("s.score") >= cut, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns as they are."""
    s = score_column(docs, fit_views(docs, labels))
    return docs.where(F.coalesce(s.getField("score") >= cut, F.lit(True)))
