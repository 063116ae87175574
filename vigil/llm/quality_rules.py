"""Quality rules with risk-controlled thresholds.

Every document gets counts of its words, symbols, repeated lines and repeated
words. Rules on four signals are tightened level by level; per stratum (language)
the labelled documents, which serve only as a holdout, decide how far: a level
holds while an exact binomial bound on its false-rejection rate stays under
``max_false_rejection``. Levels of a stratum are tested in a fixed order up to the
first failure, and the error level is split over the strata, so with
probability ``1 - error`` no stratum loses more than that share of good documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, texts_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
STRATA = ("en", "fr", "de", "es")   # any other language, or none, is the stratum "other"
MAX_FALSE_REJECTION = 0.05
ERROR = 0.05

#: Cutoffs by level, lenient first; a level rejects what exceeds any of its four.
LEVELS = {
    "symbols_per_word": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "upper_share": (0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
}
N_LEVELS = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_letters")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:   # keep the product of the next step inside 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """The columns of ``COUNTS`` of a whole UTF-8 text."""
    words = text.split()   # bytes split at space and 0x09-0x0D only
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_space = len(text) - len(text.translate(None, ASCII_SPACE))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    code_points = int((np.frombuffer(text, np.int8) >= -64).sum())   # bytes that start one
    return (len(words), code_points - n_space,
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), upper, upper + lower)


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, *COUNTS) of every row; a null text has no words."""
    kinds = [pa.int64(), pa.string()] + [pa.int64()] * len(COUNTS)
    names = ["doc_id", "lang", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_text(t) for t in texts_of(batch.column(2))]
            cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kinds[0]), batch.column(1).cast(kinds[1]),
                 *[pa.array(c, pa.int64()) for c in cols]], names)

    return docs.select(docs["doc_id"].cast("long"), docs["lang"].cast("string"),
                       docs["text"]).mapInArrow(run, ", ".join(
                           f"{n} {'string' if n == 'lang' else 'long'}" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def signals() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols_per_word": share("n_symbols", "n_words"),
            "upper_share": share("n_upper", "n_letters"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words")}


def first_level() -> Column:
    """The most lenient level that rejects the row, or ``N_LEVELS`` if none does.

    Cutoffs fall with the level, so a row rejected at one level is rejected at every later one.
    """
    levels = []
    for t in reversed(range(N_LEVELS)):
        over = [s > LEVELS[name][t] for name, s in signals().items()]
        levels.append((t, over[0] | over[1] | over[2] | over[3]))
    out = F.lit(N_LEVELS)
    for t, hit in levels:
        out = F.when(hit, F.lit(t)).otherwise(out)
    return out


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise(F.lit("other"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    out = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the incomplete beta function I_{1-p}(n - k, k + 1)."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate, k of n seen."""
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > error else (low, mid)
    return high


def certified_levels(good: dict[tuple[str, int], int], max_false_rejection: float = MAX_FALSE_REJECTION,
                     error: float = ERROR) -> dict[str, int]:
    """Per stratum the strictest level whose bound holds, -1 for none.

    ``good``: labelled good documents by (stratum, first rejecting level).
    """
    strata = (*STRATA, "other")
    out = {}
    for s in strata:
        n = sum(good.get((s, t), 0) for t in range(N_LEVELS + 1))
        out[s], rejected = -1, 0
        for t in range(N_LEVELS):
            rejected += good.get((s, t), 0)
            if not n or binomial_cdf(rejected, n, max_false_rejection) > error / len(strata):
                break
            out[s] = t
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION,
                error: float = ERROR) -> DataFrame:
    """(doc_id, counts, base_failed, kept, stratum, level, certified) of every row of ``docs``.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality (1 good). Labels count once
    per document, which is good if none of its labels says otherwise; null ids and null
    qualities are left out. Documents failing the base rules are not part of the
    holdout. Without enough labels a stratum has no threshold and keeps what passes the
    base rules. Null texts have no words and fail the base; very long texts are counted whole; repeated rows are judged each;
    other columns are not read, whatever their names; an empty table gives no rows. Counts are made once and checkpointed; only
    (stratum, level) counts, at most 45 rows, reach the driver.
    """
    from ..operators.materialize import materialize
    counted = materialize(text_counts(docs).withColumns(
        {"base_failed": base_failed(), "stratum": stratum(), "level": first_level()}).drop("lang"))
    good = (labels.where("doc_id is not null and quality is not null")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1"))
    holdout = (counted.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
               .groupBy("stratum", "level").count())
    seen = {(r["stratum"], r["level"]): r["count"] for r in holdout.collect()}
    levels = certified_levels(seen, max_false_rejection, error)
    certified = F.lit(-1)
    for s, t in levels.items():
        certified = F.when(F.col("stratum") == s, F.lit(t)).otherwise(certified)
    return (counted.withColumn("certified", certified)
            .withColumn("kept", ~F.col("base_failed") & (F.col("level") > F.col("certified"))))
