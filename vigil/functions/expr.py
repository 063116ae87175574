"""Scalar expression helpers (all JVM-side, codegen-friendly).

Float rules (Q3 of the design notes): the source frames are pandas-like,
where x/0 is +-inf and 0/0 is NaN. Spark runs ANSI, so a bare ``a / b``
raises on a zero divisor. ``ratio`` spells the rule out as a CASE that
never raises: x/0 gives +-inf, 0/0 and null operands give NULL. NaN never
enters a frame: anything that could become NaN is turned into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """``a / b`` with float rules and no ANSI error.

    null operand -> NULL; b != 0 -> a / b; a > 0 -> +inf; a < 0 -> -inf;
    0 / 0 -> NULL.
    """
    a, b = col(a), col(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b != 0, a.cast("double") / b.cast("double"))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
        .otherwise(F.lit(None).cast("double"))
    )


def ratio_or_zero(a, b) -> Column:
    """``ratio`` whose NULL (0/0 or a null operand) becomes 0; inf stays."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def nan_to_null(c) -> Column:
    """NaN -> NULL (Spark keeps NaN apart from NULL; the frames never hold NaN)."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def half_even(c, places: int) -> Column:
    """Round half to even (pandas/NumPy rounding); ``F.round`` is half-up."""
    return F.bround(col(c), places)


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def relu(c) -> Column:
    return F.greatest(col(c), F.lit(0.0))


# ---------------------------------------------------------------- arrays

def softmax(arr) -> Column:
    """Softmax of a numeric array, shifted by its max for stability."""
    a = col(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax(arr) -> Column:
    """0-based index of the first maximum of an array."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(label, k: int) -> Column:
    """Indicator vector of length ``k`` with a 1.0 at ``label``."""
    y = col(label)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.when(i == y, 1.0).otherwise(0.0))


def l2_norm(arr) -> Column:
    a = col(arr)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(arr) -> Column:
    """Unit vector; an all-zero vector stays zero (no NaN)."""
    a = col(arr)
    n = l2_norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)
