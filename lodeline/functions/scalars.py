"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    """Not NULL, not NaN, not infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def signed_log_inverse(c: Column) -> Column:
    return F.signum(c) * (F.exp(F.abs(c)) - 1.0)


def clip(c: Column, lower: Column | float, upper: Column | float) -> Column:
    """Bound a value; NULL and NaN pass through unchanged."""
    lower, upper = (b if isinstance(b, Column) else F.lit(float(b)) for b in (lower, upper))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(lower, F.least(upper, c)))


def safe_divide(a: Column, b: Column, otherwise: float | None = None) -> Column:
    q = F.try_divide(a, b)
    return q if otherwise is None else F.coalesce(q, F.lit(otherwise))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL when either side is constant."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx = F.stddev_pop(F.when(pair, F.col(x)))
    sy = F.stddev_pop(F.when(pair, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def rmse_of(y_true: Column, y_pred: Column) -> Column:
    """Root mean squared error as an aggregate."""
    e = y_true - y_pred
    return F.sqrt(F.avg(e * e))


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def round_of_many(name: str, digits: int = 6) -> Column:
    """The same as ``round``, for rows of many columns.

    Most values need no decimal arithmetic: a whole number of units divided by their count is the nearest double. Only values
    about half way between two, very large ones, and what is no finite number go the exact way. The JVM does not compile methods
    of more than 8,000 bytes, and a stage in one method gets there with some dozens of columns; a lambda makes Spark evaluate
    them in methods of their own.
    """
    x, units = F.col(name), 10.0**digits
    y = x * units
    whole = F.rint(y)
    clear = (F.abs(y) < 1e14) & (F.abs(y - whole) < 0.5 - F.abs(y) * 1e-15 - 1e-9)
    exact = F.transform(F.array(x), lambda v: F.round(v, digits))[0]
    # Adding 0 turns -0.0 into 0.0.
    return F.when(clear, whole / units + 0.0).when(x.isNotNull(), exact)
