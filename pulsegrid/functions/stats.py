"""ANSI-safe statistical expressions, as aggregates or over a window."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F


def _on(col: Column, w: WindowSpec | None) -> Column:
    return col if w is None else col.over(w)


def positive_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null unless ``b`` is above zero."""
    return F.when(b > 0, a / b)


def safe_corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation; null, not an error, when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    spread = F.sqrt(_on(F.var_pop(xs), w) * _on(F.var_pop(ys), w))
    return F.try_divide(_on(F.covar_pop(xs, ys), w), spread)


def sample_skew(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness; needs three values and some spread."""
    n = _on(F.count(x), w).cast("double")
    ok = (n >= 3) & (_on(F.stddev_pop(x), w) > 1e-9)
    return F.when(ok, _on(F.skewness(x), w) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis; needs four values and some spread."""
    n = _on(F.count(x), w).cast("double")
    ok = (n >= 4) & (_on(F.stddev_pop(x), w) > 1e-9)
    scaled = ((n + 1) * _on(F.kurtosis(x), w) + 6) * (n - 1)
    return F.when(ok, scaled / ((n - 2) * (n - 3)))


def finite(x: Column) -> Column:
    """Infinite and NaN values become null."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~bad, x)
