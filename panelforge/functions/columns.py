"""Column helpers for panels in long form, one row a (date, symbol)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ts() -> WindowSpec:
    """A symbol's sessions in order."""
    return W.partitionBy("symbol").orderBy("date")


def xs() -> WindowSpec:
    """The symbols of a session."""
    return W.partitionBy("date")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null, the only form of a missing value."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def divided(a: str | Column, b: str | Column) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def pct_rank(c: str | Column, *partition: str) -> Column:
    """Average-tie percentile rank within ``partition`` (dates by default); nulls have none and don't count."""
    c, keys = col(c), list(partition or ("date",))
    place = F.rank().over(W.partitionBy(*keys).orderBy(c.asc_nulls_last())) + (F.count(c).over(W.partitionBy(*keys, c)) - 1) / 2
    return F.when(c.isNotNull(), place / F.count(c).over(W.partitionBy(*keys)))


def rows(k: int, over: WindowSpec | None = None) -> WindowSpec:
    """The last k sessions, this one included."""
    return (over or ts()).rowsBetween(-(k - 1), 0)


_AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "skew": lambda c: corrected_skew(F.skewness(c), F.count(c)),
}
ROLLING = frozenset(_AGGREGATES) - {"skew"}


def rolling(aggregate: str, c: str | Column, window: int, least: int | None = None, over: WindowSpec | None = None) -> Column:
    """A trailing aggregate that needs ``least`` values, max(2, window // 2) by default."""
    c, least = col(c), max(2, window // 2) if least is None else least
    if aggregate == "skew":
        w = rows(window, over)
        return F.when(F.count(c).over(w) >= least, corrected_skew(F.skewness(c).over(w), F.count(c).over(w)))
    return F.when(F.count(c).over(rows(window, over)) >= least, _AGGREGATES[aggregate](c).over(rows(window, over)))


def zscore(c: str | Column, window: int) -> Column:
    return (col(c) - rolling("mean", c, window)) / F.nullif(rolling("std", c, window), F.lit(0.0))


def _joint(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def rolling_corr(x: str | Column, y: str | Column, window: int, least: int | None = None, over: WindowSpec | None = None) -> Column:
    """Trailing correlation of complete pairs; a full window of them by default. Constant input gives null, not an error."""
    x, y = _joint(col(x), col(y))
    w = rows(window, over)
    value = divided(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))
    return F.when(F.count(x).over(w) >= (window if least is None else least), value)


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of complete pairs as an aggregate."""
    x, y = _joint(col(x), col(y))
    return divided(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def corrected_skew(g1: Column, n: Column) -> Column:
    """Sample skewness from the population's."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population's."""
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def quintile(c: str | Column, *partition: str) -> Column:
    """Fifths of the order of ``c`` (ties by symbol), cut as quantiles of the places; 0 to 4."""
    keys = list(partition or ("date",))
    c = col(c)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(c.asc_nulls_last(), "symbol"))
    n = F.count(c).over(W.partitionBy(*keys))
    cut = F.greatest(F.ceil((place - 1) * 5 / F.nullif(n - 1, F.lit(0))), F.lit(1)) - 1
    return F.when(c.isNotNull(), F.coalesce(cut, F.lit(0)).cast("int"))


def cross_z(c: str | Column) -> Column:
    """Cross-sectional z-score, cut at 5 either way."""
    c = col(c)
    z = (c - F.avg(c).over(xs())) / F.nullif(F.stddev_samp(c).over(xs()), F.lit(0.0))
    return F.when(z.isNotNull(), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)))
