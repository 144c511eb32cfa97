"""Books, tranches, turnover, costs and capacity; all over the dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import col, divided, pct_rank, rows, ts, xs

LEAST_NAMES = 10


def neutral_weights(panel: DataFrame, signal: str, size: str = "market_cap", group: str = "industry") -> DataFrame:
    """``desired``: the centred rank of the signal less what size and group explain, with gross weight 1.

    The residual of a regression on group dummies and size needs no solver: both sides are demeaned within the
    group, and the slope is one ratio of sums. Sessions with fewer than ten usable names get zeros.
    """
    rank = pct_rank(signal)
    out = panel.withColumn("_r", rank).withColumn("_y", F.col("_r") - F.avg("_r").over(xs()))
    usable = F.col("_y").isNotNull() & (F.col(size) > 0) & F.col(group).isNotNull() & F.col("buyable") & F.col("shortable")
    out = out.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    ok = F.col("_ok")
    cell = W.partitionBy("date", "_ok", group)
    out = out.withColumns({"_ly": F.when(ok, F.col("_y") - F.avg("_y").over(cell)), "_ls": F.when(ok, F.log(size) - F.avg(F.when(ok, F.log(F.nullif(F.abs(size), F.lit(0.0))))).over(cell))})
    slope = F.coalesce(F.when(F.sum(F.col("_ls") * F.col("_ls")).over(xs()) > 1e-18, F.sum(F.col("_ls") * F.col("_ly")).over(xs()) / F.nullif(F.sum(F.col("_ls") * F.col("_ls")).over(xs()), F.lit(0.0))), F.lit(0.0))
    out = out.withColumn("_res", F.col("_ly") - slope * F.col("_ls"))
    gross, names = F.sum(F.abs("_res")).over(xs()), F.count_if(ok).over(xs())
    desired = F.when((names >= LEAST_NAMES) & (gross > 1e-12), F.coalesce(F.col("_res") / F.nullif(gross, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return out.withColumn("desired", desired).drop("_r", "_y", "_ok", "_ly", "_ls", "_res")


def top_names(panel: DataFrame, score: str | Column, n: int, allowed: Column | None = None) -> DataFrame:
    """``place``: 1 to n for the best scores of a session, ties by symbol; null for others."""
    s = col(score) if allowed is None else F.when(allowed, col(score))
    place = F.row_number().over(xs().orderBy(s.desc_nulls_last(), "symbol"))
    return panel.withColumn("place", F.when(s.isNotNull() & (place <= n), place))


def long_only_weights(panel: DataFrame, score: str, n: int, allowed: Column | None = None) -> DataFrame:
    """``desired``: 1/n for each of the best n; none in sessions with fewer names."""
    out = top_names(panel, score, n, allowed)
    return out.withColumn("desired", F.when((F.count("place").over(xs()) >= n) & F.col("place").isNotNull(), F.lit(1.0 / n)).otherwise(0.0)).drop("place")


def tranches(panel: DataFrame, horizon: int) -> DataFrame:
    """``effective`` weights: the mean of the last ``horizon`` desired ones, and ``change`` from the session before."""
    out = panel.withColumn("effective", F.avg("desired").over(rows(horizon)))
    return out.withColumn("change", F.col("effective") - F.lag("effective").over(ts()))


def daily(panel: DataFrame, cost: float, participation: float = 0.01) -> DataFrame:
    """Per session: turnover (0 in the first), gross and costed return, and capacity."""
    moved = F.abs("change")
    return panel.groupBy("date").agg(
        F.coalesce(F.sum(moved), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.sum(F.col("effective") * F.col("one_day")), F.lit(0.0)).alias("gross"),
        F.min(divided(F.col("amount") * participation, moved)).alias("capacity"),
    ).withColumn("costed", F.col("gross") - F.col("turnover") * cost / 2)


def placebo_costed(panel: DataFrame, cost: float) -> DataFrame:
    """As ``daily``, but the first session pays for its whole weight: the rule for placebos."""
    moved = F.abs(F.col("effective") - F.lag("effective", 1, 0.0).over(ts()))
    rows_ = panel.withColumn("_m", moved)
    return rows_.groupBy("date").agg((F.coalesce(F.sum(F.col("effective") * F.col("one_day")), F.lit(0.0)) - F.coalesce(F.sum("_m"), F.lit(0.0)) * cost / 2).alias("costed"))


def neutral_book(panel: DataFrame, signal: str, horizon: int, cost: float) -> DataFrame:
    return daily(tranches(neutral_weights(panel, signal), horizon), cost)


def long_only_book(panel: DataFrame, score: str, n: int, horizon: int, cost: float, allowed: Column | None = None) -> DataFrame:
    return daily(tranches(long_only_weights(panel, score, n, allowed), horizon), cost)


def benchmark(panel: DataFrame) -> DataFrame:
    """Mean one-session return of the eligible names."""
    return panel.groupBy("date").agg(F.avg(F.when(F.col("eligible"), F.col("one_day"))).alias("benchmark"))


def decile_excess(panel: DataFrame, signal: str, forward: str = "one_day") -> DataFrame:
    """Mean forward return of the top tenth of the signal over that of all."""
    r = F.col(forward)
    out = panel.withColumn("_r", pct_rank(F.when(r.isNotNull(), F.col(signal))))
    return out.groupBy("date").agg((F.avg(F.when(F.col("_r") >= 0.9, r)) - F.avg(r)).alias("excess"))


def cost_curve(book: DataFrame, costs: tuple[float, ...] = (0.0, 0.001, 0.003, 0.005)) -> DataFrame:
    """Mean costed return at several round-trip costs."""
    each = F.explode(F.array(*map(F.lit, costs)))
    return book.select("gross", "turnover", each.alias("cost")).groupBy("cost").agg(F.avg(F.col("gross") - F.col("turnover") * F.col("cost") / 2).alias("mean_costed"))
