"""Who can be traded, as known in the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import ts
from panelforge.functions.ranges import rolling_median


def sealed_bars(panel: DataFrame, require_volume: bool = True) -> DataFrame:
    """``sealed_up`` and ``sealed_down``: bars that never left one price, above or below the last close."""
    one = F.col("high") == F.col("low")
    if require_volume:
        one = one & (F.col("volume") > 0)
    before = F.lag("close").over(ts())
    return panel.withColumns({"sealed_up": F.coalesce(one & (F.col("close") > before), F.lit(False)), "sealed_down": F.coalesce(one & (F.col("close") < before), F.lit(False))})


def apply_sealed(panel: DataFrame, overwrite: bool = False) -> DataFrame:
    """Sealed bars stand for limit flags where the whole panel has none."""
    rows = sealed_bars(panel)
    if not overwrite:
        given = panel.agg(F.bool_or("limit_up").alias("up"), F.bool_or("limit_down").alias("down")).first()
        up, down = (F.col("limit_up") if given["up"] else F.col("sealed_up")), (F.col("limit_down") if given["down"] else F.col("sealed_down"))
    else:
        up, down = F.col("sealed_up"), F.col("sealed_down")
    return rows.withColumns({"limit_up": up, "limit_down": down}).drop("sealed_up", "sealed_down")


def eligible(panel: DataFrame, window: int = 60, least_amount: float = 0.0, least_observations: int = 0, exclude_st: bool = True, normal_status: bool = True) -> DataFrame:
    """``eligible``: liquid on lagged amounts, observed before, and trading normally in the session itself."""
    observed = F.col("close").isNotNull().cast("int")
    rows = rolling_median(panel, "amount", window, max(2, window // 3), "_med").withColumn("_obs", F.sum(observed).over(ts().rowsBetween(W.unboundedPreceding, 0)))
    ok = (F.lag("_med").over(ts()) >= least_amount) & (F.lag("_obs").over(ts()) >= least_observations) & (F.col("volume") > 0) & (F.col("amount") > 0)
    ok = ok & ~F.col("is_suspended") & ~F.col("is_delisted")
    if exclude_st:
        ok = ok & ~F.col("is_st")
    if normal_status and "trade_status" in panel.columns:
        ok = ok & (F.coalesce("trade_status", F.lit(1.0)) == 1)
    return rows.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("_med", "_obs")


def summary(panel: DataFrame) -> DataFrame:
    """Members, entries and exits of each session."""
    was = F.lag("eligible", 1, False).over(ts())
    moved = panel.select("date", "eligible", (F.col("eligible") & ~was).alias("_in"), (~F.col("eligible") & was).alias("_out"))
    return moved.groupBy("date").agg(F.count_if("eligible").alias("members"), F.count_if("_in").alias("entries"), F.count_if("_out").alias("exits"))


def _common(least_amount: float) -> Column:
    bad = F.col("is_st") | F.col("is_suspended") | F.col("is_delisted")
    return F.coalesce(~bad & (F.col("volume") > 0) & (F.col("amount") >= least_amount), F.lit(False))


def tradable(panel: DataFrame, least_amount: float = 0.0) -> DataFrame:
    """``buyable`` and ``shortable`` in the next session; a label-side column, since it looks ahead."""
    common = _common(least_amount)
    return panel.withColumns({"buyable": F.lead(common & ~F.col("limit_up"), 1, False).over(ts()), "shortable": F.lead(common & ~F.col("limit_down"), 1, False).over(ts())})


def selectable() -> Column:
    """Eligible now and buyable in the next session."""
    return F.col("buyable") & F.coalesce(F.col("eligible"), F.lit(False))


def funnel(panel: DataFrame, on=None) -> DataFrame:
    """Of one session (each, if none is named): how many names pass the conditions one after another."""
    rows = panel if on is None else panel.where(F.col("date") == F.lit(on))
    steps = {"quoted": F.col("close").isNotNull(), "traded": F.coalesce(F.col("volume") > 0, F.lit(False)), "not_st": ~F.col("is_st"), "eligible": F.col("eligible")}
    so_far, counts = F.lit(True), []
    for name, step in steps.items():
        so_far = so_far & step
        counts.append(F.count_if(so_far).alias(name))
    return rows.groupBy("date").agg(F.count("*").alias("listed"), *counts)
