"""Splits of the calendar, and purged walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.evaluate import rank_ic, return_stats
from panelforge.operators.portfolio import neutral_book


def split(calendar: DataFrame, horizon: int, purge: int, validation: int, shadow: int, least_train: int) -> DataFrame:
    """``segment``: train, purge, validation, purge, shadow by the sessions from the end."""
    if purge < horizon:
        raise ValueError("the purge is shorter than the horizon")
    n = calendar.count()
    if least_train + validation + shadow + 2 * purge > n:
        raise ValueError(f"{n} sessions are too few")
    shadow_start = n - shadow
    validation_end = shadow_start - purge
    validation_start = validation_end - validation
    k = F.col("session_index")
    segment = F.when(k >= shadow_start, "shadow").when((k >= validation_start) & (k < validation_end), "validation").when(k < validation_start - purge, "train").otherwise("purge")
    return calendar.withColumn("segment", segment)


def research_partitions(calendar: DataFrame, purge: int, calibration: int, audit: int, validation: int, shadow: int) -> DataFrame:
    """Five blocks, fit to shadow, with a purge before each of the last four."""
    end = calendar.count()
    segment, k = F.lit("fit"), F.col("session_index")
    for name, length in (("shadow", shadow), ("validation", validation), ("audit", audit), ("calibration", calibration)):
        segment = F.when((k >= end - length) & (k < end), name).when((k >= end - length - purge) & (k < end - length), "purged").otherwise(segment)
        end -= length + purge
    if end <= 0:
        raise ValueError("too few sessions to fit on")
    return calendar.withColumn("segment", segment)


def walk_forward(panel: DataFrame, signal: str, target: str, horizon: int, purge: int, folds: int, cost: float, least: int = 60) -> DataFrame:
    """Per fold: the direction learned on sessions before it less the purge, and the statistics of the book in that direction.

    The book of the other direction needs no second pass: its weights are the negative ones, so gross changes sign and turnover stays.
    """
    start = max(least, 3 * horizon) + purge
    ic = rank_ic(panel, signal, target)
    book = neutral_book(panel, signal, horizon, cost)
    days = panel.select("date", "session_index").distinct().join(ic, "date").join(book, "date").where("session_index >= 0")
    tested = days.where(F.col("session_index") >= start).withColumn("fold", F.ntile(folds).over(W.orderBy("date")))  # one row a session
    first = tested.groupBy("fold").agg(F.min("session_index").alias("first"))
    past = days.join(F.broadcast(first), F.col("session_index") < F.col("first") - purge).groupBy("fold").agg(F.count("ic").alias("fit_sessions"), F.avg("ic").alias("fit_ic"))
    turned = past.where(F.col("fit_sessions") >= least).withColumn("direction", F.when(F.col("fit_ic") >= 0, 1).otherwise(-1))
    scored = tested.join(turned, "fold").withColumn("value", F.col("gross") * F.col("direction") - F.col("turnover") * cost / 2)
    return turned.join(return_stats(scored, "value", "fold"), "fold")
