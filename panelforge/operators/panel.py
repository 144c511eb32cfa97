"""Panels: session calendar, dense grid, derived fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import cross_z, divided, finite, ts

PRICE_COLUMNS = ("date", "symbol", "open", "high", "low", "close", "volume", "amount")
MEASURES = ("open", "high", "low", "close", "volume", "amount")
FLAGS = ("is_st", "is_suspended", "is_delisted", "limit_up", "limit_down")


def require(df: DataFrame, columns, what: str = "prices") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lack columns: {', '.join(missing)}")


def flag(df: DataFrame, name: str):
    """A flag as boolean: an absent column or a missing cell is false; strings 1, true and yes are true."""
    if name not in df.columns:
        return F.lit(False)
    if dict(df.dtypes)[name] == "boolean":
        return F.coalesce(F.col(name), F.lit(False))
    return F.coalesce(F.lower(F.trim(F.col(name).cast("string"))).isin("1", "1.0", "true", "yes"), F.lit(False))


def ingest(prices: DataFrame) -> DataFrame:
    """Validated, coerced prices; rows without date or symbol go, other columns than the known ones too."""
    require(prices, PRICE_COLUMNS)
    optional = [c for c in ("market_cap", "trade_status") if c in prices.columns]
    date = F.col("date") if dict(prices.dtypes)["date"] == "date" else F.to_date(F.try_to_timestamp(F.col("date").cast("string")))
    rows = prices.select(
        date.alias("date"),
        F.col("symbol").cast("string").alias("symbol"),
        *[finite(F.col(c).try_cast("double")).alias(c) for c in (*MEASURES, *optional)],
        *([F.col("industry").cast("string").alias("industry")] if "industry" in prices.columns else []),
        *[flag(prices, c).alias(c) for c in FLAGS],
    )
    return rows.dropna(subset=["date", "symbol"])


def assert_unique(rows: DataFrame, keys=("date", "symbol")) -> None:
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for {twice[0].asDict()}")


def calendar(rows: DataFrame) -> DataFrame:
    """date and session_index: the distinct dates, numbered; one row a session."""
    return rows.select("date").distinct().withColumn("session_index", (F.row_number().over(W.orderBy("date")) - 1).cast("long"))


def dense(rows: DataFrame) -> DataFrame:
    """Every symbol in every session, so that lags and windows move by session: the calendar and the list of symbols are small."""
    grid = F.broadcast(calendar(rows)).crossJoin(rows.select("symbol").distinct())
    return grid.join(rows, ["date", "symbol"], "left")


def build(prices: DataFrame, fundamentals: DataFrame | None = None, check: bool = False) -> DataFrame:
    """The panel: one row a (date, symbol) of the dense grid, one column a field."""
    rows = ingest(prices)
    if check:
        assert_unique(rows)
    grid = dense(rows)
    for f in FLAGS:
        grid = grid.withColumn(f, F.coalesce(f, F.lit(False)))
    panel = grid.withColumn("returns", divided("close", F.lag("close").over(ts())) - 1)
    panel = panel.withColumn("vwap", F.coalesce(divided("amount", "volume"), "close"))
    market = panel.groupBy("date").agg(F.percentile("returns", F.lit(0.5)).alias("market_return"))
    panel = panel.join(market, "date")
    return with_ratios(panel.join(fundamentals, ["date", "symbol"], "left") if fundamentals is not None else panel)


def with_ratios(panel: DataFrame) -> DataFrame:
    """Valuation ratios and composites of the fundamental fields that the panel has."""
    has = set(panel.columns)
    if "bps" in has:
        panel = panel.withColumn("book_to_price", F.when(F.col("bps") > 0, divided("bps", "close")))
    if "eps_ytd" in has:
        panel = panel.withColumn("earnings_yield_proxy", divided("eps_ytd", "close"))

    def mean(*terms):
        return reduce(lambda a, b: a + b, terms) / len(terms)

    if {"roe", "roic", "gross_margin", "cash_to_profit"} <= has:
        panel = panel.withColumn("quality_composite", mean(*map(cross_z, ("roe", "roic", "gross_margin", "cash_to_profit"))))
    if {"revenue_yoy", "profit_yoy"} <= has:
        panel = panel.withColumn("growth_composite", mean(*map(cross_z, ("revenue_yoy", "profit_yoy"))))
    if {"debt_ratio", "current_ratio", "quick_ratio"} <= has:
        panel = panel.withColumn("safety_composite", mean(-cross_z("debt_ratio"), cross_z("current_ratio"), cross_z("quick_ratio")))
    return panel


def labels(panel: DataFrame, horizon: int) -> DataFrame:
    """Labels use the future: ``target``, open to open over the horizon from the next session, and ``one_day``."""
    after = F.lead("open", 1).over(ts())
    return panel.withColumns({"target": divided(F.lead("open", horizon + 1).over(ts()), after) - 1, "one_day": divided(F.lead("open", 2).over(ts()), after) - 1})


def market_statistics(panel: DataFrame) -> DataFrame:
    """Per session: mean, deviation, median, sum and count of the returns across symbols."""
    r = F.col("returns")
    return panel.groupBy("date").agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.percentile(r, F.lit(0.5)).alias("median"), F.coalesce(F.sum(r), F.lit(0.0)).alias("sum"), F.count(r).alias("n"), F.min(r).alias("low")
    )


__all__ = ["assert_unique", "build", "calendar", "dense", "ingest", "labels", "market_statistics", "require", "with_ratios"]
