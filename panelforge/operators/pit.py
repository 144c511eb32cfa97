"""Point-in-time alignment of statements with sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.columns import finite, ts
from panelforge.operators.panel import require

META = ("symbol", "report_date", "notice_date", "update_date")


#: Days of a block in which sessions are looked up.
BLOCK = 64


def next_sessions(dates: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """Each distinct date of ``column`` with ``session``, the first one strictly after it; null after the last.

    Sessions lie in blocks of days, as sorted arrays. A date meets its own block by an equal-key join and takes the first later
    session in it, or else the first session of the blocks after, found once a block: no date meets the whole calendar.
    """
    block = lambda c: F.floor(F.unix_date(c) / BLOCK)
    asked = dates.select(column).distinct().withColumn("_block", block(column))
    held = calendar.select("date").distinct().groupBy(block("date").alias("_block")).agg(F.sort_array(F.collect_list("date")).alias("_sessions"))  # BLOCK dates at most
    blocks = asked.select("_block").distinct().join(held, "_block", "full")
    ahead = W.orderBy("_block").rowsBetween(1, W.unboundedFollowing)  # one row a block of days
    blocks = blocks.withColumn("_later", F.first(F.get("_sessions", F.lit(0)), ignorenulls=True).over(ahead))
    found = asked.join(blocks, "_block")
    here = F.get(F.filter("_sessions", lambda s: s > F.col(column)), F.lit(0))
    return found.select(column, F.coalesce(here, "_later").alias("session"))


def available_sessions(statements: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each statement with the first session strictly after its notice and update; those without one go unused."""
    known = statements.withColumn("_available", F.greatest("notice_date", F.coalesce("update_date", "notice_date")))
    first = next_sessions(known, calendar, "_available").where("session is not null")
    return known.join(first, "_available").drop("_available")


def align(statements: DataFrame, grid: DataFrame) -> DataFrame:
    """Last disclosed value of each numeric field for every (date, symbol) of ``grid``, carried forward.

    Statements disclosed for one session are ordered by notice, update and report date; ties go by the values
    themselves. Missing notice dates fail.
    """
    require(statements, META[:3], "statements")
    if "update_date" not in statements.columns:
        statements = statements.withColumn("update_date", F.col("notice_date"))
    if not statements.where(F.col("notice_date").isNull()).isEmpty():
        raise ValueError("statements with no notice_date")
    fields = [f.name for f in statements.schema.fields if f.name not in META and isinstance(f.dataType, T.NumericType)]
    rows = statements.dropna(subset=["symbol", "report_date"]).withColumn("update_date", F.coalesce("update_date", "notice_date"))
    sessions = available_sessions(rows, grid.select("date").distinct())
    order = lambda c: F.struct("notice_date", "update_date", "report_date", F.col(c).cast("double"))
    last = sessions.groupBy(F.col("session").alias("date"), "symbol").agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c).cast("double")), F.when(F.col(c).isNotNull(), order(c))).alias(c) for c in fields])
    joined = grid.select("date", "symbol").join(last, ["date", "symbol"], "left")
    carried = ts().rowsBetween(W.unboundedPreceding, 0)
    return joined.select("date", "symbol", *[finite(F.last(c, ignorenulls=True).over(carried)).alias(c) for c in fields])
