"""Factor data from the star-schema tables: weekly bars by brand, statements from orders, series from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices: one row a (date, symbol); a week of a brand's line items is a session's trades."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = items.select(
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("symbol"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("price"),
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        order.alias("o"),
    )
    return items.groupBy("date", "symbol").agg(
        F.min_by("price", "o").alias("open"),
        F.max_by("price", "o").alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        (F.count_if(F.col("l_returnflag") == "R") * 10 > F.count("*") * 6).alias("is_st"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements by brand from orders: report, notice and update dates, and two measures."""
    orders = table(spark, sf_dir, "orders").withColumn("brand_no", (F.col("o_custkey") % 25).cast("int"))
    quarter = orders.groupBy("brand_no", F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter")).agg(
        F.round(F.avg("o_totalprice"), 3).alias("eps_ytd"), F.round(F.max("o_totalprice"), 4).alias("bps"), F.count("*").alias("n")
    )
    report = F.date_add(F.add_months("quarter", 3), -1)
    notice = F.date_add(report, (F.lit(30) + F.col("brand_no") % 17).cast("int"))
    return quarter.select(
        F.concat(F.lit("Brand#"), (F.col("brand_no") + 1).cast("string")).alias("symbol"),
        report.alias("report_date"),
        notice.alias("notice_date"),
        F.when(F.col("n") % 3 != 0, F.date_add(notice, (F.col("n") % 11).cast("int"))).alias("update_date"),
        F.when(F.col("n") % 7 != 0, F.col("eps_ytd")).alias("eps_ytd"),
        "bps",
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``statements`` with nine measures more: ratios among a brand's orders of a quarter, and growth over four of its quarters."""
    quarter = F.date_trunc("quarter", "o_orderdate").cast("date")
    sums = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).cast("int").alias("brand_no"), quarter.alias("quarter")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("s"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.count("*").alias("n"),
        *[F.count_if(F.col("o_orderstatus") == c).alias(c.lower()) for c in ("F", "O")], *[F.count_if(F.col("o_orderpriority").startswith(c)).alias(f"p{c}") for c in ("1", "2")],
    )
    year = W.partitionBy("brand_no").orderBy("quarter")
    mean = F.col("s") / F.col("n")
    ratios = sums.select(
        F.concat(F.lit("Brand#"), (F.col("brand_no") + 1).cast("string")).alias("symbol"),
        F.date_add(F.add_months("quarter", 3), -1).alias("report_date"),
        (F.col("lo") / F.col("hi")).alias("roe"), (mean / F.col("hi")).alias("roic"), (1 - F.col("lo") / mean).alias("gross_margin"), (F.col("f") / F.col("n")).alias("cash_to_profit"),
        (F.col("s") / F.lag("s", 4).over(year) - 1).alias("revenue_yoy"), (mean / F.lag(mean, 4).over(year) - 1).alias("profit_yoy"),
        (F.col("o") / F.col("n")).alias("debt_ratio"), (F.col("n") / (F.col("p1") + 1)).alias("current_ratio"), ((F.col("n") - F.col("p2")) / (F.col("p1") + 1)).alias("quick_ratio"),
    )
    return statements(spark, sf_dir).join(ratios, ["symbol", "report_date"])


def type_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean discount by part type less that of all: differentials of six candidates, long form (date, candidate, d)."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    month = F.date_trunc("month", "l_shipdate").cast("date")
    own = items.groupBy(month.alias("date"), F.col("p_type").alias("candidate")).agg((F.avg("l_discount") * 100).alias("x"))
    every = items.groupBy(month.alias("date")).agg((F.avg("l_discount") * 100).alias("m"))
    return own.join(every, "date").select("date", "candidate", F.round(F.col("x") - F.col("m"), 9).alias("d"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events by type and six-hour step: univariate series (series_id, t, value)."""
    events = table(spark, sf_dir, "events")
    hours = F.floor(F.unix_timestamp("ts") / 21600)
    sums = events.groupBy(F.col("event_type").alias("series_id"), hours.alias("h")).agg(F.round(F.avg("value"), 6).alias("value"))
    return sums.select("series_id", (F.row_number().over(W.partitionBy("series_id").orderBy("h")) - 1).alias("t"), "value")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with an industry and a market value (cumulative volume times close, known in the session)."""
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    so_far = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return bars(spark, sf_dir).withColumns({"industry": F.concat(F.lit("industry_"), (number % 5).cast("string")), "market_cap": F.sum("volume").over(so_far) * F.col("close")})


HORIZON, WINDOW, COST = 5, 20, 0.003


def panel(spark: SparkSession, sf_dir: str, disclosed: DataFrame | None = None) -> DataFrame:
    """The full panel: fields, sealed-bar limits, eligibility, tradability and labels; with ``disclosed``, aligned statements, their fields too."""
    from panelforge.operators import universe
    from panelforge.operators.panel import build, labels

    return labels(universe.tradable(universe.eligible(universe.apply_sealed(build(prices(spark, sf_dir), disclosed)), WINDOW)), HORIZON)


def aligned_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last disclosed value of every measure for each (date, symbol)."""
    from panelforge.operators import pit
    from panelforge.operators.panel import dense

    return pit.align(fundamentals(spark, sf_dir), dense(bars(spark, sf_dir)))
