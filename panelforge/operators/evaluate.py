"""Statistics of factors and of books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import corr, divided, pct_rank

YEAR = 244


def rank_ic(panel: DataFrame, signal: str, target: str, *keys: str) -> DataFrame:
    """Per session: correlation of the two ranks, each among its own non-null values."""
    by = ("date", *keys)
    out = panel.withColumns({"_s": pct_rank(signal, *by), "_t": pct_rank(target, *by)})
    return out.groupBy(*by).agg(corr("_s", "_t").alias("ic"))


def newey_west(values: DataFrame, value: str, lags: int, order: str = "date", *keys: str) -> DataFrame:
    """n, mean and the t value with Bartlett weights over ``lags``; null under max(20, lags + 3) values. Nulls are left out first."""
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"))
    by = W.partitionBy(*keys)
    rows = rows.withColumn("_x", F.col("_v") - F.avg("_v").over(by))
    w = by.orderBy("_o")
    terms = sum((F.lit(2 * (1 - k / (lags + 1))) * F.col("_x") * F.coalesce(F.lag("_x", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)), F.col("_x") * F.col("_x"))
    out = rows.withColumn("_c", terms).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.avg("_c").alias("_var"))
    t = F.when(F.col("n") >= max(20, lags + 3), F.col("mean") / F.sqrt(F.greatest(F.col("_var"), F.lit(1e-20)) / F.col("n")))
    return out.withColumn("t", t).drop("_var")


def return_stats(book: DataFrame, value: str = "costed", *keys: str) -> DataFrame:
    """n, mean, information ratio a year, share of positive values, deepest fall from the running peak, and Calmar ratio."""
    rows = book.where(F.col(value).isNotNull()).withColumn("_v", F.col(value))
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_e", F.product(1 + F.col("_v")).over(w))
    rows = rows.withColumn("_d", F.col("_e") / F.max("_e").over(w) - 1)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), divided(F.avg("_v"), F.stddev_samp("_v")).alias("ratio"), F.avg((F.col("_v") > 0).cast("double")).alias("hit_rate"), F.min("_d").alias("max_drawdown")
    )
    return out.withColumn("ir", F.col("ratio") * YEAR**0.5).withColumn("calmar", divided(F.col("mean") * YEAR, F.abs("max_drawdown"))).drop("ratio")


def ic_decay(panel: DataFrame, signal: str, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Mean rank IC at several horizons and its Newey-West t with as many lags, in one pass over the panel's order."""
    from panelforge.functions.columns import ts

    after = F.lead("open", 1).over(ts())
    out = panel.withColumns({f"_t{h}": divided(F.lead("open", h + 1).over(ts()), after) - 1 for h in horizons})
    long = out.select("date", "symbol", signal, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_t{h}").alias("target")) for h in horizons])).alias("_h"))
    ic = rank_ic(long.select("date", "symbol", signal, "_h.*"), signal, "target", "horizon")
    means = ic.groupBy("horizon").agg(F.count("ic").alias("sessions"), F.avg("ic").alias("mean_ic"))
    tested = [newey_west(ic.where(F.col("horizon") == h), "ic", h).select(F.lit(h).alias("horizon"), "t") for h in horizons]
    return means.join(F.broadcast(reduce(DataFrame.unionByName, tested)), "horizon", "left")  # a row a horizon


def quintile_means(panel: DataFrame, signal: str, target: str) -> DataFrame:
    """Mean target by fifth of the signal's rank."""
    out = panel.withColumn("bucket", F.ceil(pct_rank(signal) * 5))
    return out.where(F.col("bucket").isNotNull() & F.col(target).isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(target).alias("mean_target"))


def monotonicity(means: DataFrame) -> DataFrame:
    """Spearman correlation of the buckets with their means."""
    r = F.rank().over(W.orderBy("mean_target")).cast("double")
    return means.withColumn("_r", r).agg(corr(F.col("bucket").cast("double"), "_r").alias("monotonicity"))


def signal_correlation(panel: DataFrame, left: str, right: str) -> DataFrame:
    """Mean correlation across names of two signals."""
    return panel.groupBy("date").agg(corr(left, right).alias("c")).agg(F.count("c").alias("sessions"), F.avg("c").alias("correlation"))


def phenomena(panel: DataFrame) -> DataFrame:
    """Median dispersion of returns and lag-1 autocorrelation of the market."""
    days = panel.groupBy("date").agg(F.stddev_samp("returns").alias("dispersion"), F.first("market_return").alias("m"))
    days = days.withColumn("m0", F.lag("m").over(W.orderBy("date")))  # one row a session
    return days.agg(F.percentile("dispersion", F.lit(0.5)).alias("median_dispersion"), corr("m", "m0").alias("market_autocorrelation"))


def train_score(panel: DataFrame, signal: str, target: str, least: int = 60) -> DataFrame:
    """Mean IC and its sign; null under 60 sessions with one."""
    ic = rank_ic(panel, signal, target).agg(F.count("ic").alias("sessions"), F.avg("ic").alias("mean_ic"))
    return ic.withColumn("direction", F.when(F.col("sessions") >= least, F.when(F.col("mean_ic") >= 0, 1).otherwise(-1)))
