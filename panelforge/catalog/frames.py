"""Queries over panels: sources, joins, windows, expressions, universe, books."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.sql import BARS, NEUTRAL, NEUTRAL_BOOK, PANEL, SIGNAL, TS, book, pct_rank, rolling, rolling_corr
from panelforge.functions import columns as C
from panelforge.operators import panel as P
from panelforge.operators import pit, portfolio, universe
from panelforge.plans import dsl
from panelforge.sources import readers, testbed
from panelforge.sources.testbed import COST, HORIZON

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(df, *keep: str):
    """All double columns rounded to six places, -0.0 as 0.0; ``keep`` as they are."""
    return df.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


MOMENTUM = dsl.roll("sum", dsl.f("returns"), 20)


def signal_panel(spark, d):
    return dsl.evaluate(testbed.panel(spark, d), {"signal": MOMENTUM})


@query("A01_bars", f"WITH {BARS} SELECT * FROM bars")
def bars(spark, d):
    return testbed.bars(spark, d)


@query("A10_coverage_gates", f"WITH {BARS}, days AS (SELECT date, count(close) AS q FROM bars GROUP BY date) SELECT count(DISTINCT symbol) / 25.0 AS symbol_coverage, (SELECT min(q) FROM days) / 25.0 AS session_coverage, count(DISTINCT symbol) / 25.0 >= 0.98 AND (SELECT min(q) FROM days) / 25.0 >= 0.95 AS passes FROM bars WHERE close IS NOT NULL")
def coverage(spark, d):
    return readers.coverage(testbed.bars(spark, d), 25)


@query("A12_synthetic_market")
def synthetic(spark, d):
    return readers.synthetic_market(spark, 120, 10)[0]


@query("A13_noise_world")
def noise(spark, d):
    return readers.noise_world(spark, 40, 250).groupBy("factor").agg(F.count("*").alias("n"), F.avg("r").alias("mean"))


@query("B02_ingest_coerced", "SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol, try_cast(replace(event_type, 'view', '1.5') AS DOUBLE) AS open, value AS close FROM events WHERE user_id IS NOT NULL")
def ingest(spark, d):
    e = testbed.table(spark, d, "events")
    raw = e.select(F.col("ts").cast("string").alias("date"), F.col("user_id").alias("symbol"), F.replace("event_type", F.lit("view"), F.lit("1.5")).alias("open"), F.col("value").cast("string").alias("close"), *[F.lit("1").alias(c) for c in ("high", "low", "volume", "amount")])
    return P.ingest(raw).select("date", "symbol", "open", "close")


@query("B03_key_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness(spark, d):
    return testbed.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("B04_dense_grid", f"WITH {PANEL} SELECT date, session_index, symbol, close, volume FROM p0")
def grid(spark, d):
    return P.dense(testbed.bars(spark, d)).select("date", "session_index", "symbol", "close", "volume")


@query("B05_null_denominators", "SELECT event_id, value / nullif(CASE WHEN event_type = 'error' THEN 0 ELSE value END, 0) AS ratio, CASE WHEN abs(value) < 1e300 THEN value END AS finite FROM events")
def denominators(spark, d):
    e = testbed.table(spark, d, "events")
    return e.select("event_id", C.divided("value", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))).alias("ratio"), C.finite("value").alias("finite"))


@query("B06_masked", f"WITH {PANEL} SELECT date, symbol, CASE WHEN eligible THEN close END AS masked, coalesce(close, -1) AS filled FROM panel")
def masked(spark, d):
    return testbed.panel(spark, d).select("date", "symbol", F.when(F.col("eligible"), F.col("close")).alias("masked"), F.coalesce("close", F.lit(-1.0)).alias("filled"))


@query("B08_duplicates", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicates(spark, d):
    return testbed.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().agg(F.sum(F.col("count") - 1).alias("duplicates"))


@query("B10_last_per_key", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_per_key(spark, d):
    e = testbed.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


@query("D02_calendar", f"WITH {PANEL} SELECT * FROM calendar")
def calendar(spark, d):
    return P.calendar(testbed.bars(spark, d))


@query("D01_panel_fields", f"WITH {PANEL} SELECT date, symbol, session_index, round(returns, 9) + 0.0 AS returns, vwap, round(market_return, 9) + 0.0 AS market_return, market_cap, industry FROM panel")
def fields(spark, d):
    p = testbed.panel(spark, d)
    return p.select("date", "symbol", "session_index", (F.round("returns", 9) + 0.0).alias("returns"), "vwap", (F.round("market_return", 9) + 0.0).alias("market_return"), "market_cap", "industry")


_UN = {"abs": "abs({})", "neg": "-({})", "tanh": "tanh({})", "signed_log1p": "sign({0}) * ln(1 + abs({0}))"}


@query("C06_unary", f"WITH {PANEL} SELECT date, symbol, " + ", ".join(f"round({s.format('returns')}, 6) + 0.0 AS {k}" for k, s in _UN.items()) + " FROM panel")
def unary(spark, d):
    return r6(dsl.evaluate(testbed.panel(spark, d), {k: dsl.unary(k, dsl.f("returns")) for k in _UN}).select("date", "symbol", *_UN))


@query("C07_binary", f"WITH {PANEL} SELECT date, symbol, round(open + close, 6) + 0.0 AS add, round(open - close, 6) + 0.0 AS sub, round(returns * market_return, 6) + 0.0 AS mul, round(open / nullif(returns, 0), 6) + 0.0 AS div FROM panel")
def binary(spark, d):
    e = {"add": dsl.binary("add", dsl.f("open"), dsl.f("close")), "sub": dsl.binary("sub", dsl.f("open"), dsl.f("close")), "mul": dsl.binary("mul", dsl.f("returns"), dsl.f("market_return")), "div": dsl.binary("div", dsl.f("open"), dsl.f("returns"))}
    return r6(dsl.evaluate(testbed.panel(spark, d), e).select("date", "symbol", *e))


@query("C08_lag", f"WITH {PANEL} SELECT date, symbol, close AS lag0, lag(close, 1) OVER ({TS}) AS lag1, lag(close, 5) OVER ({TS}) AS lag5, lag(close, 20) OVER ({TS}) AS lag20 FROM panel")
def lags(spark, d):
    e = {f"lag{k}": dsl.lag(k, dsl.f("close")) for k in (0, 1, 5, 20)}
    return dsl.evaluate(testbed.panel(spark, d), e).select("date", "symbol", *e)


_ROLL = ("sum", "mean", "std", "max", "min", "median", "var", "count")


@query("C09_rolling", f"WITH {PANEL} SELECT date, symbol, " + ", ".join((f"round({rolling(a, 'returns', 20)}, 6) + 0.0 AS r_{a}" if a != "count" else f"CAST({rolling(a, 'returns', 20)} AS DOUBLE) AS r_count") for a in _ROLL) + " FROM panel")
def rolled(spark, d):
    e = {f"r_{a}": dsl.roll(a, dsl.f("returns"), 20) for a in _ROLL}
    return r6(dsl.evaluate(testbed.panel(spark, d), e).select("date", "symbol", *e))


@query("C10_corr", f"WITH {PANEL} SELECT date, symbol, round({rolling_corr('returns', 'volume', 10)}, 6) + 0.0 AS c10 FROM panel")
def correlation(spark, d):
    return r6(dsl.evaluate(testbed.panel(spark, d), {"c10": {"corr": True, "left": dsl.f("returns"), "right": dsl.f("volume"), "window": 10}}).select("date", "symbol", "c10"))


_Z = f"(close - {rolling('mean', 'close', 60)}) / nullif({rolling('std', 'close', 60)}, 0)"


@query("C11_zscore", f"WITH {PANEL} SELECT date, symbol, round({_Z}, 6) + 0.0 AS z60 FROM panel")
def zscore(spark, d):
    return r6(dsl.evaluate(testbed.panel(spark, d), {"z60": {"zscore": True, "arg": dsl.f("close"), "window": 60}}).select("date", "symbol", "z60"))


_SEEDS = f"""WITH {PANEL}, x AS (SELECT *, {rolling('mean', 'amount', 20)} AS am, abs(returns) / nullif(amount, 0) AS il, {rolling('sum', 'returns', 20)} AS momentum FROM panel),
y AS (SELECT *, {rolling('mean', 'momentum', 5)} AS smooth FROM x)
SELECT date, symbol, round(momentum, 6) + 0.0 AS momentum, round(-({rolling('sum', 'returns', 5)}), 6) + 0.0 AS reversal, round(-({rolling('std', 'returns', 20)}), 6) + 0.0 AS low_volatility,
  round(({rolling('mean', 'il', 20)}) * 1000000, 6) + 0.0 AS illiquidity, round(-({rolling('max', 'returns', 20)}), 6) + 0.0 AS calm_peak, round(amount / nullif(am, 0), 6) + 0.0 AS turn, round(smooth, 6) + 0.0 AS smooth FROM y"""


@query("C04_seed_factors", _SEEDS)
def seed_factors(spark, d):
    e = {
        "momentum": MOMENTUM, "reversal": dsl.unary("neg", dsl.roll("sum", dsl.f("returns"), 5)), "low_volatility": dsl.unary("neg", dsl.roll("std", dsl.f("returns"), 20)),
        "illiquidity": dsl.roll("mean", dsl.binary("div", dsl.unary("abs", dsl.f("returns")), dsl.f("amount")), 20), "calm_peak": dsl.unary("neg", dsl.roll("max", dsl.f("returns"), 20)),
        "turn": dsl.binary("div", dsl.f("amount"), dsl.roll("mean", dsl.f("amount"), 20)), "smooth": dsl.roll("mean", MOMENTUM, 5),
    }
    out = dsl.evaluate(testbed.panel(spark, d), e)
    return r6(out.withColumn("illiquidity", F.col("illiquidity") * 1000000).select("date", "symbol", *e))


STATEMENTS = """q AS (SELECT CAST(o_custkey % 25 AS INTEGER) AS brand_no, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(avg(o_totalprice), 3) AS eps_ytd, round(max(o_totalprice), 4) AS bps, count(*) AS n FROM orders GROUP BY 1, 2),
q2 AS (SELECT *, CAST(quarter + INTERVAL 3 MONTH AS DATE) - 1 AS report_date FROM q),
q3 AS (SELECT *, report_date + 30 + brand_no % 17 AS notice_date FROM q2),
statements AS (SELECT 'Brand#' || CAST(brand_no + 1 AS VARCHAR) AS symbol, report_date, notice_date, CASE WHEN n % 3 <> 0 THEN notice_date + CAST(n % 11 AS INTEGER) END AS update_date,
               CASE WHEN n % 7 <> 0 THEN eps_ytd END AS eps_ytd, bps FROM q3)"""

AVAILABLE = f"""{STATEMENTS}, {PANEL},
s1 AS (SELECT symbol, report_date, notice_date, coalesce(update_date, notice_date) AS update_date, eps_ytd, bps FROM statements WHERE symbol IS NOT NULL AND report_date IS NOT NULL),
s2 AS (SELECT s1.*, (SELECT min(date) FROM calendar c WHERE c.date > greatest(s1.notice_date, s1.update_date)) AS session FROM s1)"""

ALIGNED = f"""{AVAILABLE},
s3 AS (SELECT session AS date, symbol, arg_max(eps_ytd, (notice_date, update_date, report_date, eps_ytd)) FILTER (WHERE eps_ytd IS NOT NULL) AS eps_ytd, arg_max(bps, (notice_date, update_date, report_date, bps)) FILTER (WHERE bps IS NOT NULL) AS bps
       FROM s2 WHERE session IS NOT NULL GROUP BY 1, 2),
aligned AS (SELECT g.date, g.symbol, last_value(s3.eps_ytd IGNORE NULLS) OVER w AS eps_ytd, last_value(s3.bps IGNORE NULLS) OVER w AS bps FROM grid g LEFT JOIN s3 ON g.date = s3.date AND g.symbol = s3.symbol
            WINDOW w AS (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("T02_available_session", f"WITH {AVAILABLE} SELECT symbol, report_date, notice_date, update_date, session FROM s2 WHERE session IS NOT NULL")
def available(spark, d):
    s = testbed.statements(spark, d).withColumn("update_date", F.coalesce("update_date", "notice_date"))
    return pit.available_sessions(s, P.calendar(testbed.bars(spark, d))).select("symbol", "report_date", "notice_date", "update_date", "session")


@query("T01_point_in_time", f"WITH {ALIGNED} SELECT date, symbol, eps_ytd, bps FROM aligned")
def aligned(spark, d):
    return pit.align(testbed.statements(spark, d), P.dense(testbed.bars(spark, d)))


@query("D03_valuation_ratios", f"WITH {ALIGNED} SELECT a.date, a.symbol, CASE WHEN a.bps > 0 THEN a.bps / nullif(p.close, 0) END AS book_to_price, a.eps_ytd / nullif(p.close, 0) AS earnings_yield_proxy FROM aligned a JOIN p0 p ON a.date = p.date AND a.symbol = p.symbol")
def ratios(spark, d):
    bars_ = testbed.bars(spark, d)
    return P.build(bars_, pit.align(testbed.statements(spark, d), P.dense(bars_))).select("date", "symbol", "book_to_price", "earnings_yield_proxy")


_MEASURES = ("roe", "roic", "gross_margin", "cash_to_profit", "revenue_yoy", "profit_yoy", "debt_ratio", "current_ratio", "quick_ratio")
_LAST = ", ".join(f"arg_max({c}, (notice_date, update_date, report_date, {c})) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _MEASURES)
_CARRIED = ", ".join(f"last_value(f4.{c} IGNORE NULLS) OVER w AS {c}" for c in _MEASURES)
_Z = ", ".join(f"greatest(-5, least(5, ({c} - avg({c}) OVER v) / nullif(stddev_samp({c}) OVER v, 0))) AS z_{c}, ({c} IS NOT NULL AND stddev_samp({c}) OVER v > 0) AS has_{c}" for c in _MEASURES)


def _composite(*terms: str) -> str:
    fields = [t.lstrip("-") for t in terms]
    total = " + ".join(f"-z_{f}" if t != f else f"z_{f}" for t, f in zip(terms, fields))
    return f"CASE WHEN {' AND '.join(f'has_{f}' for f in fields)} THEN round(({total}) / {len(terms)}, 6) + 0.0 END"


@query("D03_composites", f"""WITH {AVAILABLE},
f1 AS (SELECT CAST(o_custkey % 25 AS INTEGER) AS brand_no, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(sum(o_totalprice), 2) AS s, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(*) AS n,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS p1, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS p2 FROM orders GROUP BY 1, 2),
f2 AS (SELECT 'Brand#' || CAST(brand_no + 1 AS VARCHAR) AS symbol, CAST(quarter + INTERVAL 3 MONTH AS DATE) - 1 AS report_date, lo / hi AS roe, (s / n) / hi AS roic, 1 - lo / (s / n) AS gross_margin, f / n AS cash_to_profit,
  s / lag(s, 4) OVER y - 1 AS revenue_yoy, (s / n) / lag(s / n, 4) OVER y - 1 AS profit_yoy, o / n AS debt_ratio, n / (p1 + 1) AS current_ratio, (n - p2) / (p1 + 1) AS quick_ratio FROM f1 WINDOW y AS (PARTITION BY brand_no ORDER BY quarter)),
f3 AS (SELECT s2.session, s2.notice_date, s2.update_date, f2.* FROM s2 JOIN f2 ON s2.symbol = f2.symbol AND s2.report_date = f2.report_date WHERE s2.session IS NOT NULL),
f4 AS (SELECT session AS date, symbol, {_LAST} FROM f3 GROUP BY 1, 2),
f5 AS (SELECT g.date, g.symbol, {_CARRIED} FROM grid g LEFT JOIN f4 ON g.date = f4.date AND g.symbol = f4.symbol WINDOW w AS (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f6 AS (SELECT date, symbol, {_Z} FROM f5 WINDOW v AS (PARTITION BY date))
SELECT date, symbol, {_composite("roe", "roic", "gross_margin", "cash_to_profit")} AS quality_composite, {_composite("revenue_yoy", "profit_yoy")} AS growth_composite, {_composite("-debt_ratio", "current_ratio", "quick_ratio")} AS safety_composite FROM f6""")
def composites(spark, d):
    return r6(P.build(testbed.bars(spark, d), testbed.aligned_fundamentals(spark, d)).select("date", "symbol", "quality_composite", "growth_composite", "safety_composite"))


@query("D03_cross_section_z", f"WITH {PANEL}, z AS (SELECT date, symbol, (returns - avg(returns) OVER (PARTITION BY date)) / nullif(stddev_samp(returns) OVER (PARTITION BY date), 0) AS z FROM panel) SELECT date, symbol, CASE WHEN z IS NOT NULL THEN round(greatest(-5, least(5, z)), 6) + 0.0 END AS z FROM z")
def cross_z(spark, d):
    return r6(testbed.panel(spark, d).select("date", "symbol", C.cross_z("returns").alias("z")))


@query("U01_sealed_bars", f"WITH {PANEL} SELECT date, symbol, limit_up AS sealed_up, limit_down AS sealed_down FROM panel")
def sealed(spark, d):
    return universe.sealed_bars(P.dense(testbed.bars(spark, d))).select("date", "symbol", "sealed_up", "sealed_down")


@query("U02_applied_limits", f"WITH {PANEL} SELECT date, count(*) FILTER (WHERE limit_up) AS up, count(*) FILTER (WHERE limit_down) AS down FROM panel GROUP BY date")
def applied(spark, d):
    return universe.apply_sealed(P.build(testbed.prices(spark, d))).groupBy("date").agg(F.count_if("limit_up").alias("up"), F.count_if("limit_down").alias("down"))


@query("U03_eligibility", f"WITH {PANEL} SELECT date, symbol, eligible FROM panel")
def eligibility(spark, d):
    return testbed.panel(spark, d).select("date", "symbol", "eligible")


@query("U04_eligibility_summary", f"WITH {PANEL}, c AS (SELECT date, eligible, lag(eligible, 1, false) OVER ({TS}) AS was FROM panel) SELECT date, count(*) FILTER (WHERE eligible) AS members, count(*) FILTER (WHERE eligible AND NOT was) AS entries, count(*) FILTER (WHERE NOT eligible AND was) AS exits FROM c GROUP BY date")
def eligibility_summary(spark, d):
    return universe.summary(testbed.panel(spark, d))


@query("U05_tradability", f"WITH {PANEL} SELECT date, symbol, buyable, shortable, buyable AND eligible AS selectable FROM panel")
def tradability(spark, d):
    return testbed.panel(spark, d).select("date", "symbol", "buyable", "shortable", universe.selectable().alias("selectable"))


@query("G12_funnel", f"WITH {PANEL} SELECT date, count(*) AS listed, count(*) FILTER (WHERE close IS NOT NULL) AS quoted, count(*) FILTER (WHERE close IS NOT NULL AND volume > 0) AS traded, count(*) FILTER (WHERE close IS NOT NULL AND volume > 0 AND NOT is_st) AS not_st, count(*) FILTER (WHERE close IS NOT NULL AND volume > 0 AND NOT is_st AND eligible) AS eligible FROM panel GROUP BY date")
def funnel(spark, d):
    return universe.funnel(testbed.panel(spark, d))


@query("G01_cross_section", f"WITH {PANEL} SELECT date, round(avg(returns), 6) + 0.0 AS mean, round(stddev_samp(returns), 6) + 0.0 AS std, round(median(returns), 6) + 0.0 AS median, round(coalesce(sum(returns), 0), 6) + 0.0 AS sum, count(returns) AS n, round(min(returns), 6) + 0.0 AS low FROM panel GROUP BY date")
def cross_section(spark, d):
    return r6(P.market_statistics(testbed.panel(spark, d)))


@query("G04_distinct_range", f"WITH {BARS} SELECT count(DISTINCT date) AS sessions, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date FROM bars")
def distinct_range(spark, d):
    return testbed.bars(spark, d).agg(F.count_distinct("date").alias("sessions"), F.count_distinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("G05_quantiles", f"WITH {BARS} SELECT symbol, round(quantile_cont(close, 0.1), 6) AS q10, round(quantile_cont(close, 0.5), 6) AS q50, round(quantile_cont(close, 0.9), 6) AS q90 FROM bars GROUP BY symbol")
def quantiles(spark, d):
    return r6(testbed.bars(spark, d).groupBy("symbol").agg(*[F.percentile("close", F.lit(q / 100)).alias(f"q{q}") for q in (10, 50, 90)]))


@query("G07_moments", f"WITH {BARS} SELECT symbol, round(skewness(close), 6) + 0.0 AS skew, round(kurtosis(close), 6) + 0.0 AS kurtosis FROM bars GROUP BY symbol")
def moments(spark, d):
    n = F.count("close")
    return r6(testbed.bars(spark, d).groupBy("symbol").agg(C.corrected_skew(F.skewness("close"), n).alias("skew"), C.corrected_kurtosis(F.kurtosis("close"), n).alias("kurtosis")))


@query("G06_autocorrelation", f"WITH {PANEL}, l AS (SELECT symbol, returns, lag(returns) OVER ({TS}) AS r0 FROM panel) SELECT symbol, round(covar_samp(CASE WHEN r0 IS NOT NULL THEN returns END, CASE WHEN returns IS NOT NULL THEN r0 END) / nullif(stddev_samp(CASE WHEN r0 IS NOT NULL THEN returns END) * stddev_samp(CASE WHEN returns IS NOT NULL THEN r0 END), 0), 6) + 0.0 AS ac1 FROM l GROUP BY symbol")
def autocorrelation(spark, d):
    p = testbed.panel(spark, d).withColumn("r0", F.lag("returns").over(C.ts()))
    return r6(p.groupBy("symbol").agg(C.corr("returns", "r0").alias("ac1")))


@query("W01_pct_rank", f"WITH {PANEL} SELECT date, symbol, round({pct_rank('volume')}, 9) AS rank FROM panel")
def ranks(spark, d):
    return testbed.panel(spark, d).select("date", "symbol", F.round(C.pct_rank("volume"), 9).alias("rank"))


@query("W03_quintiles", f"WITH {PANEL}, k AS (SELECT date, symbol, volume, row_number() OVER (PARTITION BY date ORDER BY volume ASC NULLS LAST, symbol) AS r, count(volume) OVER (PARTITION BY date) AS n FROM panel) SELECT date, symbol, CASE WHEN volume IS NOT NULL THEN CAST(coalesce(greatest(ceil((r - 1) * 5 / nullif(n - 1, 0)), 1) - 1, 0) AS INTEGER) END AS bucket FROM k")
def quintiles(spark, d):
    return testbed.panel(spark, d).select("date", "symbol", C.quintile("volume").alias("bucket"))


@query("W04_blocks", f"WITH {PANEL} SELECT date, ntile(8) OVER (ORDER BY date) AS block FROM calendar")
def blocks(spark, d):
    from pyspark.sql import Window as W

    return P.calendar(testbed.bars(spark, d)).select("date", F.ntile(8).over(W.orderBy("date")).alias("block"))


@query("W06_expanding", f"WITH {PANEL}, e AS (SELECT date, symbol, product(1 + coalesce(returns, 0) / 100) OVER ({TS} ROWS UNBOUNDED PRECEDING) AS equity, sum(volume) OVER ({TS} ROWS UNBOUNDED PRECEDING) AS traded FROM panel) SELECT date, symbol, round(equity, 3) AS equity, traded, round(equity / max(equity) OVER ({TS} ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown FROM e")
def expanding(spark, d):
    from pyspark.sql import Window as W

    w = C.ts().rowsBetween(W.unboundedPreceding, 0)
    p = testbed.panel(spark, d).withColumns({"equity": F.product(1 + F.coalesce("returns", F.lit(0.0)) / 100).over(w), "traded": F.sum("volume").over(w)})
    return r6(p.select("date", "symbol", F.round("equity", 3).alias("equity"), "traded", (F.col("equity") / F.max("equity").over(w) - 1).alias("drawdown")), "traded", "equity")


@query("W10_top_names", f"WITH {SIGNAL}, t AS (SELECT date, symbol, signal, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN eligible THEN signal END DESC NULLS LAST, symbol) AS k, CASE WHEN eligible THEN signal END AS s FROM sig) SELECT date, symbol, CAST(k AS INTEGER) AS place FROM t WHERE s IS NOT NULL AND k <= 3")
def top(spark, d):
    return portfolio.top_names(signal_panel(spark, d), "signal", 3, F.col("eligible")).where("place is not null").select("date", "symbol", "place")


@query("P10_labels", f"WITH {PANEL} SELECT date, symbol, target, one_day FROM panel")
def labels(spark, d):
    return testbed.panel(spark, d).select("date", "symbol", "target", "one_day")


@query("P01_neutral_weights", f"WITH {NEUTRAL} SELECT date, symbol, round(desired, 6) + 0.0 AS desired FROM weights")
def neutral(spark, d):
    return r6(portfolio.neutral_weights(signal_panel(spark, d), "signal").select("date", "symbol", "desired"))


@query("P03_tranches", f"WITH {NEUTRAL_BOOK} SELECT date, symbol, round(effective, 6) + 0.0 AS effective, round(change, 6) + 0.0 AS change FROM e2")
def tranches(spark, d):
    return r6(portfolio.tranches(portfolio.neutral_weights(signal_panel(spark, d), "signal"), HORIZON).select("date", "symbol", "effective", "change"))


@query("P07_neutral_book_daily", f"WITH {NEUTRAL_BOOK} SELECT date, round(turnover, 6) + 0.0 AS turnover, round(gross, 6) + 0.0 AS gross, round(costed, 6) + 0.0 AS costed FROM book")
def neutral_book(spark, d):
    return r6(portfolio.neutral_book(signal_panel(spark, d), "signal", HORIZON, COST).select("date", "turnover", "gross", "costed"))


@query("P06_placebo_costed", f"WITH {NEUTRAL_BOOK}, m AS (SELECT date, effective * one_day AS g, abs(effective - lag(effective, 1, 0) OVER ({TS})) AS m FROM e1) SELECT date, round(coalesce(sum(g), 0) - coalesce(sum(m), 0) * 0.003 / 2, 6) + 0.0 AS costed FROM m GROUP BY date")
def placebo(spark, d):
    return r6(portfolio.placebo_costed(portfolio.tranches(portfolio.neutral_weights(signal_panel(spark, d), "signal"), HORIZON), COST))


_LONG = f"{SIGNAL}, k AS (SELECT *, CASE WHEN buyable AND eligible THEN signal END AS s FROM sig), k2 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC NULLS LAST, symbol) AS place FROM k), weights AS (SELECT *, CASE WHEN s IS NOT NULL AND place <= 3 AND count(s) OVER (PARTITION BY date) >= 3 THEN 1 / 3.0 ELSE 0 END AS desired FROM k2), {book('weights')}"


@query("P02_long_only_weights", f"WITH {_LONG} SELECT date, symbol, round(desired, 6) AS desired FROM weights")
def long_only(spark, d):
    return r6(portfolio.long_only_weights(signal_panel(spark, d), "signal", 3, F.col("buyable") & F.col("eligible")).select("date", "symbol", "desired"))


@query("P08_long_only_book", f"WITH {_LONG} SELECT date, round(turnover, 6) + 0.0 AS turnover, round(gross, 6) + 0.0 AS gross, round(costed, 6) + 0.0 AS costed, round(capacity, 4) AS capacity FROM book")
def long_only_book(spark, d):
    b = portfolio.long_only_book(signal_panel(spark, d), "signal", 3, HORIZON, COST, F.col("buyable") & F.col("eligible"))
    return r6(b.select("date", "turnover", "gross", "costed", F.round("capacity", 4).alias("capacity")), "capacity")


@query("P09_benchmark", f"WITH {PANEL} SELECT date, round(avg(CASE WHEN eligible THEN one_day END), 6) + 0.0 AS benchmark FROM panel GROUP BY date")
def bench(spark, d):
    return r6(portfolio.benchmark(testbed.panel(spark, d)))


@query("P11_decile_excess", f"WITH {SIGNAL}, x AS (SELECT *, CASE WHEN one_day IS NOT NULL THEN signal END AS s FROM sig), r AS (SELECT date, one_day, {pct_rank('s')} AS r FROM x) SELECT date, round(avg(CASE WHEN r >= 0.9 THEN one_day END) - avg(one_day), 6) + 0.0 AS excess FROM r GROUP BY date")
def decile(spark, d):
    return r6(portfolio.decile_excess(signal_panel(spark, d), "signal"))


@query("P12_cost_curve", f"WITH {NEUTRAL_BOOK} SELECT CAST(cost AS DOUBLE) AS cost, round(avg(gross - turnover * cost / 2), 6) + 0.0 AS mean_costed FROM book CROSS JOIN (VALUES (0.0), (0.001), (0.003), (0.005)) c(cost) GROUP BY cost")
def costs(spark, d):
    return r6(portfolio.cost_curve(portfolio.neutral_book(signal_panel(spark, d), "signal", HORIZON, COST)))

