"""The panel in SQL, for the queries' twins."""

from __future__ import annotations

_PRICE = "l_extendedprice / nullif(l_quantity, 0)"
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

BARS = f"""bars AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS symbol,
         first({_PRICE} ORDER BY {_ORDER}) AS open, last({_PRICE} ORDER BY {_ORDER}) AS close,
         max({_PRICE}) AS high, min({_PRICE}) AS low, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount,
         count(*) FILTER (WHERE l_returnflag = 'R') * 10 > count(*) * 6 AS is_st
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

PRICES = f"""{BARS},
prices AS (
  SELECT *, 'industry_' || CAST(CAST(regexp_extract(symbol, '(\\d+)', 1) AS INTEGER) % 5 AS VARCHAR) AS industry,
         sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) * close AS market_cap
  FROM bars)"""

TS = "PARTITION BY symbol ORDER BY date"


def rows(k: int, over: str = TS) -> str:
    return f"({over} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def rolling(aggregate: str, c: str, k: int, least: int | None = None, over: str = TS) -> str:
    name = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "median": "median", "skew": "skewness"}.get(aggregate, aggregate)
    least = max(2, k // 2) if least is None else least
    return f"CASE WHEN count({c}) OVER {rows(k, over)} >= {least} THEN {name}({c}) OVER {rows(k, over)} END"


def rolling_corr(x: str, y: str, k: int, least: int | None = None, over: str = TS) -> str:
    a, b, w = f"CASE WHEN ({y}) IS NOT NULL THEN {x} END", f"CASE WHEN ({x}) IS NOT NULL THEN {y} END", rows(k, over)
    return f"CASE WHEN count({a}) OVER {w} >= {k if least is None else least} THEN covar_samp({a}, {b}) OVER {w} / nullif(stddev_samp({a}) OVER {w} * stddev_samp({b}) OVER {w}, 0) END"


def corr(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


def pct_rank(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} ASC NULLS LAST) + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


PANEL = f"""{PRICES},
calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_index FROM (SELECT DISTINCT date FROM prices)),
grid AS (SELECT c.date, c.session_index, s.symbol FROM calendar c CROSS JOIN (SELECT DISTINCT symbol FROM prices) s),
p0 AS (SELECT g.date, g.session_index, g.symbol, p.open, p.high, p.low, p.close, p.volume, p.amount, p.industry, p.market_cap, coalesce(p.is_st, false) AS is_st
       FROM grid g LEFT JOIN prices p ON g.date = p.date AND g.symbol = p.symbol),
p1 AS (SELECT *, close / nullif(lag(close) OVER ({TS}), 0) - 1 AS returns, coalesce(amount / nullif(volume, 0), close) AS vwap,
              coalesce(high = low AND volume > 0 AND close > lag(close) OVER ({TS}), false) AS limit_up,
              coalesce(high = low AND volume > 0 AND close < lag(close) OVER ({TS}), false) AS limit_down,
              {rolling("median", "amount", 20, 6)} AS med,
              sum(CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END) OVER ({TS} ROWS UNBOUNDED PRECEDING) AS obs FROM p0),
p2 AS (SELECT *, coalesce(lag(med) OVER ({TS}) >= 0 AND lag(obs) OVER ({TS}) >= 0 AND volume > 0 AND amount > 0 AND NOT is_st, false) AS eligible,
              coalesce(NOT is_st AND volume > 0 AND amount >= 0, false) AS common FROM p1),
panel AS (SELECT p2.*, m.market_return,
              lead(common AND NOT limit_up, 1, false) OVER ({TS}) AS buyable, lead(common AND NOT limit_down, 1, false) OVER ({TS}) AS shortable,
              lead(open, 6) OVER ({TS}) / nullif(lead(open, 1) OVER ({TS}), 0) - 1 AS target,
              lead(open, 2) OVER ({TS}) / nullif(lead(open, 1) OVER ({TS}), 0) - 1 AS one_day
       FROM p2 JOIN (SELECT date AS d, median(returns) AS market_return FROM p1 GROUP BY date) m ON p2.date = m.d)"""

#: A standard signal and the neutral book on it.
SIGNAL = f"{PANEL},\nsig AS (SELECT *, {rolling('sum', 'returns', 20)} AS signal FROM panel)"

NEUTRAL = f"""{SIGNAL},
n1 AS (SELECT *, {pct_rank("signal")} AS r FROM sig),
n2 AS (SELECT *, r - avg(r) OVER (PARTITION BY date) AS y FROM n1),
n3 AS (SELECT *, coalesce(y IS NOT NULL AND market_cap > 0 AND industry IS NOT NULL AND buyable AND shortable, false) AS ok, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS lcap FROM n2),
n4 AS (SELECT *, CASE WHEN ok THEN y - avg(y) OVER (PARTITION BY date, ok, industry) END AS ly,
              CASE WHEN ok THEN lcap - avg(CASE WHEN ok THEN lcap END) OVER (PARTITION BY date, ok, industry) END AS ls FROM n3),
n5 AS (SELECT *, ly - coalesce(CASE WHEN sum(ls * ls) OVER (PARTITION BY date) > 1e-18 THEN sum(ls * ly) OVER (PARTITION BY date) / nullif(sum(ls * ls) OVER (PARTITION BY date), 0) END, 0) * ls AS res FROM n4),
weights AS (SELECT *, CASE WHEN count(*) FILTER (WHERE ok) OVER (PARTITION BY date) >= 10 AND sum(abs(res)) OVER (PARTITION BY date) > 1e-12
              THEN coalesce(res / nullif(sum(abs(res)) OVER (PARTITION BY date), 0), 0) ELSE 0 END AS desired FROM n5)"""


def book(weights: str, cost: float = 0.003) -> str:
    """Tranches and daily results of a weights CTE."""
    return f"""e1 AS (SELECT *, avg(desired) OVER {rows(5)} AS effective FROM {weights}),
e2 AS (SELECT *, effective - lag(effective) OVER ({TS}) AS change FROM e1),
book AS (SELECT date, coalesce(sum(abs(change)), 0) AS turnover, coalesce(sum(effective * one_day), 0) AS gross,
                coalesce(sum(effective * one_day), 0) - coalesce(sum(abs(change)), 0) * {cost} / 2 AS costed, min(amount * 0.01 / nullif(abs(change), 0)) AS capacity FROM e2 GROUP BY date)"""


NEUTRAL_BOOK = f"{NEUTRAL},\n{book('weights')}"
