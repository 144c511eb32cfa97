"""Queries over statistics of factors, splits and controls."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelforge.catalog.frames import MOMENTUM, r6, signal_panel
from panelforge.catalog.sql import NEUTRAL, NEUTRAL_BOOK, PANEL, SIGNAL, TS, corr, pct_rank
from panelforge.operators import evaluate, overfit, placebos, portfolio, validate
from panelforge.operators import panel as P
from panelforge.plans import discovery, dsl
from panelforge.sources import testbed
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


def _ic(cte: str, signal: str = "signal", target: str = "target") -> str:
    return f"{cte},\nir AS (SELECT date, session_index, {pct_rank(signal)} AS s, {pct_rank(target)} AS t FROM sig),\nic AS (SELECT date, session_index, {corr('s', 't')} AS ic FROM ir GROUP BY date, session_index)"


IC = _ic(SIGNAL)


@query("E01_rank_ic", f"WITH {IC} SELECT date, round(ic, 6) + 0.0 AS ic FROM ic")
def rank_ic(spark, d):
    return r6(evaluate.rank_ic(signal_panel(spark, d), "signal", "target"))


def _nw(source: str, value: str, lags: int, keys: str = "") -> str:
    k, p = (keys + ", ") if keys else "", f"PARTITION BY {keys} " if keys else ""
    terms = " + ".join([f"x * x"] + [f"{2 * (1 - i / (lags + 1))!r} * x * coalesce(lag(x, {i}) OVER ({p}ORDER BY date), 0)" for i in range(1, lags + 1)])
    g = f"GROUP BY {keys}" if keys else ""
    return f"v0 AS (SELECT {k}date, {value} AS v FROM {source} WHERE {value} IS NOT NULL), v1 AS (SELECT *, v - avg(v) OVER ({p.strip()}) AS x FROM v0), v2 AS (SELECT *, {terms} AS c FROM v1), nw AS (SELECT {k}count(*) AS n, avg(v) AS mean, CASE WHEN count(*) >= {max(20, lags + 3)} THEN avg(v) / sqrt(greatest(avg(c), 1e-20) / count(*)) END AS t FROM v2 {g})"


@query("E02_newey_west", f"WITH {IC}, {_nw('ic', 'ic', 4)} SELECT n, round(mean, 6) + 0.0 AS mean, round(t, 6) + 0.0 AS t FROM nw")
def newey_west(spark, d):
    return r6(evaluate.newey_west(evaluate.rank_ic(signal_panel(spark, d), "signal", "target"), "ic", 4))


def _stats(source: str, value: str, keys: str = "") -> str:
    k, p = (keys + ", ") if keys else "", f"PARTITION BY {keys} " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""st0 AS (SELECT {k}date, {value} AS v FROM {source} WHERE {value} IS NOT NULL), st1 AS (SELECT *, product(1 + v) OVER ({p}ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM st0),
st2 AS (SELECT *, e / max(e) OVER ({p}ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM st1),
stats AS (SELECT {k}count(*) AS n, avg(v) AS mean, avg(CAST(v > 0 AS INTEGER)) AS hit_rate, min(dd) AS max_drawdown, avg(v) / nullif(stddev_samp(v), 0) * sqrt(244) AS ir, avg(v) * 244 / nullif(abs(min(dd)), 0) AS calmar FROM st2 {g})"""


_STATS_COLUMNS = "n, round(mean, 6) + 0.0 AS mean, round(hit_rate, 6) AS hit_rate, round(max_drawdown, 6) + 0.0 AS max_drawdown, round(ir, 6) + 0.0 AS ir, round(calmar, 6) + 0.0 AS calmar"


@query("E03_return_statistics", f"WITH {NEUTRAL_BOOK}, {_stats('book', 'costed')} SELECT {_STATS_COLUMNS} FROM stats")
def return_stats(spark, d):
    return r6(evaluate.return_stats(portfolio.neutral_book(signal_panel(spark, d), "signal", HORIZON, COST)))


_DECAY = " UNION ALL ".join(f"SELECT date, {h} AS horizon, signal, lead(open, {h + 1}) OVER ({TS}) / nullif(lead(open, 1) OVER ({TS}), 0) - 1 AS target FROM sig" for h in (1, 5, 10, 20))


@query("E04_ic_decay", f"WITH {SIGNAL}, h AS ({_DECAY}), r AS (SELECT date, horizon, {pct_rank('signal', 'date, horizon')} AS s, {pct_rank('target', 'date, horizon')} AS t FROM h), i AS (SELECT date, horizon, {corr('s', 't')} AS ic FROM r GROUP BY date, horizon) SELECT horizon, count(ic) AS sessions, round(avg(ic), 6) + 0.0 AS mean_ic FROM i GROUP BY horizon")
def ic_decay(spark, d):
    return r6(evaluate.ic_decay(signal_panel(spark, d), "signal").drop("t"))


_QM = f"{SIGNAL}, q AS (SELECT target, ceil({pct_rank('signal')} * 5) AS bucket FROM sig), qm AS (SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, avg(target) AS mean_target FROM q WHERE bucket IS NOT NULL AND target IS NOT NULL GROUP BY bucket)"


@query("E05_quintile_means", f"WITH {_QM} SELECT bucket, n, round(mean_target, 6) + 0.0 AS mean_target FROM qm")
def quintile_means(spark, d):
    return r6(evaluate.quintile_means(signal_panel(spark, d), "signal", "target"))


@query("E05_monotonicity", f"WITH {_QM}, k AS (SELECT CAST(bucket AS DOUBLE) AS b, CAST(rank() OVER (ORDER BY mean_target) AS DOUBLE) AS r FROM qm) SELECT round({corr('b', 'r')}, 6) + 0.0 AS monotonicity FROM k")
def monotonicity(spark, d):
    return r6(evaluate.monotonicity(evaluate.quintile_means(signal_panel(spark, d), "signal", "target")))


@query("E06_signal_correlation", f"WITH {SIGNAL}, c AS (SELECT date, {corr('signal', 'volume')} AS c FROM sig GROUP BY date) SELECT count(c) AS sessions, round(avg(c), 6) + 0.0 AS correlation FROM c")
def signal_correlation(spark, d):
    return r6(evaluate.signal_correlation(signal_panel(spark, d), "signal", "volume"))


@query("E07_phenomena", f"WITH {PANEL}, d AS (SELECT date, stddev_samp(returns) AS s, first(market_return) AS m FROM panel GROUP BY date), l AS (SELECT *, lag(m) OVER (ORDER BY date) AS m0 FROM d) SELECT round(median(s), 6) AS median_dispersion, round({corr('m', 'm0')}, 6) + 0.0 AS market_autocorrelation FROM l")
def phenomena(spark, d):
    return r6(evaluate.phenomena(testbed.panel(spark, d)))


@query("E08_train_score", f"WITH {IC} SELECT count(ic) AS sessions, round(avg(ic), 6) + 0.0 AS mean_ic, CASE WHEN count(ic) >= 60 THEN CASE WHEN avg(ic) >= 0 THEN 1 ELSE -1 END END AS direction FROM ic")
def train_score(spark, d):
    return r6(evaluate.train_score(signal_panel(spark, d), "signal", "target"))


_SPLIT = f"{PANEL}, n AS (SELECT count(*) AS n FROM calendar), split AS (SELECT date, session_index, CASE WHEN session_index >= n - 60 THEN 'shadow' WHEN session_index >= n - 130 AND session_index < n - 70 THEN 'validation' WHEN session_index < n - 140 THEN 'train' ELSE 'purge' END AS segment FROM calendar, n)"


@query("V01_split", f"WITH {_SPLIT} SELECT * FROM split")
def split(spark, d):
    return validate.split(P.calendar(testbed.bars(spark, d)), 5, 10, 60, 60, 100)


@query("V02_partitions", f"WITH {PANEL}, n AS (SELECT count(*) AS n FROM calendar) SELECT date, session_index, CASE WHEN session_index >= n - 40 THEN 'shadow' WHEN session_index >= n - 50 THEN 'purged' WHEN session_index >= n - 90 THEN 'validation' WHEN session_index >= n - 100 THEN 'purged' WHEN session_index >= n - 140 THEN 'audit' WHEN session_index >= n - 150 THEN 'purged' WHEN session_index >= n - 190 THEN 'calibration' WHEN session_index >= n - 200 THEN 'purged' ELSE 'fit' END AS segment FROM calendar, n")
def partitions(spark, d):
    return validate.research_partitions(P.calendar(testbed.bars(spark, d)), 10, 40, 40, 40, 40)


_WF = f"""{_ic(NEUTRAL_BOOK)},
days AS (SELECT b.date, i.session_index, i.ic, b.gross, b.turnover FROM book b JOIN ic i ON b.date = i.date),
tested AS (SELECT *, ntile(3) OVER (ORDER BY date) AS fold FROM days WHERE session_index >= 70),
first AS (SELECT fold, min(session_index) AS first FROM tested GROUP BY fold),
turned AS (SELECT fold, count(ic) AS fit_sessions, avg(ic) AS fit_ic, CASE WHEN avg(ic) >= 0 THEN 1 ELSE -1 END AS direction FROM days JOIN first ON session_index < first - 10 GROUP BY fold HAVING count(ic) >= 60),
scored AS (SELECT t.fold, t.date, t.gross * u.direction - t.turnover * 0.003 / 2 AS value FROM tested t JOIN turned u ON t.fold = u.fold), {_stats('scored', 'value', 'fold')}
SELECT t.fold, fit_sessions, round(fit_ic, 6) + 0.0 AS fit_ic, direction, {_STATS_COLUMNS} FROM turned t JOIN stats s ON t.fold = s.fold"""


@query("V03_walk_forward", f"WITH {_WF}")
def walk_forward(spark, d):
    return r6(validate.walk_forward(signal_panel(spark, d), "signal", "target", HORIZON, 10, 3, COST))


DIFF = """ty AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_type AS candidate, avg(l_discount) * 100 AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
al AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_discount) * 100 AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
diff AS (SELECT ty.date, candidate, round(x - m, 9) AS d FROM ty JOIN al ON ty.date = al.date)"""

_BLOCKS = f"{DIFF}, blk AS (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM diff WHERE d IS NOT NULL)), sums AS (SELECT block, candidate, count(d) AS n, sum(d) AS s, sum(d * d) AS q FROM diff JOIN blk ON diff.date = blk.date GROUP BY 1, 2)"
_HALVES = ", ".join(f"({i}, {b})" for i, c in enumerate(combinations(range(8), 4)) for b in c)
_PBO = f"""{_BLOCKS}, halves(split, block) AS (VALUES {_HALVES}), every AS (SELECT DISTINCT split FROM halves),
half AS (SELECT e.split, s.candidate, h.block IS NOT NULL AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM sums s CROSS JOIN every e LEFT JOIN halves h ON h.split = e.split AND h.block = s.block GROUP BY 1, 2, 3),
irs AS (SELECT split, candidate, inside, s / n / nullif(CASE WHEN (q - s * s / n) / nullif(n - 1, 0) > 1e-24 THEN sqrt((q - s * s / n) / nullif(n - 1, 0)) END, 0) AS ir FROM half),
both_ AS (SELECT split, candidate, max(ir) FILTER (WHERE inside) AS ir_in, max(ir) FILTER (WHERE NOT inside) AS ir_out FROM irs GROUP BY 1, 2),
ranked AS (SELECT split, candidate, {pct_rank('ir_out', 'split')} AS rank_out, row_number() OVER (PARTITION BY split ORDER BY ir_in DESC NULLS LAST, candidate) AS place FROM both_)"""


@query("O02_pbo_blocks", f"WITH {_BLOCKS} SELECT CAST(block AS INTEGER) AS block, candidate, n, round(s, 6) + 0.0 AS s, round(q, 6) AS q FROM sums")
def pbo_blocks(spark, d):
    return r6(overfit.block_sums(testbed.type_returns(spark, d), 8))


@query("O02_pbo_splits", f"WITH {_PBO} SELECT split, candidate AS winner, round(rank_out, 6) AS rank_out, rank_out <= 0.5 AS failure FROM ranked WHERE place = 1")
def pbo_splits(spark, d):
    return r6(overfit.pbo_splits(testbed.type_returns(spark, d), 8))


@query("O02_pbo", f"WITH {_PBO} SELECT count(*) AS splits, round(avg(CAST(rank_out <= 0.5 AS INTEGER)), 6) AS pbo FROM ranked WHERE place = 1")
def pbo(spark, d):
    return r6(overfit.pbo(testbed.type_returns(spark, d), 8))


@query("O03_sharpe_moments", f"WITH {DIFF} SELECT candidate, count(d) AS n, round(avg(d) / nullif(stddev_samp(d), 0), 6) + 0.0 AS sharpe, round(skewness(d), 6) + 0.0 AS skew, round(kurtosis(d), 6) + 0.0 AS kurtosis FROM diff GROUP BY candidate")
def sharpe_moments(spark, d):
    return r6(overfit.sharpe_moments(testbed.type_returns(spark, d)))


@query("O03_deflated_sharpe")
def deflated(spark, d):
    return overfit.deflated_sharpes(testbed.type_returns(spark, d))


@query("G03_placebo_groups", f"WITH {PANEL}, c AS (SELECT *, CASE WHEN market_cap > 0 THEN market_cap END AS mc FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mc ASC NULLS LAST, symbol) AS r, count(mc) OVER (PARTITION BY date) AS n FROM c), b AS (SELECT date, symbol, industry, CASE WHEN mc IS NOT NULL THEN CAST(coalesce(greatest(ceil((r - 1) * 5 / nullif(n - 1, 0)), 1) - 1, 0) AS INTEGER) END AS bucket FROM k) SELECT *, count(*) OVER (PARTITION BY date, industry, bucket) AS members FROM b")
def placebo_groups(spark, d):
    return placebos.placebo_groups(testbed.panel(spark, d)).select("date", "symbol", "industry", "bucket", "members")


REPETITIONS, SEED = 40, 7
_MIX = f"1 + (rep * {placebos.STEP_A} + {placebos.STEP_B}) % {placebos.PRIME - 1}"
_PLACEBO = f"""{NEUTRAL}, cap AS (SELECT *, CASE WHEN market_cap > 0 THEN market_cap END AS mc FROM weights),
nth AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mc ASC NULLS LAST, symbol) AS nth, count(mc) OVER (PARTITION BY date) AS nn FROM cap),
cell AS (SELECT date, session_index, symbol, one_day, desired, industry, CASE WHEN mc IS NOT NULL THEN CAST(coalesce(greatest(ceil((nth - 1) * 5 / nullif(nn - 1, 0)), 1) - 1, 0) AS INTEGER) END AS bucket,
         CAST('0x' || substr(md5('{SEED}|' || symbol || '|' || CAST(date AS VARCHAR)), 1, 7) AS BIGINT) AS own FROM nth),
fan AS (SELECT cell.*, rep, {_MIX} AS f FROM cell, range(1, {REPETITIONS + 1}) r(rep)),
keyed AS (SELECT *, (((own * f % {placebos.PRIME}) * (own * f % {placebos.PRIME}) + own) % {placebos.PRIME}) * f % {placebos.PRIME} AS k FROM fan),
placed AS (SELECT *, row_number() OVER (PARTITION BY rep, date, industry, bucket ORDER BY symbol) AS a, row_number() OVER (PARTITION BY rep, date, industry, bucket ORDER BY k, symbol) AS b FROM keyed),
dealt AS (SELECT t.rep, t.date, t.symbol, t.one_day, s.desired FROM placed t JOIN placed s ON t.rep = s.rep AND t.date = s.date AND t.industry IS NOT DISTINCT FROM s.industry AND t.bucket IS NOT DISTINCT FROM s.bucket AND t.b = s.a
          UNION ALL SELECT 0, date, symbol, one_day, desired FROM cell),
eff AS (SELECT *, avg(desired) OVER (PARTITION BY rep, symbol ORDER BY date ROWS {HORIZON - 1} PRECEDING) AS effective FROM dealt),
mov AS (SELECT *, abs(effective - lag(effective, 1, 0) OVER (PARTITION BY rep, symbol ORDER BY date)) AS moved FROM eff),
days AS (SELECT rep, date, coalesce(sum(effective * one_day), 0) - sum(moved) * {COST} / 2 AS costed FROM mov GROUP BY 1, 2),
placebo AS (SELECT rep, avg(costed) AS statistic FROM days GROUP BY rep)"""


def _permutations(spark, d):
    w = portfolio.neutral_weights(signal_panel(spark, d), "signal")
    return placebos.permutation_test(w, HORIZON, COST, REPETITIONS, SEED)


@query("O01_placebo_statistics", f"WITH {_PLACEBO} SELECT rep AS repetition, round(statistic, 9) + 0.0 AS statistic FROM placebo")
def placebo_statistics(spark, d):
    return _permutations(spark, d).withColumn("statistic", F.round("statistic", 9) + 0.0)


@query("O01_permutation_test", f"WITH {_PLACEBO}, o AS (SELECT statistic AS own FROM placebo WHERE rep = 0) SELECT (1 + count(*) FILTER (WHERE statistic >= own)) / (count(*) + 1) AS p_value, count(*) AS repetitions FROM placebo, o WHERE rep > 0")
def permutation(spark, d):
    return placebos.permutation_p(_permutations(spark, d))


_ALT = {"momentum": MOMENTUM, "reversal": dsl.unary("neg", dsl.roll("sum", dsl.f("returns"), 5)), "volume": dsl.f("volume")}


@query("O05_behaviour_correlations", f"WITH {PANEL}, x AS (SELECT date, sum(returns) OVER ({TS} ROWS 19 PRECEDING) AS m0, count(returns) OVER ({TS} ROWS 19 PRECEDING) AS n20, sum(returns) OVER ({TS} ROWS 4 PRECEDING) AS r0, count(returns) OVER ({TS} ROWS 4 PRECEDING) AS n5, volume FROM panel), y AS (SELECT date, CASE WHEN n20 >= 10 THEN m0 END AS momentum, CASE WHEN n5 >= 2 THEN -r0 END AS reversal, volume FROM x), c AS (SELECT date, {corr('momentum', 'reversal')} AS mr, {corr('momentum', 'volume')} AS mv, {corr('reversal', 'volume')} AS rv FROM y GROUP BY date) SELECT 'momentum' AS a, 'reversal' AS b, round(avg(mr), 6) + 0.0 AS correlation FROM c UNION ALL SELECT 'momentum', 'volume', round(avg(mv), 6) + 0.0 FROM c UNION ALL SELECT 'reversal', 'volume', round(avg(rv), 6) + 0.0 FROM c")
def behaviour(spark, d):
    p = dsl.evaluate(testbed.panel(spark, d).withColumnRenamed("volume", "_v"), {k: e for k, e in _ALT.items() if k != "volume"} | {"volume": dsl.f("_v")})
    return r6(overfit.pairwise_correlations(p, list(_ALT)))


@query("O10_counter_direction", f"WITH {_ic(SIGNAL, 'volume')} SELECT count(ic) AS sessions, round(avg(ic), 6) + 0.0 AS mean_ic, CASE WHEN count(ic) >= 60 THEN CASE WHEN avg(ic) >= 0 THEN 1 ELSE -1 END END AS direction FROM ic")
def counter(spark, d):
    return r6(evaluate.train_score(signal_panel(spark, d), "volume", "target"))


@query("S01_seed_scores")
def seed_scores(spark, d):
    p = testbed.panel(spark, d, testbed.aligned_fundamentals(spark, d)).withColumn("segment", F.lit("train"))
    found = discovery.seeds(p.columns)  # all 18, prices and statements
    scores = discovery.train_scores(p, found)
    return spark.createDataFrame([(c.id, c.origin, scores[c.id]) for c in found], "id string, origin string, train_ic double")


@query("J11_candidate_pairs", f"WITH {DIFF}, w AS (SELECT a.candidate AS a, b.candidate AS b, a.d AS x, b.d AS y FROM diff a JOIN diff b ON a.date = b.date AND a.candidate < b.candidate) SELECT a, b, round({corr('x', 'y')}, 6) + 0.0 AS correlation FROM w GROUP BY a, b")
def candidate_pairs(spark, d):
    return r6(overfit.candidate_correlations(testbed.type_returns(spark, d)))
