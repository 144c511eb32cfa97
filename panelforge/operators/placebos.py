"""Placebo books: desired weights shuffled within cells of a session, all repetitions from one pass over the panel.

The panel is dealt over ranges of sessions, each with the ``horizon`` sessions before it, so what is shuffled between
tasks is the panel and its overlaps, whatever the number of repetitions. Within a range each session's cells are sorted
once; a repetition is another order of the same arrays. Orders follow from numbers that depend on (seed, repetition,
symbol, date) alone, so a session has the same shuffles in every range that holds it, on every attempt of a task.

Cases: a null group or size bucket is a cell of its own; a missing ``desired`` leaves the mean over the horizon, a
missing return counts as 0; without repetitions only the book is given; a panel without rows gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import quintile

#: The prime below which shuffling numbers lie, and the multipliers of their rounds.
PRIME, STEP_A, STEP_B = 2**31 - 1, 48_271, 69_621
#: Sessions of a task, and repetitions that are held at once.
SPAN, TOGETHER = 32, 64


def placebo_groups(panel: DataFrame, group: str = "industry", size: str = "market_cap") -> DataFrame:
    """The cells in which placebos shuffle: group and fifth of size, per session; ``members`` counts them."""
    out = panel.withColumn("bucket", quintile(F.when(F.col(size) > 0, F.col(size))))
    return out.withColumn("members", F.count("*").over(W.partitionBy("date", group, "bucket")))


def shuffle_number(seed: int) -> Column:
    """A row's own number under ``PRIME``: 28 bits of a digest of seed, symbol and date."""
    named = F.concat_ws("|", F.lit(str(seed)), F.col("symbol"), F.col("date").cast("date").cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 7), 16, 10).cast("long")


def shuffle_keys(own: np.ndarray, repetitions: np.ndarray) -> np.ndarray:
    """Repetitions x rows: the numbers that each repetition orders its cells by."""
    factor = 1 + (repetitions * STEP_A + STEP_B) % (PRIME - 1)
    mixed = own[None, :] * factor[:, None] % PRIME
    mixed = (mixed * mixed + own[None, :]) % PRIME
    return mixed * factor[:, None] % PRIME


def costed_range(pdf: pd.DataFrame, first: int, low: int, high: int, horizon: int, cost: float, repetitions: int) -> np.ndarray:
    """Costed returns, sessions ``low`` up to ``high`` x (1 + repetitions), from the rows of these and the ``horizon`` before."""
    symbols, who = np.unique(pdf["symbol"].to_numpy(str), return_inverse=True)
    pdf = pdf.assign(who=who).sort_values(["session_index", "who"], ignore_index=True)
    cells = pdf.groupby(["session_index", "group", "bucket"], dropna=False, sort=False).ngroup().to_numpy()
    session, who = pdf["session_index"].to_numpy(np.int64), pdf["who"].to_numpy()
    desired, forward, own = (pdf[c].to_numpy(t) for c, t in (("desired", float), ("one_day", float), ("own", np.int64)))
    start = max(first, low - horizon)
    out = np.zeros((high - low, 1 + repetitions))
    for at in range(0, 1 + repetitions, TOGETHER):
        reps = np.arange(at, min(at + TOGETHER, 1 + repetitions))
        past = np.full((horizon, len(reps), len(symbols)), np.nan)  # the last sessions' desired weights, in a ring
        before = np.zeros((len(reps), len(symbols)))
        for t in range(start, high):
            rows = slice(*np.searchsorted(session, [t, t + 1]))
            past[t % horizon] = np.nan
            past[t % horizon][:, who[rows]] = _shuffled(desired[rows], cells[rows], own[rows], reps)
            # before the ring is full, and at symbols without rows, the mean is over what there is
            known = np.isfinite(past).sum(0)
            effective = np.where(known > 0, np.nansum(past, 0) / np.maximum(known, 1), np.nan)
            if t >= low:
                there = who[rows]
                gain = np.nansum(effective[:, there] * forward[rows], 1)
                out[t - low, reps] = gain - np.nansum(np.abs(effective[:, there] - before[:, there]), 1) * cost / 2
            before = effective
    return out


def _shuffled(desired: np.ndarray, cells: np.ndarray, own: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Repetitions x rows of one session, rows by symbol: the k-th row of a cell by its number gets what the k-th by symbol has."""
    out = np.broadcast_to(desired, (len(reps), len(desired))).copy()
    by_symbol = np.argsort(cells, kind="stable")
    real = reps > 0  # repetition 0 is the book itself
    keys = shuffle_keys(own, reps[real]) + cells[None, :] * PRIME
    by_number = np.argsort(keys, axis=1, kind="stable")
    shuffled = np.empty(keys.shape)
    np.put_along_axis(shuffled, by_number, desired[by_symbol][None, :].repeat(len(keys), 0), 1)
    out[real] = shuffled
    return out


def placebo_returns(panel: DataFrame, horizon: int, cost: float, repetitions: int, seed: int, group: str = "industry", size: str = "market_cap", span: int = SPAN) -> DataFrame:
    """One row a session: date and ``costed``, the returns of the book (first) and of each placebo in an array.

    ``panel`` is dense, one row a (session_index, symbol) in a run of sessions, with date, one_day and desired.
    """
    rows = placebo_groups(panel, group, size).select("date", "symbol", F.col("session_index").cast("long").alias("session_index"), "one_day", "desired", F.col(group).alias("group"), "bucket", shuffle_number(seed).alias("own"))
    ends = rows.agg(F.min("session_index").alias("first"), F.max("session_index").alias("last")).first()
    if ends["first"] is None:
        return rows.sparkSession.createDataFrame([], "date date, costed array<double>")
    first, last = ends
    own_range, later = F.expr(f"session_index div {span}"), F.expr(f"(session_index + {horizon}) div {span}")
    dealt = rows.withColumn("_range", F.explode(F.sequence(own_range, later)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = max(first, key[0] * span), min(last + 1, (key[0] + 1) * span)
        if low >= high:
            return pd.DataFrame({"date": [], "costed": []}, dtype=object)
        days = pdf.drop_duplicates("session_index").set_index("session_index")["date"]
        held = costed_range(pdf, first, low, high, horizon, cost, repetitions)
        there = [t for t in range(low, high) if t in days.index]
        return pd.DataFrame({"date": days.loc[there].to_list(), "costed": [held[t - low].tolist() for t in there]})

    return dealt.groupBy("_range").applyInPandas(run, "date date, costed array<double>")


def by_repetition(days: DataFrame, upto: int | None = None) -> DataFrame:
    """repetition (0 is the book), date, costed; ``upto`` keeps the first placebos."""
    held = F.col("costed") if upto is None else F.slice("costed", 1, upto + 1)
    return days.select("date", F.posexplode(held).alias("repetition", "costed")).select(F.col("repetition").cast("long").alias("repetition"), "date", "costed")


def statistics(days: DataFrame) -> DataFrame:
    """repetition and ``statistic``, its mean costed return."""
    return by_repetition(days).groupBy("repetition").agg(F.avg("costed").alias("statistic"))


def permutation_test(panel: DataFrame, horizon: int, cost: float, repetitions: int, seed: int, group: str = "industry", size: str = "market_cap") -> DataFrame:
    """``statistic`` of the book (repetition 0) and of each placebo: mean costed return after ``desired`` is shuffled within its cells."""
    return statistics(placebo_returns(panel, horizon, cost, repetitions, seed, group, size))


def permutation_p(found: DataFrame) -> DataFrame:
    """(1 + placebos at or above the book) / (repetitions + 1); one row a repetition comes in."""
    own = found.where("repetition = 0").agg(F.max("statistic").alias("_own"))
    return found.where("repetition > 0").crossJoin(F.broadcast(own)).agg(((1 + F.count_if(F.col("statistic") >= F.col("_own"))) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("repetitions"))
