"""Controls against selection: combinatorial cross-validation, deflated Sharpe ratio, placebos, guards."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import corrected_kurtosis, corrected_skew, divided, pct_rank

EULER = 0.5772156649


def block_sums(returns: DataFrame, blocks: int, value: str = "d") -> DataFrame:
    """n, sum and sum of squares by block of sessions and candidate."""
    dates = returns.where(F.col(value).isNotNull()).select("date").distinct().withColumn("block", F.ntile(blocks).over(W.orderBy("date")) - 1)  # one row a session
    rows = returns.join(F.broadcast(dates), "date")
    v = F.col(value)
    return rows.groupBy("block", "candidate").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def pbo_splits(returns: DataFrame, blocks: int = 8, value: str = "d") -> DataFrame:
    """For each half of the blocks: the winner inside, and its rank outside among the candidates."""
    spark = returns.sparkSession
    halves = [(i, b) for i, c in enumerate(combinations(range(blocks), blocks // 2)) for b in c]
    inside = F.broadcast(spark.createDataFrame(halves, "split int, block int").withColumn("inside", F.lit(True)))
    every = F.broadcast(spark.range(math.comb(blocks, blocks // 2)).select(F.col("id").cast("int").alias("split")))
    sums = block_sums(returns, blocks, value).crossJoin(every).join(inside, ["split", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    half = sums.groupBy("split", "candidate", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    half = half.withColumn("ir", divided(mean, F.when(var > 1e-24, F.sqrt(var))))
    both = half.groupBy("split", "candidate").agg(F.max(F.when(F.col("inside"), F.col("ir"))).alias("ir_in"), F.max(F.when(~F.col("inside"), F.col("ir"))).alias("ir_out"))
    ranked = both.withColumns({"rank_out": pct_rank("ir_out", "split"), "place": F.row_number().over(W.partitionBy("split").orderBy(F.col("ir_in").desc_nulls_last(), "candidate"))})
    return ranked.where("place = 1").select("split", F.col("candidate").alias("winner"), "rank_out", (F.col("rank_out") <= 0.5).alias("failure"))


def pbo(returns: DataFrame, blocks: int = 8, value: str = "d", focus: str | None = None) -> DataFrame:
    """Share of splits whose winner is in the lower half outside; of the splits that ``focus`` wins, where it is given.

    Null, over no splits, with fewer than two candidates or five dates a block.
    """
    seen = returns.where(F.col(value).isNotNull()).agg(F.count_distinct("date").alias("dates"), F.count_distinct("candidate").alias("candidates")).first()
    splits = pbo_splits(returns, blocks, value)
    if focus is not None:
        splits = splits.where(F.col("winner") == focus)
    if seen["candidates"] < 2 or seen["dates"] < 5 * blocks:
        splits = splits.limit(0)
    return splits.agg(F.count("failure").alias("splits"), F.avg(F.col("failure").cast("double")).alias("pbo"))


def sharpe_moments(returns: DataFrame, value: str = "d") -> DataFrame:
    """Per candidate: n, Sharpe ratio, corrected skew and excess kurtosis."""
    v = F.col(value)
    out = returns.groupBy("candidate").agg(F.count(v).alias("n"), divided(F.avg(v), F.stddev_samp(v)).alias("sharpe"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    return out.select("candidate", "n", "sharpe", corrected_skew(F.col("g1"), F.col("n")).alias("skew"), corrected_kurtosis(F.col("g2"), F.col("n")).alias("kurtosis"))


def deflated_sharpe(n: int, sharpe: float, skew: float, kurtosis: float, trials: list[float], declared: int = 0) -> float | None:
    """Probability that the best of so many trials has a Sharpe ratio above what luck gives."""
    if n < 30:
        return None
    count, sigma = max(len(trials), declared, 2), float(np.std(trials, ddof=1)) if len(trials) > 1 else 0.0
    z = NormalDist().inv_cdf
    lucky = sigma * ((1 - EULER) * z(1 - 1 / count) + EULER * z(1 - 1 / (count * math.e)))
    spread = math.sqrt(max(1e-12, 1 - skew * sharpe + (kurtosis + 2) * sharpe**2 / 4))
    return NormalDist().cdf((sharpe - lucky) * math.sqrt(n - 1) / spread)


def deflated_sharpes(returns: DataFrame, value: str = "d", declared: int = 0) -> DataFrame:
    """Per candidate, with all candidates as trials; one row a candidate reaches the driver."""
    rows = sharpe_moments(returns, value).orderBy("candidate").collect()
    trials = [r["sharpe"] for r in rows if r["sharpe"] is not None]
    out = [(r["candidate"], r["n"], r["sharpe"], None if r["sharpe"] is None or r["kurtosis"] is None else deflated_sharpe(r["n"], r["sharpe"], r["skew"], r["kurtosis"], trials, declared)) for r in rows]
    return returns.sparkSession.createDataFrame(out, "candidate string, n long, sharpe double, probability double")


def gram_sums(x: np.ndarray) -> np.ndarray:
    """Of rows x columns with gaps, for every ordered pair of columns over the rows that have both: count, sum of the first, of its square, of the product."""
    there = np.isfinite(x).astype(float)
    full = np.where(there > 0, x, 0.0)
    return np.stack([there.T @ there, full.T @ there, (full * full).T @ there, full.T @ full])


def correlations_of(sums: np.ndarray) -> np.ndarray:
    """Pearson correlations of all pairs from ``gram_sums``; nan without two rows or with a constant column."""
    n, s, q, xy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xy - s * s.T / n
        var = q - s * s / n
        var = np.where(var > 1e-14 * np.maximum(q, 1e-300), var, np.nan)
        return np.where(n > 1, cov / np.sqrt(var * var.T), np.nan)


def pairwise_correlations(signals: DataFrame, names: list[str]) -> DataFrame:
    """Mean cross-sectional correlation of each pair of signal columns, pairwise complete: a, b, correlation.

    A session's names x signals are one matrix, whose products give all pairs at once. Every task adds up the correlations of
    its sessions before anything is sent, so that one row a task and pair is shuffled.
    """
    names = sorted(names)
    left, right = np.triu_indices(len(names), 1)

    def session(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[[f"_s{i}" for i in range(len(names))]].to_numpy(float)
        x = x - np.nan_to_num(np.nanmean(np.where(np.isfinite(x).any(0), x, 0.0), axis=0))  # near 0, for the sums' sake
        return pd.DataFrame({"found": [correlations_of(gram_sums(x))[left, right].tolist()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(left)), np.zeros(len(left), np.int64)
        for batch in batches:
            found = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(left))
            total += np.nansum(found, 0)
            count += np.isfinite(found).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left))), pa.array(total), pa.array(count)], names=["pair", "total", "count"])

    if not len(left):
        return signals.sparkSession.createDataFrame([], "a string, b string, correlation double")
    wide = signals.select("date", *[F.col(f"`{n}`").cast("double").alias(f"_s{i}") for i, n in enumerate(names)])
    days = wide.groupBy("date").applyInPandas(session, "found array<double>")
    pairs = days.mapInArrow(added, "pair long, total double, count long").groupBy("pair").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    named = signals.sparkSession.createDataFrame([(k, names[i], names[j]) for k, (i, j) in enumerate(zip(left.tolist(), right.tolist()))], "pair long, a string, b string")
    pairs = pairs.join(named, "pair")
    return pairs.select("a", "b", (F.col("total") / F.nullif("count", F.lit(0))).alias("correlation"))


#: Sessions of one task in ``candidate_correlations``.
SESSIONS_TOGETHER = 256


def candidate_correlations(returns: DataFrame, value: str = "d", together: int = SESSIONS_TOGETHER) -> DataFrame:
    """Correlation over dates of each pair of candidates of a long table, over the dates that have both: a, b, correlation.

    Blocks of sessions give the pairs' sums from one product of matrices; the blocks' sums are added up by pair.
    """
    means = returns.groupBy("candidate").agg(F.avg(value).alias("_mean"))
    dates = returns.select("date").distinct().withColumn("_block", F.floor((F.row_number().over(W.orderBy("date")) - 1) / together))  # one row a session
    rows = returns.join(means, "candidate").join(F.broadcast(dates), "date").select("_block", "date", "candidate", (F.col(value) - F.col("_mean")).alias("x"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="candidate", values="x")
        sums, names = gram_sums(wide.to_numpy(float)), wide.columns.to_numpy()
        i, j = np.triu_indices(len(names), 1)
        n, s, q, xy = sums
        return pd.DataFrame({"a": names[i], "b": names[j], "n": n[i, j], "sa": s[i, j], "sb": s[j, i], "qa": q[i, j], "qb": q[j, i], "xy": xy[i, j]})

    sums = rows.groupBy("_block").applyInPandas(block, "a string, b string, n double, sa double, sb double, qa double, qb double, xy double")
    sums = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "xy")])
    part = lambda q, s: F.expr(f"case when {q} - {s} * {s} / n > 1e-14 * {q} then {q} - {s} * {s} / n end")
    value_ = F.when(F.col("n") > 1, F.expr("xy - sa * sb / n") / F.sqrt(part("qa", "sa") * part("qb", "sb")))
    return sums.where("n > 0").select("a", "b", value_.alias("correlation"))


def prune(scores: dict[str, float], correlations: dict[tuple[str, str], float], budget: int, most: float = 0.85) -> list[str]:
    """Best first, leaving out what correlates with one taken already."""
    kept: list[str] = []
    for name in sorted(scores, key=lambda n: (-abs(scores[n]), n)):
        if len(kept) < budget and all(abs(correlations.get(tuple(sorted((name, k))), 0.0) or 0.0) < most for k in kept):
            kept.append(name)
    return kept


GUARDS = {"min_train_ic": 0.005, "max_counter_correlation": 0.9, "alpha": 0.05, "max_pbo": 0.2, "min_dsr": 0.95, "min_positive_folds": 2}


def guards(row: dict, limits: dict | None = None) -> dict[str, bool]:
    """The nine verdicts of a candidate's evidence."""
    g, get = GUARDS | (limits or {}), row.get
    known = lambda k: get(k) is not None
    return {
        "train_ic": known("train_ic") and abs(row["train_ic"]) >= g["min_train_ic"],
        "positive_after_cost": known("mean") and known("ir") and row["mean"] > 0 and row["ir"] > 0,
        "distinct_from_counter": not known("counter_correlation") or abs(row["counter_correlation"]) < g["max_counter_correlation"],
        "beats_counter": known("mean") and known("counter_mean") and row["mean"] > row["counter_mean"],
        "permutation": known("permutation_p") and row["permutation_p"] <= g["alpha"],
        "factor_pbo": known("factor_pbo") and row["factor_pbo"] <= g["max_pbo"],
        "project_pbo": known("project_pbo") and row["project_pbo"] <= g["max_pbo"],
        "deflated_sharpe": known("dsr") and row["dsr"] >= g["min_dsr"],
        "walk_forward": known("positive_folds") and row["positive_folds"] >= g["min_positive_folds"],
    }


def commitment(metrics: dict) -> str:
    """SHA-256 of metrics that are not yet disclosed."""
    return hashlib.sha256(json.dumps(metrics, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def audit_verdict(pbo_: float | None, dsr: float | None, p: float | None) -> str:
    if pbo_ is not None and pbo_ > 0.5:
        return "overfit: the winner is usually below the median outside its sample"
    if dsr is not None and dsr < 0.95:
        return "not distinguishable from luck after deflation"
    if p is not None and p > 0.10:
        return "no candidate beats the benchmark after data snooping"
    return "no objection from these tests"


# The noise experiment's sizes, and the sessions that it ranks and reports on.
ARTIFACT = {"factors": 400, "sessions": 1500, "symbols": 200, "top": 10, "late": 500}


def noise_excess(factor: int, sessions: int, symbols: int, seed: int) -> np.ndarray:
    """Daily excess of the best tenth by a factor of pure noise; every factor has a stream of its own, and so has the market."""
    root = np.random.SeedSequence(seed)
    market, own = (np.random.default_rng(np.random.SeedSequence(root.entropy, spawn_key=(k,))) for k in (0, factor + 1))
    forward = market.standard_normal((sessions, symbols)) * 0.02
    signal = own.standard_normal((sessions, symbols))
    best = signal >= np.quantile(signal, 0.9, axis=1, keepdims=True)
    return (forward * best).sum(1) / best.sum(1) - forward.mean(1)


def selection_artifact(spark, factors: int = ARTIFACT["factors"], sessions: int = ARTIFACT["sessions"], symbols: int = ARTIFACT["symbols"], top: int = ARTIFACT["top"], late: int = ARTIFACT["late"], seed: int = 0) -> DataFrame:
    """Pure noise: what the factors that are best over the reported sessions earn there, against those that were best before.

    The last ``late`` sessions are reported. With hindsight the information ratio over them picks the factors, honestly the one over
    all sessions before. Mean daily excess and annual ratio of both picks' equally weighted books; each factor is a task's own draw.
    """

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"factor": int(k), "t": np.arange(sessions), "excess": noise_excess(int(k), sessions, symbols, seed)})

    days = spark.range(factors).repartition(max(1, factors // 25)).mapInPandas(run, "factor long, t long, excess double")
    days = days.withColumn("late", F.col("t") >= sessions - late).persist()
    ratio = lambda side: F.avg(F.when(side, F.col("excess"))) / F.stddev_samp(F.when(side, F.col("excess")))
    ratios = days.groupBy("factor").agg(ratio(F.col("late")).alias("after"), ratio(~F.col("late")).alias("before"))  # one row a factor
    ranks = {n: F.row_number().over(W.orderBy(F.desc(c), "factor")) for n, c in (("hindsight", "after"), ("honest", "before"))}
    ranked = ratios.withColumns(ranks)
    book = days.where("late").join(F.broadcast(ranked), "factor").groupBy("t").agg(*[F.avg(F.when(F.col(n) <= top, F.col("excess"))).alias(n) for n in ranks])
    year = math.sqrt(244)
    return book.agg(*[F.avg(n).alias(n) for n in ranks], *[(F.avg(n) / F.stddev_samp(n) * year).alias(f"{n}_ir") for n in ranks])
