"""Mechanisms on univariate series in long form (series_id, t, value); all but the barrier labels are causal."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panelforge.functions.columns import rolling, rolling_corr
from panelforge.functions.ranges import RANGE, over_ranges


def line() -> WindowSpec:
    """A series in order."""
    return W.partitionBy("series_id").orderBy("t")



def early_warning(series: DataFrame, window: int = 20) -> DataFrame:
    """Rolling variance, lag-1 autocorrelation and absolute skewness of full windows."""
    out = series.withColumn("_b", F.lag("value").over(line()))
    return out.withColumns(
        {
            "variance": rolling("var", "value", window, window, line()),
            "autocorrelation": rolling_corr("value", "_b", window - 1, window - 1, line()),
            "abs_skew": F.abs(rolling("skew", "value", window, window, line())),
        }
    ).drop("_b")


def hmm_step(posterior: tuple[float, float], x: float | None, stay: tuple[float, float], mean: tuple[float, float], sd: tuple[float, float]) -> tuple[float, float]:
    """One forward step of the two-state filter; a missing observation only predicts."""
    p0 = posterior[0] * stay[0] + posterior[1] * (1 - stay[1])
    p = [p0, posterior[0] * (1 - stay[0]) + posterior[1] * stay[1]]
    if x is not None and math.isfinite(x):
        for k in (0, 1):
            s = max(sd[k], 1e-12)
            p[k] *= math.exp(-0.5 * ((x - mean[k]) / s) ** 2) / s
    total = max(p[0] + p[1], 1e-300)
    return p[0] / total, p[1] / total


#: Steps of a block of a filtered series.
HMM_STEPS = 8192


def _then(scale: np.ndarray, shares: np.ndarray, scale2: np.ndarray, shares2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of matrices, of which each row is kept as the logarithm of its sum and its shares, so that long products stay in range."""
    with np.errstate(divide="ignore"):
        w = np.log(shares) + scale2[..., None, :]
        top = w.max(-1)
        top = np.where(np.isfinite(top), top, 0.0)
        out = np.exp(w - top[..., None]) @ shares2
        total = out.sum(-1)
        return scale + top + np.log(total), out / np.where(total > 0, total, 1.0)[..., None]


def hmm_filter(series: DataFrame, stay=(0.95, 0.95), mean=(0.0, 0.0), sd=(1.0, 2.0), start=(0.5, 0.5), size: int = HMM_STEPS) -> DataFrame:
    """Probability of the second state given the past: ``hmm_step`` along each series.

    A step multiplies the weights of both states by a matrix, so blocks of ``size`` steps of ``t`` are multiplied out apart from
    each other, one small row a block is followed along the series to give the weights that each begins with, and the steps are
    taken inside each block. No task holds a series. A value that is null, NaN or infinite only predicts; rows of equal ``t`` go
    by value, rows without ``t`` come last; an empty frame stays empty.
    """
    kind = {f.name: f.dataType for f in series.schema.fields}
    key = StructType([StructField("series_id", kind["series_id"]), StructField("_block", LongType())])
    rows = series.select("series_id", "t", F.col("value").cast("double").alias("value"), F.coalesce(F.floor(F.col("t") / size), F.lit(2**62)).alias("_block"))
    change, width = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]]), np.maximum(sd, 1e-12)

    def values(table: pa.Table) -> np.ndarray:
        return table["value"].to_numpy(zero_copy_only=False)

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("t", "ascending"), ("value", "ascending")])

    def product(table: pa.Table) -> pa.Table:
        x = values(ordered(table))[:, None]
        seen = np.isfinite(x)
        like = np.where(seen, np.exp(-0.5 * ((np.where(seen, x, 0.0) - mean) / width) ** 2) / width, 1.0)
        shares = change * like[:, None, :]
        total = shares.sum(-1)
        with np.errstate(divide="ignore"):
            scale, shares = np.log(total), shares / np.where(total > 0, total, 1.0)[..., None]
        while len(scale) > 1:
            even = len(scale) // 2 * 2
            s, m = _then(scale[0:even:2], shares[0:even:2], scale[1:even:2], shares[1:even:2])
            scale, shares = np.concatenate([s, scale[even:]]), np.concatenate([m, shares[even:]])
        made = {"s0": scale[:, 0], "s1": scale[:, 1], "m00": shares[:, 0, 0], "m01": shares[:, 0, 1], "m10": shares[:, 1, 0], "m11": shares[:, 1, 1]}
        return pa.table({c: table[c].slice(0, 1) for c in key.names} | {c: pa.array(a) for c, a in made.items()})

    def begins(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        s, m = np.stack([table[c].to_numpy() for c in ("s0", "s1")], 1), np.stack([table[c].to_numpy() for c in ("m00", "m01", "m10", "m11")], 1).reshape(-1, 2, 2)
        weights, out = np.array([start], float), np.empty((len(table), 2))
        for k in range(len(table)):
            out[k] = weights[0]
            weights = _then(np.zeros(1), weights, s[k], m[k])[1]
        return table.select(key.names).append_column("p0", pa.array(out[:, 0])).append_column("p1", pa.array(out[:, 1]))

    def inside(table: pa.Table, begin: pa.Table) -> pa.Table:
        table, p, out = ordered(table), (begin["p0"][0].as_py(), begin["p1"][0].as_py()), []
        for x in values(table).tolist():
            p = hmm_step(p, x, stay, mean, sd)
            out.append(p[1])
        return table.select(["series_id", "t"]).append_column("probability", pa.array(out, pa.float64()))

    def doubles(*names: str) -> StructType:
        return StructType([*key.fields, *[StructField(c, DoubleType()) for c in names]])

    blocks = rows.groupBy(*key.names).applyInArrow(product, doubles("s0", "s1", "m00", "m01", "m10", "m11"))
    first = blocks.groupBy("series_id").applyInArrow(begins, doubles("p0", "p1"))
    out = StructType([StructField("series_id", kind["series_id"]), StructField("t", kind["t"]), StructField("probability", DoubleType())])
    return rows.groupBy(*key.names).cogroup(first.groupBy(*key.names)).applyInArrow(inside, out)


def _per_series(run, columns: list[str]):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        return pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"]} | dict(zip(columns, run(pdf["value"].to_numpy(float)))))

    return of


@dataclass(frozen=True)
class ChangeModel:
    """Run lengths of normal data of known noise, with a normal prior of each run's mean."""

    hazard: float = 0.01
    mean: float = 0.0
    precision: float = 1.0
    noise_precision: float = 100.0
    longest: int = 250

    def __post_init__(self):
        if not 0 < self.hazard < 1:
            raise ValueError("a hazard lies between 0 and 1")

    def start(self) -> np.ndarray:
        """Run lengths x (probability, mean, precision) before the first value."""
        return np.array([[1.0, self.mean, self.precision]])

    def step(self, runs: np.ndarray, x: float) -> np.ndarray:
        """Run lengths after a value; the first row's probability is that of a change."""
        p, mu, tau = runs.T
        var = 1 / tau + 1 / self.noise_precision
        seen = p * np.exp(-0.5 * (x - mu) ** 2 / var) / np.sqrt(2 * math.pi * var)
        p = np.append(self.hazard * seen.sum(), (1 - self.hazard) * seen)
        mu = np.append(self.mean, (tau * mu + self.noise_precision * x) / (tau + self.noise_precision))
        out = np.stack([p, mu, np.append(self.precision, tau + self.noise_precision)], 1)[: self.longest + 1]
        out[:, 0] /= max(out[:, 0].sum(), 1e-300)
        return out


def bocpd(values: np.ndarray, hazard: float = 0.01, mean: float = 0.0, precision: float = 1.0, noise_precision: float = 100.0, longest: int = 250) -> np.ndarray:
    """Probability that the run length is 0 at each step; the hazard where a value is missing."""
    model = ChangeModel(hazard, mean, precision, noise_precision, longest)
    runs, out = model.start(), np.full(len(values), hazard, float)
    for i in np.flatnonzero(np.isfinite(values)):
        runs = model.step(runs, values[i])
        out[i] = runs[0, 0]
    return out


def change_probability(series: DataFrame, hazard: float = 0.01, mean: float = 0.0, precision: float = 1.0, noise_precision: float = 100.0) -> DataFrame:
    run = _per_series(lambda x: [bocpd(x, hazard, mean, precision, noise_precision)], ["probability"])
    return series.groupBy("series_id").applyInPandas(run, "series_id string, t long, probability double")


#: Steps of one task in ``dmd_residual``.
DMD_STEPS = 4096


def dmd_errors(x: np.ndarray, window: int, ridge: float) -> np.ndarray:
    """Signed one-step errors of each column, by the linear map fitted on the ``window`` transitions that end a step before."""
    out = np.full(x.shape, np.nan)
    for i in range(window + 1, len(x)):
        past = x[i - window - 1 : i]
        if np.isfinite(past).all():
            a, b = past[:-1], past[1:]
            step = np.linalg.pinv(a.T @ a + ridge * np.eye(a.shape[1])) @ a.T @ b
            out[i] = x[i] - x[i - 1] @ step
    return out


def dmd_residual(series: DataFrame, window: int = 60, ridge: float = 1e-6, steps: int = DMD_STEPS) -> DataFrame:
    """One signed residual a series and step (``dmd_residual_<series>``); all series of a step, counted from 0, form the state.

    Steps are dealt over tasks in ranges, each with the steps that its first window needs before it.
    """
    names = [r[0] for r in series.select("series_id").distinct().orderBy("series_id").collect()]  # the state's dimensions
    wide = series.groupBy("t").pivot("series_id", names).agg(F.first("value"))
    own = F.floor(F.col("t") / steps)
    after = F.floor((F.col("t") + window + 1) / steps)
    wide = wide.withColumn("_range", F.explode(F.sequence(own, after)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        out = pd.DataFrame(dmd_errors(pdf[names].to_numpy(float), window, ridge), columns=[f"dmd_residual_{n}" for n in names])
        out.insert(0, "t", pdf["t"])
        return out[pdf["t"] // steps == key[0]]

    return wide.groupBy("_range").applyInPandas(run, ", ".join(["t long", *[f"`dmd_residual_{n}` double" for n in names]]))


# The grid of the simplified power law; critical times lie so many windows after a window's end.
LPPLS_WINDOWS, LPPLS_M, LPPLS_OMEGA, LPPLS_AHEAD = (60, 120), (0.3, 0.5, 0.7), (6.0, 9.0, 12.0), (1.05, 1.15, 1.30)


def lppls_grid(n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For a window of n logs: an orthonormal basis of the power law at each grid point, and the points' critical times after the end."""
    bases, ahead = [], []
    for m in LPPLS_M:
        for omega in LPPLS_OMEGA:
            for k in LPPLS_AHEAD:
                left = np.maximum(n - 1 + k * n - np.arange(n), 1e-6)
                x = np.stack([np.ones(n), left**m, left**m * np.cos(omega * np.log(left)), left**m * np.sin(omega * np.log(left))], 1)
                bases.append(np.linalg.qr(x)[0])
                ahead.append(k * n)
    return bases, np.array(ahead)


def lppls_errors(logs: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
    """The error at each grid point of every window of the logs; a window's rows are a view, copied a thousand at a time."""
    past = np.lib.stride_tricks.sliding_window_view(logs, len(bases[0]))
    out = np.empty((len(past), len(bases)))
    for lo in range(0, len(past), 1000):
        y = np.nan_to_num(past[lo : lo + 1000])
        for j, q in enumerate(bases):
            out[lo : lo + 1000, j] = np.sqrt(np.mean((y - (y @ q) @ q.T) ** 2, axis=1))
        out[lo : lo + 1000][~np.isfinite(past[lo : lo + 1000]).all(1)] = np.nan
    return out


def lppls(series: DataFrame, size: int = RANGE) -> DataFrame:
    """Log-periodic power law on a fixed grid: median error of the best tenth of the fits (three at least) and the
    deviation of their critical times, by step; null before the shortest window and where it has a gap or a value up to 0.
    Ranges of a series slide over the projections; no row holds its past."""
    grids = [lppls_grid(n) for n in LPPLS_WINDOWS]

    def run(values: np.ndarray, first: int) -> list[np.ndarray]:
        logs = np.log(np.where(values > 0, values, np.nan))
        parts = []
        for n, (bases, _) in zip(LPPLS_WINDOWS, grids):
            e = np.full((len(logs), len(bases)), np.nan)
            begin = max(first - n + 1, 0)
            if len(logs) - begin >= n:
                e[begin + n - 1 :] = lppls_errors(logs[begin:], bases)
            parts.append(e[first:])
        e, ahead = np.concatenate(parts, 1), np.concatenate([a for _, a in grids])
        residual, spread = np.full(len(e), np.nan), np.full(len(e), np.nan)
        order, known = np.argsort(e, axis=1, kind="stable"), np.isfinite(e).sum(1)  # nan last
        for k in np.unique(known[known > 0]):
            here = np.flatnonzero(known == k)
            best = order[here, : max(3, k // 10)]
            residual[here], spread[here] = np.median(np.take_along_axis(e[here], best, 1), axis=1), np.std(ahead[best], axis=1)
        return [residual, spread]

    rows = series.select("series_id", "t", "value")
    return over_ranges(rows, "series_id", "t", "value", max(LPPLS_WINDOWS), run, "residual double, tc_dispersion double", size).select("series_id", "t", "residual", "tc_dispersion")


def black_litterman(prior: np.ndarray, cov: np.ndarray, views: np.ndarray, targets: np.ndarray, omega: np.ndarray, tau: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance of returns under views."""
    prior, cov, views = np.asarray(prior, float), np.asarray(cov, float), np.atleast_2d(views).astype(float)
    a, b = np.linalg.inv(tau * cov), np.linalg.inv(np.asarray(omega, float))
    spread = np.linalg.inv(a + views.T @ b @ views)
    return spread @ (a @ prior + views.T @ b @ np.asarray(targets, float)), cov + spread


def hoeffding_lower(k: str | Column, n: str | Column, delta: float) -> Column:
    """Lower confidence bound of a rate."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (k, n))
    return F.when(n > 0, F.greatest(F.lit(0.0), k / n - F.sqrt(F.lit(math.log(1 / delta)) / (2 * n))))


def triple_barrier(series: DataFrame, up: float, down: float, horizon: int) -> DataFrame:
    """Offline label (looks ahead): 1 if the upper barrier is hit first within the horizon, -1 the lower, else 0 at its end."""
    now = series.where(F.col("value").isNotNull()).select("series_id", "t", "value")
    later = now.select("series_id", F.col("t").alias("u"), F.col("value").alias("later"))
    # every step meets at most ``horizon`` later ones: an explode of the step's successors, then an equi-join
    ahead = now.withColumn("u", F.explode(F.sequence(F.col("t") + 1, F.col("t") + horizon)))
    seen = ahead.join(later, ["series_id", "u"])
    move = F.col("later") / F.col("value") - 1
    hit = F.when(move >= up, 1).when(move <= -down, -1)
    first = seen.withColumn("hit", hit).groupBy("series_id", "t").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("u"))).alias("side"), F.min(F.when(F.col("hit").isNotNull(), F.col("u"))).alias("at"), F.max("u").alias("last"))
    out = series.join(first, ["series_id", "t"], "left")
    return out.select("series_id", "t", F.when(F.col("last").isNotNull(), F.coalesce("side", F.lit(0))).alias("label"), F.coalesce("at", "last").alias("touched"))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
