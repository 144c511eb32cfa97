"""Multiple testing on differentials (date, candidate, d): bootstrap intervals, Reality Check, step-down, false discovery."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.streams import PRIME, mixed
from panelforge.operators.overfit import commitment


@dataclass(frozen=True)
class BootstrapDesign:
    repetitions: int = 999
    block_length: int = 10
    confidence: float = 0.95
    alpha: float = 0.05
    seed: int = 7

    def validate(self, n: int) -> None:
        if n < 20 or self.repetitions < 99 or not 1 <= self.block_length <= n or not 0 < self.confidence < 1 or not 0 < self.alpha < 1:
            raise ValueError(f"no bootstrap of {n} observations by {self}")


def complete_cases(differentials: DataFrame) -> DataFrame:
    """Dates on which every candidate has a value, with t, the date's place."""
    names = differentials.select("candidate").distinct().count()
    kept = differentials.where(F.col("d").isNotNull() & ~F.isnan("d")).withColumn("_n", F.count("*").over(W.partitionBy("date"))).where(F.col("_n") == names)
    dates = kept.select("date").distinct().withColumn("t", (F.row_number().over(W.orderBy("date")) - 1).cast("long"))  # one row a date
    return kept.drop("_n").join(F.broadcast(dates), "date")


def audit(differentials: DataFrame) -> DataFrame:
    """Dates given, dates used, candidates."""
    kept = complete_cases(differentials)
    given = differentials.agg(F.count_distinct("date").alias("dates"), F.count_distinct("candidate").alias("candidates"))
    return given.crossJoin(kept.agg(F.count_distinct("date").alias("used")))  # a row each


def stationary_paths(n: int, repetitions: np.ndarray, block_length: int, seed: int) -> np.ndarray:
    """Circular blocks of geometric length: a row of n positions for each named repetition, from that repetition's own stream.

    Step k takes two numbers: the first says whether a block begins there (always at k = 0), the second where.
    """
    steps = np.arange(n, dtype=np.int64)
    key = mixed(np.asarray(repetitions, np.int64), seed)[:, None]
    begins = mixed(2 * steps[None, :], key) * block_length < PRIME
    begins[:, 0] = True
    start = mixed(2 * steps[None, :] + 1, key) % n
    last = np.maximum.accumulate(np.where(begins, steps, 0), axis=1)  # where the block of each step began
    return (np.take_along_axis(start, last, 1) + steps - last) % n


def counts_of(paths: np.ndarray, n: int) -> np.ndarray:
    """Repetitions x n: how often each row of positions visits each date."""
    return np.bincount((np.arange(len(paths))[:, None] * n + paths).ravel(), minlength=len(paths) * n).reshape(-1, n)


#: Repetitions whose visits are held at once, and candidates of one task.
REPS_TOGETHER, CANDIDATES_TOGETHER = 256, 64


def visit_counts(spark: SparkSession, n: int, design: BootstrapDesign) -> DataFrame:
    """Each repetition's visits as a sparse vector: (rep, t, visits), the last two arrays; drawn where the repetition's row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            for at in range(0, len(reps), REPS_TOGETHER):
                part = reps[at : at + REPS_TOGETHER]
                counts = counts_of(stationary_paths(n, part, design.block_length, design.seed), n)
                t = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(t, pa.list_(pa.int64())), pa.array([c[i] for c, i in zip(counts, t)], pa.list_(pa.int64()))], names=["rep", "t", "visits"])

    return spark.range(design.repetitions).withColumnRenamed("id", "rep").mapInArrow(run, "rep long, t array<long>, visits array<long>")


def resampled_means(cases: DataFrame, n: int, design: BootstrapDesign) -> DataFrame:
    """(rep, candidate, mean): each repetition's mean of each candidate.

    Candidates are dealt in blocks; a block's task draws the repetitions' visits from their streams, some at a time, so that
    neither visits nor repeated rows are sent between tasks. ``cases`` are complete: n dates a candidate.
    """
    blocks = max(1, -(-cases.select("candidate").distinct().count() // CANDIDATES_TOGETHER))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="candidate", values="d")
        d, names = wide.to_numpy(float), wide.columns.to_numpy()
        out = []
        for at in range(0, design.repetitions, REPS_TOGETHER):
            reps = np.arange(at, min(at + REPS_TOGETHER, design.repetitions))
            means = counts_of(stationary_paths(n, reps, design.block_length, design.seed), n) @ d / n
            out.append(pd.DataFrame({"rep": np.repeat(reps, len(names)), "candidate": np.tile(names, len(reps)), "mean": means.ravel()}))
        return pd.concat(out)

    return cases.select("t", "candidate", "d", F.pmod(F.xxhash64("candidate"), F.lit(blocks)).alias("_block")).groupBy("_block").applyInPandas(run, "rep long, candidate string, mean double")


def intervals(means: DataFrame, observed: DataFrame, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    q = F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail)))
    out = means.groupBy("candidate").agg(q.alias("q"), F.stddev_samp("mean").alias("se"))
    return observed.join(out, "candidate").select("candidate", "observed", "se", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def observed_means(cases: DataFrame) -> DataFrame:
    return cases.groupBy("candidate").agg(F.avg("d").alias("observed"), F.count("*").alias("n"))


def reality_check(means: DataFrame, observed: DataFrame) -> DataFrame:
    """p of the best candidate against no effect anywhere."""
    best = F.sqrt(F.lit(1.0) * F.col("n"))
    own = observed.agg(F.max(best * F.col("observed")).alias("statistic"))
    reps = means.join(F.broadcast(observed), "candidate").groupBy("rep").agg(F.max(best * (F.col("mean") - F.col("observed"))).alias("null"))
    return reps.crossJoin(F.broadcast(own)).agg(F.first("statistic").alias("statistic"), ((1 + F.count_if(F.col("null") >= F.col("statistic"))) / (F.count("*") + 1)).alias("p_value"))


def step_down(means: DataFrame, observed: DataFrame) -> DataFrame:
    """Romano-Wolf adjusted p of each candidate, best t first."""
    se = means.groupBy("candidate").agg(F.stddev_samp("mean").alias("se"))
    t = observed.join(se, "candidate").withColumn("t", F.when(F.col("se") > 1e-15, F.col("observed") / F.col("se")))
    t = t.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("t"), "candidate")))  # one row a candidate
    null = means.join(F.broadcast(t), "candidate").where("t is not null").withColumn("z", (F.col("mean") - F.col("observed")) / F.col("se"))
    worst = null.withColumn("ref", F.max("z").over(W.partitionBy("rep").orderBy("place").rowsBetween(0, W.unboundedFollowing)))
    p = worst.groupBy("candidate").agg(((1 + F.count_if(F.col("ref") >= F.col("t"))) / (F.count("*") + 1)).alias("p"))
    out = t.join(p, "candidate", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    running = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return out.select("candidate", "observed", "t", "place", F.max("p").over(running).alias("p_adjusted"))


def false_discovery(p_values: DataFrame, p: str = "p", key: str = "candidate") -> DataFrame:
    """Benjamini-Hochberg and Benjamini-Yekutieli q values; one row a test."""
    every = W.partitionBy()
    ranked = p_values.withColumns({"_rk": F.row_number().over(W.orderBy(p, key)), "_m": F.count("*").over(every)})
    down = W.orderBy(F.desc("_rk")).rowsBetween(W.unboundedPreceding, 0)
    harmonic = F.sum(1.0 / F.col("_rk")).over(every)
    out = ranked.withColumn("_h", harmonic).withColumn("_q", F.min(F.col(p) * F.col("_m") / F.col("_rk")).over(down))
    return out.select(key, p, F.least(F.lit(1.0), "_q").alias("q_bh"), F.least(F.lit(1.0), F.col("_q") * F.col("_h")).alias("q_by"))


# Where the methods are published.
LITERATURE = (
    ("stationary_bootstrap", "Politis and Romano (1994)", "10.1080/01621459.1994.10476870"),
    ("reality_check", "White (2000)", "10.1111/1468-0262.00152"),
    ("stepdown_max_t", "Romano and Wolf (2005)", "10.1111/j.1468-0262.2005.00615.x"),
    ("false_discovery_rate", "Benjamini and Hochberg (1995)", "10.1111/j.2517-6161.1995.tb02031.x"),
    ("false_discovery_rate_under_dependency", "Benjamini and Yekutieli (2001)", "10.1214/aos/1013699998"),
)


def digests(differentials: DataFrame) -> DataFrame:
    """One row: order-free digests of the differentials as given and of the joint sample, as rows, sums and exclusive ors of hashes.

    Values are hashed as doubles, with -0.0 as 0.0; a NaN is a missing value. Equal data have equal digests, in whatever order
    and partitions they come; a repeated row counts.
    """
    d = F.col("d").cast("double")
    plain = lambda df: df.select("date", "candidate", F.when(~F.isnan(d), d + 0.0).alias("d"))

    def of(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64("date", "candidate", "d")
        return plain(df).agg(F.count("*").alias(f"{name}_rows"), F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1))), F.lit(0)).alias(f"{name}_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"{name}_xor"))

    return of(differentials, "input").crossJoin(of(complete_cases(differentials), "joint"))  # a row each


def assumptions(differentials: DataFrame) -> DataFrame:
    """One row on what the tests take for granted of their input: rows without date or candidate, pairs of date and candidate
    that come more than once, missing values, dates given and dates that all candidates have, the first and the last of these."""
    missing = F.col("d").isNull() | F.isnan("d")
    pairs = differentials.groupBy("date", "candidate").agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"))
    without = F.col("date").isNull() | F.col("candidate").isNull()
    given = pairs.agg(
        F.coalesce(F.sum(F.when(without, F.col("n"))), F.lit(0)).alias("without_key"),
        F.count_if(~without & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_values"),
        F.count_distinct("date").alias("dates"),
    )
    joint = complete_cases(differentials).agg(F.count_distinct("date").alias("joint_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return given.crossJoin(joint)  # a row each


def report(differentials: DataFrame, design: BootstrapDesign) -> dict:
    """All tests on one bootstrap, with a check of what they assume and digests of what they were given; research only.

    Rows without a key and keys that repeat are refused: the joint sample has one value a candidate and date."""
    checked = assumptions(differentials).first().asDict()
    if checked["without_key"] or checked["repeated_keys"]:
        raise ValueError(f"{checked['without_key']} differentials without date or candidate, {checked['repeated_keys']} keys more than once")
    cases = complete_cases(differentials).persist()
    n = cases.select("t").distinct().count()
    design.validate(n)
    observed, means = observed_means(cases), resampled_means(cases, n, design).persist()
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row a candidate
    steps = step_down(means, observed)
    out = {
        "status": "research_only",
        "orders": [],
        "automatic_trading_changes": [],
        "design": asdict(design),
        "audit": rows(audit(differentials))[0],
        "intervals": rows(intervals(means, observed, design.confidence)),
        "reality_check": rows(reality_check(means, observed))[0],
        "step_down": rows(steps.withColumn("rejected", (F.col("p_adjusted") <= design.alpha) & (F.col("observed") > 0))),
        "false_discovery": rows(false_discovery(steps.select("candidate", F.col("p_adjusted").alias("p")))),
        "input_contract": "a positive differential: the candidate did better than a benchmark that was fixed before",
        "assumptions": {
            "checked": checked | {"blocks_in_sample": n / design.block_length},
            "unchecked": ["differentials are stationary and weakly dependent", "the block length was chosen before the data were seen", "a rejection in the past is no licence to trade"],
        },
        "literature": [{"method": m, "citation": c, "doi": d} for m, c, d in LITERATURE],
        "manifest": {"input": rows(digests(differentials))[0], "design": commitment(asdict(design)), "spark": differentials.sparkSession.version},
    }
    means.unpersist()
    cases.unpersist()
    return out


def differentials_of(performance: DataFrame, benchmark: str, date: str = "date") -> DataFrame:
    """Wide performance to long differentials: each column less the benchmark's."""
    names = [c for c in performance.columns if c not in (date, benchmark)]
    long = performance.select(F.col(date).alias("date"), F.col(benchmark).cast("double").alias("_b"), *[F.col(c).cast("double").alias(c) for c in names])
    return long.unpivot(["date", "_b"], names, "candidate", "v").select("date", "candidate", (F.col("v") - F.col("_b")).alias("d"))
