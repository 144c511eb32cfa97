"""Sources and sinks: CSV, JSON lines, performance tables, a connector by symbol, synthetic markets."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelforge.functions.columns import finite
from panelforge.sources.shared import fresh_folder

DATE_NAMES = ("date", "dt", "day")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text; ``panel.ingest`` coerces what it needs. Parquet by its ending."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)


def read_performance(spark: SparkSession, path: str, benchmark: str, date: str = "date") -> DataFrame:
    """A wide table of returns to differentials against one of its columns."""
    from panelforge.operators.evidence import differentials_of

    wide = spark.read.option("header", True).csv(path)
    return differentials_of(wide.select(F.to_date(date).alias(date), *[finite(F.col(c).try_cast("double")).alias(c) for c in wide.columns if c != date]), benchmark, date)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """A wide table of returns: the date column found by name, empty columns left out, percentages scaled down."""
    wide = spark.read.option("header", True).csv(path)
    date = next((c for c in wide.columns if c.lower() in DATE_NAMES), None)
    if date is None:
        raise ValueError(f"no column named {', '.join(DATE_NAMES)}")
    return scaled_returns(wide.select(F.to_date(date).alias("date"), *[finite(F.col(c).try_cast("double")).alias(c) for c in wide.columns if c != date]))


def scaled_returns(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "date"]
    r = wide.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)], F.max(F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in names], F.lit(0.0))).alias("most")).first()
    full = [c for i, c in enumerate(names) if r[f"n{i}"]]
    return wide.select("date", *[(F.col(c) / (100.0 if (r["most"] or 0) > 1.5 else 1.0)).alias(c) for c in full])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


BARS = "date date, symbol string, open double, high double, low double, close double, volume double, amount double"


@dataclass(frozen=True)
class Limits:
    """What a fetch may use: seconds for all of it and for one call, tries a symbol, and the share of failures that opens the circuit."""

    budget_s: float = 3300.0
    call_s: float = 45.0
    retries: int = 2
    most_failed: float = 0.5
    least_tried: int = 8
    chunk: int = 50


class BySymbol(DataSource):
    """A connector that asks a vendor for each symbol's bars, one partition a chunk of symbols.

    The plan holds one deadline, so the budget is that of all partitions together, whenever they start. Every symbol leaves a
    partition either with its bars or as one row with its ``problem``. The fetching function is given to ``fetched``.
    """

    fetch: Callable[[str], list[tuple]] | None = None
    symbols: tuple[str, ...] = ()
    limits: Limits = Limits()

    @classmethod
    def name(cls) -> str:
        return "by_symbol"

    def schema(self) -> str:
        return f"{BARS}, problem string"

    def reader(self, schema) -> DataSourceReader:
        own = type(self)
        return _BySymbolReader(own.fetch, own.symbols, own.limits)


class _Chunk(InputPartition):
    def __init__(self, symbols: tuple[str, ...], deadline: float):
        self.symbols, self.deadline = symbols, deadline


class _Circuit:
    """Open once more than a share of the symbols tried so far have failed."""

    def __init__(self, limits: Limits):
        self.limits, self.tried, self.failed = limits, 0, 0

    def seen(self, ok: bool) -> None:
        self.tried += 1
        self.failed += not ok

    def is_open(self) -> bool:
        return self.tried >= self.limits.least_tried and self.failed > self.limits.most_failed * self.tried


class _BySymbolReader(DataSourceReader):
    def __init__(self, fetch, symbols: tuple[str, ...], limits: Limits):
        self.fetch, self.symbols, self.limits = fetch, symbols, limits

    def partitions(self) -> list[InputPartition]:
        deadline, n = time.time() + self.limits.budget_s, self.limits.chunk
        return [_Chunk(self.symbols[i : i + n], deadline) for i in range(0, len(self.symbols), n)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        circuit, again = _Circuit(self.limits), {}
        for symbol in partition.symbols:
            rows, problem = self._tried(symbol, partition.deadline, circuit, 1 + self.limits.retries)
            if rows is None:
                again[symbol] = problem
            else:
                yield from rows
        for symbol, problem in again.items():  # a last sweep, one call each, while the circuit is closed
            rows, later = self._tried(symbol, partition.deadline, circuit, 1)
            if rows is None:
                yield (None, symbol, *[None] * 6, problem if later in ("out of time", "circuit open") and problem != later else later)
            else:
                yield from rows

    def _tried(self, symbol: str, deadline: float, circuit: _Circuit, tries: int) -> tuple[list[tuple] | None, str]:
        problem = "out of time"
        for _ in range(tries):
            left = deadline - time.time()
            if left <= 0:
                return None, problem
            if circuit.is_open():
                return None, "circuit open" if problem == "out of time" else problem
            try:
                rows = _within(self.fetch, symbol, min(left, self.limits.call_s))
            except TimeoutError:
                problem = "timed out"
            except OSError as error:
                problem = f"failed: {error}"
            except Exception as error:  # an answer that can't be read is the symbol's problem, not the run's
                circuit.seen(True)
                return None, f"unreadable: {error}"
            else:
                circuit.seen(True)
                if not rows:
                    return None, "no bars"
                try:
                    return [(r[0], symbol, *map(_number, r[2:8]), None) for r in rows], ""
                except (TypeError, ValueError, IndexError) as error:
                    return None, f"unreadable: {error}"
        circuit.seen(False)
        return None, problem


def _number(value) -> float | None:
    return None if value is None else float(value)


def _within(fetch: Callable[[str], list[tuple]], symbol: str, seconds: float) -> list[tuple]:
    """The call's answer, or TimeoutError; a call that hangs is left behind in its thread."""
    answer: queue.Queue = queue.Queue()

    def call() -> None:
        try:
            answer.put((list(fetch(symbol)), None))
        except BaseException as error:  # handed to the caller
            answer.put((None, error))

    threading.Thread(target=call, daemon=True).start()
    try:
        rows, error = answer.get(timeout=max(seconds, 0.001))
    except queue.Empty:
        raise TimeoutError(symbol) from None
    if error is not None:
        raise error
    return rows


def fetched(spark: SparkSession, fetch: Callable[[str], list[tuple]], symbols: list[str], limits: Limits = Limits(), least_symbols: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """Bars, and the quarantine: (symbol, problem) of every symbol left out. Each symbol is in exactly one of them.

    A vendor is asked once: answers are written to the shared folder first. Raises if less than the share ``least_symbols``
    of the symbols has bars. Symbols named twice are asked for once; without symbols both are empty.
    """
    names = tuple(dict.fromkeys(symbols))
    if not names:
        return spark.createDataFrame([], BARS), spark.createDataFrame([], "symbol string, problem string")
    kind = type("BySymbolWith", (BySymbol,), {"fetch": staticmethod(fetch), "symbols": names, "limits": limits})
    spark.dataSource.register(kind)
    folder = fresh_folder(spark, "fetched")
    spark.read.format("by_symbol").load().write.parquet(folder)
    answers = spark.read.schema(f"{BARS}, problem string").parquet(folder)
    out = answers.where("problem is not null").select("symbol", "problem")
    left_out = out.count()
    if len(names) - left_out < least_symbols * len(names):
        problems = {r["problem"].split(":")[0]: r["count"] for r in out.withColumn("problem", F.substring_index("problem", ":", 1)).groupBy("problem").count().collect()}
        raise ValueError(f"{left_out} of {len(names)} symbols have no bars: {problems}")
    return answers.where("problem is null").drop("problem"), out


def coverage(bars: DataFrame, expected_symbols: int, least_symbols: float = 0.98, least_quoting: float = 0.95) -> DataFrame:
    """Share of expected symbols with any bar, smallest share quoting in a session, and whether both suffice."""
    days = bars.groupBy("date").agg(F.count_if(F.col("close").isNotNull()).alias("quoting"))
    out = bars.where("close is not null").agg(F.count_distinct("symbol").alias("symbols")).crossJoin(days.agg(F.min("quoting").alias("quoting")))  # a row each
    out = out.select((F.col("symbols") / expected_symbols).alias("symbol_coverage"), (F.col("quoting") / expected_symbols).alias("session_coverage"))
    return out.withColumn("passes", (F.col("symbol_coverage") >= least_symbols) & (F.col("session_coverage") >= least_quoting))


def synthetic_market(spark: SparkSession, days: int = 650, symbols: int = 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Prices and statements of a made-up market with a weak momentum: a task a symbol, seeded by it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dates = pd.bdate_range("2020-01-01", periods=days)
        market = np.random.default_rng(seed).standard_normal(days) * 0.008
        for pdf in batches:
            for k in pdf["id"]:
                rng = np.random.default_rng(seed * 100_003 + int(k))
                r = market + rng.standard_normal(days) * 0.015
                r[1:] += 0.05 * r[:-1]
                close = 20 * np.exp(np.cumsum(r)) * (1 + k / 50)
                open_ = close * np.exp(rng.standard_normal(days) * 0.004)
                high, low = np.maximum(open_, close) * (1 + rng.random(days) * 0.01), np.minimum(open_, close) * (1 - rng.random(days) * 0.01)
                volume = np.floor(np.exp(rng.standard_normal(days) * 0.3 + 13))
                out = pd.DataFrame({"date": dates.date, "symbol": f"S{int(k):04d}", "open": open_, "high": high, "low": low, "close": close, "volume": volume, "amount": volume * close})
                yield out.assign(market_cap=close * 1e8 * (1 + k % 7), industry=f"industry_{int(k) % 4}", is_st=False, is_suspended=False, limit_up=False, limit_down=False, trade_status=1.0)

    schema = "date date, symbol string, open double, high double, low double, close double, volume double, amount double, market_cap double, industry string, is_st boolean, is_suspended boolean, limit_up boolean, limit_down boolean, trade_status double"
    prices = spark.range(symbols).repartition(max(1, symbols // 50)).mapInPandas(run, schema)
    quarters = days // 63
    rows = spark.range(symbols * quarters).select((F.col("id") % symbols).alias("k"), F.floor(F.col("id") / symbols).alias("q"))
    report = F.date_add(F.lit("2019-12-31").cast("date"), (F.col("q") * 91).cast("int"))
    noise = F.pmod(F.xxhash64(F.lit(seed), "k", "q"), F.lit(1000)) / 1000
    statements = rows.select(
        F.format_string("S%04d", "k").alias("symbol"), report.alias("report_date"), F.date_add(report, 40).alias("notice_date"), F.date_add(report, 45).alias("update_date"),
        (0.5 + noise).alias("eps_ytd"), (5 + 3 * noise).alias("bps"), (noise / 5).alias("roe"), (noise / 4).alias("roic"), (0.2 + noise / 3).alias("gross_margin"), (0.5 + noise).alias("cash_to_profit"),
    )
    return prices, statements


def demo_config() -> dict:
    # A small run.
    return {
        "status": "research_only_not_trading", "prediction_horizon_days": 10, "purge_days": 10, "validation_days": 126, "shadow_days": 126, "minimum_train_days": 252, "round_trip_cost": 0.003, "candidate_budget": 8,
        "stage2_budget": 3, "parent_pool_size": 4, "walk_forward_folds": 3, "minimum_positive_walk_forward_folds": 2, "pbo_blocks": 8, "pbo_maximum": 0.2, "placebo_repetitions": 20, "permutation_alpha": 0.05, "random_seed": 7,
        "minimum_train_rank_ic": 0.005, "maximum_counter_correlation": 0.9, "maximum_factor_behavior_correlation": 0.85, "dsr_probability_minimum": 0.95, "previous_research_trials": 0, "require_neutralization_data": True,
    }


def noise_world(spark: SparkSession, factors: int, sessions: int, seed: int = 0) -> DataFrame:
    """Daily returns of factors that are nothing but noise: (factor, t, r)."""
    rows = spark.range(factors * sessions).select(F.floor(F.col("id") / sessions).alias("factor"), (F.col("id") % sessions).alias("t"))
    return rows.withColumn("r", F.randn(seed) * 0.01)


