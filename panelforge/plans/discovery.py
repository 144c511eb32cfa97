"""Search for factors and their evaluation under guards.

The driver holds expressions, scores and verdicts; every number comes from a job over the panel. Seeds are scored in
one wide job. Later candidates depend on the scores before them; they are scored a frontier of guesses at a time.
"""

from __future__ import annotations

import hashlib
import subprocess
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import corr, pct_rank
from panelforge.operators import evaluate, overfit, placebos, portfolio, universe, validate
from panelforge.operators.doctor import digest
from panelforge.operators.panel import build, labels
from panelforge.operators.pit import align
from panelforge.plans import dsl
from panelforge.plans.dsl import binary, f, lag, roll, unary

ZSCORE, MEAN, LAG, MUL, ADD = range(5)
OPERATION_WINDOWS = (5, 10, 20, 60, 120)
#: Placebos that a candidate's own PBO takes.
PBO_PLACEBOS = 20


@dataclass
class Candidate:
    """An expression with its birth certificate."""

    expr: dict
    origin: str
    parents: tuple[str, ...] = ()
    counters: tuple[dict, ...] = ()
    phenomenon: str = ""
    mechanism: str = ""
    generation: int = 0
    fields: list[str] = field(init=False)
    id: str = field(init=False)

    def __post_init__(self):
        self.id, self.fields = dsl.identifier(self.expr), sorted(dsl.fields_used(self.expr))

    def certificate(self) -> dict:
        """What is known at birth, with a digest of it."""
        born = {
            "id": self.id,
            "expression_sha256": hashlib.sha256(dsl.canonical(self.expr).encode()).hexdigest(),
            "origin": self.origin,
            "parents": list(self.parents),
            "generation": self.generation,
            "phenomenon": self.phenomenon,
            "mechanism": self.mechanism,
        }
        return born | {"certificate_sha256": overfit.commitment(born), "expression": self.expr, "fields": self.fields, "counter_expressions": list(self.counters)}


def seed_table() -> list[tuple[str, str, str, dict, tuple[dict, ...]]]:
    """(name, phenomenon, mechanism, expression, counter-expressions) of every seed."""
    ret, amount, close = f("returns"), unary("signed_log1p", f("amount")), f("close")

    def momentum(n):
        return roll("sum", ret, n)

    def reversal(n):
        return unary("neg", momentum(n))

    def low_beta(n):
        return unary("neg", {"corr": True, "left": ret, "right": f("market_return"), "window": n})

    def calm(n):
        return unary("neg", roll("std", ret, n))

    def place(n):
        return binary("div", close, roll("max", close, n))

    def year_old(name):
        return lag(252, f(name))

    quality, value, growth = f("quality_composite"), f("book_to_price"), f("growth_composite")
    # The seeds' names, phenomena, mechanisms, windows and counters.
    return [
        ("momentum_20", "information_diffusion", "underreaction", momentum(20), (momentum(60),)),
        ("reversal_5", "liquidity_reversal", "temporary_price_pressure", reversal(5), (reversal(20),)),
        ("low_beta_60", "risk_budgeting", "leverage_constraint", low_beta(60), (low_beta(20),)),
        ("low_volatility_20", "volatility_feedback", "risk_budgeting", calm(20), (calm(60),)),
        ("liquidity_20", "order_splitting", "persistent_flow", roll("mean", amount, 20), (roll("mean", amount, 60),)),
        ("range_position", "crowding_unwind", "breakout_or_crowding", place(120), (place(60),)),
        ("book_to_price", "value_repricing", "valuation_dispersion", value, (year_old("book_to_price"),)),
        ("earnings_yield_proxy", "value_repricing", "earnings_anchor", f("earnings_yield_proxy"), (year_old("earnings_yield_proxy"),)),
        ("quality", "fundamental_diffusion", "persistent_profitability", quality, (year_old("quality_composite"),)),
        ("growth", "fundamental_diffusion", "slow_information_diffusion", growth, (year_old("growth_composite"),)),
        ("financial_safety", "risk_budgeting", "distress_avoidance", f("safety_composite"), (year_old("safety_composite"),)),
        ("cash_conversion", "fundamental_diffusion", "accrual_mispricing", f("cash_to_profit"), (year_old("cash_to_profit"),)),
        ("quality_low_beta", "conditional_quality", "quality_under_risk_constraints", binary("mul", quality, low_beta(60)), (quality, low_beta(60))),
        ("quality_momentum", "conditional_quality", "quality_information_diffusion", binary("mul", quality, momentum(20)), (quality, momentum(20))),
        ("quality_per_volatility", "conditional_quality", "risk_adjusted_quality", binary("div", quality, roll("std", ret, 20)), (quality, calm(20))),
        ("value_reversal", "conditional_value", "forced_sale_recovery", binary("mul", value, reversal(5)), (value, reversal(5))),
        ("value_momentum", "conditional_value", "value_catalyst", binary("mul", value, momentum(20)), (value, momentum(20))),
        ("growth_momentum", "conditional_growth", "growth_diffusion", binary("mul", growth, momentum(20)), (growth, momentum(20))),
    ]


def seeds(columns) -> list[Candidate]:
    """Starting expressions for the fields that the panel has, each with the counter-expressions it must beat."""
    has = set(columns)
    return [Candidate(e, f"seed:{n}", (), c, p, m) for n, p, m, e, c in seed_table() if dsl.fields_used(e) <= has]


def child(attempt: int, parents: list[Candidate]) -> Candidate:
    """The next candidate: operation and window follow from the attempt's number, parents from the ranking."""
    op, window = attempt % 5, OPERATION_WINDOWS[attempt % 5]
    a, b = parents[attempt % len(parents)], parents[(attempt // 5 + 1) % len(parents)]
    expr = {
        ZSCORE: {"zscore": True, "arg": a.expr, "window": window},
        MEAN: roll("mean", a.expr, window),
        LAG: lag(window, a.expr),
        MUL: binary("mul", a.expr, unary("tanh", b.expr)),
        ADD: binary("add", a.expr, b.expr),
    }[op]
    both = (a, b) if op in (MUL, ADD) else (a,)
    return Candidate(expr, f"operation:{op}", tuple(c.id for c in both), a.counters or (a.expr,), a.phenomenon, a.mechanism, 1 + max(c.generation for c in both))


def train_scores(panel: DataFrame, candidates: list[Candidate], least: int = 60) -> dict[str, float | None]:
    """Mean rank IC of each candidate on the training sessions, all in one job."""
    rows = dsl.evaluate(panel, {c.id: c.expr for c in candidates}).where("segment = 'train'")
    ranked = rows.select("date", pct_rank("target").alias("_t"), *[pct_rank(F.when(F.col("target").isNotNull(), F.col(c.id))).alias(c.id) for c in candidates])
    days = ranked.groupBy("date").agg(*[corr(c.id, "_t").alias(c.id) for c in candidates])
    r = days.agg(*[F.avg(c.id).alias(c.id) for c in candidates], *[F.count(c.id).alias(f"n_{c.id}") for c in candidates]).first()
    return {c.id: r[c.id] if r[f"n_{c.id}"] >= least else None for c in candidates}


#: Children that are scored together ahead of their turn.
AHEAD = 16


def _ranked(known: dict[str, Candidate], scores: dict[str, float | None], pool: int) -> list[Candidate]:
    return sorted(known.values(), key=lambda c: (-abs(scores[c.id] or 0.0), c.id))[:pool]


def _frontier(attempt: int, last: int, parents: list[Candidate], seen: set[str], allowed, most: int) -> list[Candidate]:
    """The children that the next attempts would give if the ranking stayed as it is: new and allowed ones, each once."""
    out: dict[str, Candidate] = {}
    for k in range(attempt, last):
        if len(out) == most:
            break
        new = child(k, parents)
        if new.id not in seen and new.id not in out and allowed(new.expr) is None:
            out[new.id] = new
    return list(out.values())


def generate(panel: DataFrame, budget: int, pool: int, windows=dsl.WINDOWS, ahead: int = AHEAD) -> tuple[list[Candidate], dict[str, float], list[dict]]:
    """Candidates, their scores and the ledger of trials; at most 30 attempts a place in the budget.

    Which child an attempt gives depends on all scores before it. Children are scored ``ahead`` at a time on the guess that the
    ranking of parents stays: one job, in which expressions that children share are computed once. Attempts then follow in their
    order, and one whose child was not guessed begins the next frontier, so results are those of one job a child. Scores
    that were guessed for nothing are in no result.
    """
    numeric = [n for n, t in panel.dtypes if t in ("double", "bigint", "int") and n not in ("target", "one_day")]

    def refusal(expr: dict) -> str | None:
        try:
            dsl.validate(expr, numeric, windows)
        except ValueError as error:
            return str(error)
        return None

    known = {c.id: c for c in seeds(numeric)[:budget]}
    for c in known.values():
        dsl.validate(c.expr, numeric, windows)
    guessed = train_scores(panel, list(known.values()))
    scores = dict(guessed)
    ledger = [c.certificate() | {"train_ic": scores[c.id]} for c in known.values()]
    for attempt in range(budget * 30):
        if len(known) >= budget:
            break
        parents = _ranked(known, scores, pool)
        new = child(attempt, parents)
        if new.id in known:
            continue
        refused = refusal(new.expr)
        if refused is not None:
            ledger.append({"id": new.id, "rejected": refused})
            continue
        if new.id not in guessed:
            guessed |= train_scores(panel, _frontier(attempt, budget * 30, parents, set(known) | set(guessed), refusal, min(ahead, budget - len(known))))
        known[new.id], scores[new.id] = new, guessed[new.id]
        ledger.append(new.certificate() | {"train_ic": scores[new.id]})
    return list(known.values()), scores, ledger


def _first(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r is not None else {}


# The status that a configuration carries, its keys without a default, the defaults of others, and the guards' limits by key.
STATUS = "research_only_not_trading"
REQUIRED = (
    "prediction_horizon_days", "purge_days", "validation_days", "shadow_days", "minimum_train_days", "round_trip_cost", "candidate_budget", "stage2_budget", "pbo_blocks", "pbo_maximum", "placebo_repetitions", "minimum_train_rank_ic",
    "minimum_positive_walk_forward_folds", "permutation_alpha", "maximum_counter_correlation", "maximum_factor_behavior_correlation", "dsr_probability_minimum", "previous_research_trials", "random_seed",
)
DEFAULTS = {"require_neutralization_data": True, "minimum_daily_amount": 0.0, "maximum_amount_participation": 0.01, "parent_pool_size": 8, "walk_forward_folds": 3}
LIMITS = {
    "min_train_ic": "minimum_train_rank_ic", "max_counter_correlation": "maximum_counter_correlation", "alpha": "permutation_alpha", "max_pbo": "pbo_maximum", "min_dsr": "dsr_probability_minimum",
    "min_positive_folds": "minimum_positive_walk_forward_folds",
}


def checked_config(config: dict) -> dict:
    """The configuration with its defaults; refused if it is not for research, lacks a key or purges less than the labels' horizon."""
    if config.get("status") != STATUS or config.get("orders") or config.get("automatic_trading_changes"):
        raise ValueError("only research is supported")
    missing = sorted(k for k in REQUIRED if k not in config)
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    if config["purge_days"] < config["prediction_horizon_days"]:
        raise ValueError("the purge is at least as long as the labels' horizon")
    return DEFAULTS | config


def limits_of(config: dict) -> dict:
    return {guard: config[key] for guard, key in LIMITS.items()}


def run(prices: DataFrame, statements: DataFrame | None, config: dict) -> dict:
    """Panel, split, search, evaluation, guards, manifest. Research only: orders stay empty."""
    config = checked_config(config)
    lacking = sorted({"industry", "market_cap"} - set(prices.columns))
    if config["require_neutralization_data"] and lacking:
        raise ValueError(f"neutral books need {', '.join(lacking)}")
    spark, h, cost, limits = prices.sparkSession, config["prediction_horizon_days"], config["round_trip_cost"], limits_of(config)
    fundamentals = None
    base = build(prices, check=True)
    if statements is not None:
        fundamentals = align(statements, base.select("date", "symbol"))
        base = build(prices, fundamentals)
    sessions = validate.split(base.select("date", "session_index").distinct(), h, config["purge_days"], config["validation_days"], config["shadow_days"], config["minimum_train_days"])
    traded = universe.tradable(universe.eligible(universe.apply_sealed(base), 60), config["minimum_daily_amount"])
    panel = labels(traded, h).join(F.broadcast(sessions.select("date", "segment")), "date").persist()
    plan = _first(evaluate.phenomena(panel.where("segment = 'train'")))
    audit = [r.asDict() for r in sessions.groupBy("segment").agg(F.count("*").alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last")).orderBy("segment").collect()]
    candidates, scores, ledger = generate(panel, config["candidate_budget"], max(2, config["parent_pool_size"]))

    by_id = {c.id: c for c in candidates}
    scored = {i: s for i, s in scores.items() if s is not None}
    shortlist = sorted(scored, key=lambda i: (-abs(scored[i]), i))[: 4 * config["stage2_budget"]]
    signals = dsl.evaluate(panel, {i: by_id[i].expr for i in shortlist}).where("segment = 'train'")
    pairs = {(r["a"], r["b"]): r["correlation"] for r in overfit.pairwise_correlations(signals, shortlist).collect()} if len(shortlist) > 1 else {}
    stage2 = overfit.prune({i: scored[i] for i in shortlist}, pairs, config["stage2_budget"], config["maximum_factor_behavior_correlation"])
    pruned = [{"id": i, "correlated_with": [k for k in stage2 if abs(pairs.get(tuple(sorted((i, k)))) or 0.0) >= config["maximum_factor_behavior_correlation"]]} for i in shortlist if i not in stage2]

    rows, books, shadow = [], [], []
    for i in stage2:
        c, sign = by_id[i], 1 if scored[i] >= 0 else -1
        named = dsl.evaluate(panel, {"_raw": c.expr, **{f"_counter{k}": e for k, e in enumerate(c.counters)}}).withColumn("signal", F.col("_raw") * sign)
        weights = portfolio.tranches(portfolio.neutral_weights(named, "signal"), h).persist()
        book = portfolio.daily(weights, cost, config["maximum_amount_participation"]).join(sessions.select("date", "segment"), "date")
        seen = book.where("segment = 'validation'")
        stats = _first(evaluate.return_stats(seen))
        row = {"id": i, "train_ic": scored[i], "direction": sign, "mean": stats.get("mean"), "ir": stats.get("ir"), "validation": stats, "gross": _first(evaluate.return_stats(seen, "gross"))}
        row |= _first(seen.agg(F.avg("turnover").alias("turnover_mean"), F.percentile("capacity", F.lit(0.5)).alias("capacity_median")))
        counters, counter_books = [], []
        for k in range(len(c.counters)):
            direction = _first(evaluate.train_score(named.where("segment = 'train'"), f"_counter{k}", "target"))
            if direction.get("direction") is None:
                continue  # too few sessions to learn its direction from
            turned = named.withColumn("_c", F.col(f"_counter{k}") * direction["direction"])
            own = portfolio.neutral_book(turned, "_c", h, cost).join(sessions.select("date", "segment"), "date").where("segment = 'validation'")
            counter_books.append(own.select("date", F.lit("counter").alias("candidate"), F.col("costed").alias("d")))
            counters.append(_first(evaluate.return_stats(own)) | {"correlation": _first(evaluate.signal_correlation(turned.where("segment = 'validation'"), "signal", "_c")).get("correlation")})
        strongest = max(range(len(counters)), key=lambda k: counters[k]["ir"] if counters[k].get("ir") is not None else float("-inf"), default=None)
        best = {} if strongest is None else counters[strongest]
        row |= {"counter_mean": best.get("mean"), "counter_correlation": best.get("correlation")}
        shuffled = placebos.placebo_returns(weights.where("segment = 'validation'"), h, cost, config["placebo_repetitions"], config["random_seed"] ^ int(i[-8:], 16)).persist()
        row["permutation_p"] = _first(placebos.permutation_p(placebos.statistics(shuffled))).get("p_value")
        # the candidate against its strongest counter and its first placebos: how often is it best in one half and poor in the other
        rivals = placebos.by_repetition(shuffled, PBO_PLACEBOS).where("repetition > 0").select("date", F.concat(F.lit("placebo_"), F.col("repetition").cast("string")).alias("candidate"), F.col("costed").alias("d"))
        own = seen.select("date", F.lit("primary").alias("candidate"), F.col("costed").alias("d")).unionByName(rivals)
        if strongest is not None:
            own = own.unionByName(counter_books[strongest])
        row["factor_pbo"] = _first(overfit.pbo(own, config["pbo_blocks"], focus="primary")).get("pbo")
        shuffled.unpersist()
        folds = validate.walk_forward(named.where("segment = 'train'"), "signal", "target", h, config["purge_days"], config["walk_forward_folds"], cost).collect()
        row |= {"walk_forward": [r.asDict() for r in folds], "positive_folds": sum(1 for r in folds if r["mean"] and r["mean"] > 0)}
        row["cost_curve"] = [r.asDict() for r in portfolio.cost_curve(seen).orderBy("cost").collect()]
        row["ic_decay"] = [r.asDict() for r in evaluate.ic_decay(named.where("segment = 'validation'"), "signal").orderBy("horizon").collect()]
        row["monotonicity"] = _first(evaluate.monotonicity(evaluate.quintile_means(named.where("segment = 'validation'"), "signal", "target"))).get("monotonicity")
        unseen = book.where("segment = 'shadow'")
        shadow.append({"id": i, "costed": _first(evaluate.return_stats(unseen)), "gross": _first(evaluate.return_stats(unseen, "gross"))})
        weights.unpersist()
        books.append(seen.select("date", F.lit(i).alias("candidate"), F.col("costed").alias("d")))
        rows.append(row)

    project_pbo, dsr, declared = None, {}, config["previous_research_trials"] + len(candidates)
    if books:
        family = reduce(DataFrame.unionByName, books).persist()
        if len(books) > 1:
            project_pbo = _first(overfit.pbo(family, config["pbo_blocks"])).get("pbo")
        dsr = {r["candidate"]: r["probability"] for r in overfit.deflated_sharpes(family, declared=declared).collect()}
        family.unpersist()
    for row in rows:
        row |= {"project_pbo": project_pbo, "dsr": dsr.get(row["id"])}
        row["guards"] = overfit.guards(row, limits)
        row["survivor"] = all(row["guards"].values())
    # without a passing family no candidate survives
    hard_stop = None if project_pbo is not None and project_pbo <= limits["max_pbo"] else "the family's PBO failed: no survivors"
    for row in rows:
        row["survivor"] = row["survivor"] and not hard_stop
    panel.unpersist()
    return {
        "status": "research_only", "orders": [], "automatic_trading_changes": [], "candidates": rows, "survivors": [r["id"] for r in rows if r["survivor"]], "trial_ledger": ledger, "project_pbo": project_pbo, "hard_stop": hard_stop,
        "research_plan": plan, "split": audit, "pruned": pruned, "shadow_commitment": overfit.commitment(shadow), "previous_research_trials": config["previous_research_trials"], "declared_trials": declared,
        "train_correlations": {f"{a}|{b}": r for (a, b), r in sorted(pairs.items()) if a in stage2 and b in stage2}, "births": [c.certificate() for c in candidates],
        "manifest": {"config": overfit.commitment(config), "prices": digest(prices), "statements": digest(statements) if statements is not None else None, "spark": spark.version, "commit": _commit()},
    }


def _commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        return None


__all__ = ["Candidate", "child", "generate", "run", "seeds", "train_scores"]
