"""The forward record: frozen specifications, predictions and their scores."""

from __future__ import annotations

import hashlib
import json
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.columns import divided, pct_rank, ts
from panelforge.operators.panel import build
from panelforge.operators.portfolio import top_names
from panelforge.operators.universe import apply_sealed, eligible, funnel, sealed_bars
from panelforge.plans import dsl

# Keys that a digest leaves out, and when a record is stale or has enough entries for a verdict.
STAMPS = ("spec_sha256", "frozen_at")
STALE_DAYS, LEAST_MATURED = 6, 60
# Fixed value: the share of listed symbols that must be quoted in the session that is ranked.
LEAST_QUOTED = 0.95
FORWARD_WINDOWS = frozenset((3, 5, 10, 20, 21, 30, 60, 120))


def spec_digest(spec: dict) -> str:
    payload = {k: v for k, v in spec.items() if k not in STAMPS}
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# A record's status, a specification's keys, and its universe's keys with what they are called here.
STATUS = "research_only_forward_record_not_trading"
REQUIRED = ("name", "factors", "book_size", "holding_days", "round_trip_cost")
COMBINATION = "equal_weight_rank_average"
UNIVERSE = {
    "trailing_amount_window": "window", "minimum_trailing_median_amount": "least_amount", "minimum_prior_observations": "least_observations", "exclude_st": "exclude_st", "require_normal_trade_status": "normal_status",
}


def validate_spec(spec: dict, fields) -> None:
    """Refuse what is incomplete, can't be computed, or is not for research alone."""
    if spec.get("status", STATUS) != STATUS or spec.get("orders") or spec.get("automatic_trading_changes"):
        raise ValueError("specifications are for research only")
    missing = sorted(k for k in REQUIRED if k not in spec)
    if missing:
        raise ValueError(f"the specification lacks {', '.join(missing)}")
    if not isinstance(spec["factors"], dict) or not spec["factors"] or int(spec["book_size"]) < 1 or int(spec["holding_days"]) < 1 or float(spec["round_trip_cost"]) < 0:
        raise ValueError("a specification names factors, a book size and holding days from 1 on, and a cost from 0 on")
    if spec.get("combination", COMBINATION) != COMBINATION:
        raise ValueError(f"factors are combined by {COMBINATION} alone")
    for name, expr in spec["factors"].items():
        try:
            dsl.validate(expr, fields, spec.get("windows", FORWARD_WINDOWS))
        except ValueError as error:
            raise ValueError(f"factor {name}: {error}") from error


def universe_of(spec: dict) -> dict:
    """The arguments of ``universe.eligible`` that a specification's universe stands for; others of its keys describe it only."""
    return {UNIVERSE[k]: v for k, v in spec.get("universe", {}).items() if k in UNIVERSE}


def freeze_spec(spec: dict, path: str, frozen_at: str) -> dict:
    """Write a specification once, with its digest."""
    if os.path.exists(path):
        raise FileExistsError(path)
    out = {"status": STATUS} | spec
    out |= {"frozen_at": frozen_at, "spec_sha256": spec_digest(out)}
    write_json(out, path)
    return out


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("spec_sha256") != spec_digest(spec):
        raise ValueError("the specification was changed after it was frozen")
    return spec


def write_json(value, path: str) -> None:
    """Whole or not at all: a draft is put in the file's place."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.draft", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.draft", path)


def composite(panel: DataFrame, factors: dict[str, dict]) -> DataFrame:
    """``composite``: mean rank of the factors within the eligible names; null if any is."""
    names = [f"_f{i}" for i in range(len(factors))]  # whatever the factors are called
    out = dsl.evaluate(panel, dict(zip(names, factors.values())))
    ranked = out.withColumns({f"_r{n}": pct_rank(F.when(F.col("eligible"), F.col(n))) for n in names})
    total = reduce(lambda a, b: a + b, [F.col(f"_r{n}") for n in names]) / len(names)
    return ranked.withColumn("composite", total).drop(*[f"_r{n}" for n in names], *names)


def predictions(panel: DataFrame, factors: dict[str, dict], n: int, as_of=None) -> DataFrame:
    """The best n names by composite of a session, or of every session."""
    out = top_names(composite(panel, factors), "composite", n)
    picks = out.where("place is not null").select("date", "session_index", "symbol", "place", "composite")
    return picks if as_of is None else picks.where(F.col("date") == F.lit(as_of))


def entries(state: DataFrame, spec: dict, logged_at: str, as_of=None) -> DataFrame:
    """Log entries of one session, or of every one with an eligible name: the book's names with rank and close."""
    rows = state if as_of is None else state.where(F.col("date") == F.lit(as_of))
    best = top_names(rows, "composite", int(spec["book_size"]))
    pick = F.struct("place", F.struct("symbol", F.round("composite", 6).alias("composite_rank"), F.round("close", 4).alias("close")).alias("pick"))
    days = best.groupBy(F.col("date").alias("data_as_of")).agg(F.count_if("eligible").alias("eligible_names"), F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), pick))).alias("_p"))  # a book's names a session
    named = {"spec_name": spec["name"], "spec_sha256": spec["spec_sha256"], "logged_at": logged_at, "status": STATUS}
    out = days.where(F.size("_p") > 0).select("data_as_of", "eligible_names", F.col("_p.pick").alias("picks"), *[F.lit(v).alias(k) for k, v in named.items()], F.array().cast("array<string>").alias("orders"))
    return out.select("spec_name", "spec_sha256", "logged_at", "data_as_of", "eligible_names", "picks", "status", "orders")


def build_state(prices: DataFrame, spec: dict, listed: int | None = None, least_quoted: float = LEAST_QUOTED) -> tuple[DataFrame, dict]:
    """The panel with ``eligible`` and ``composite``, and the funnel of its last session.

    ``listed`` is the number of symbols there should be (those of ``prices`` if None). A session in which less than the share
    ``least_quoted`` of them is quoted is incomplete, and is refused; so are prices without rows.
    """
    panel = eligible(apply_sealed(build(prices)), **universe_of(spec))
    validate_spec(spec, panel.columns)
    last = panel.agg(F.max("date")).first()[0]
    if last is None:
        raise ValueError("prices have no rows")
    counts = funnel(panel, last).first().asDict()
    listed = counts["listed"] if listed is None else listed
    if counts["quoted"] < least_quoted * listed:
        raise ValueError(f"only {counts['quoted']} of {listed} listed symbols are quoted on {last}")
    return composite(panel, spec["factors"]), counts


def read_record(path: str) -> list[dict]:
    """Entries of a local record, one a session; lines that can't be read are left out."""
    rows = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                try:
                    rows.append(json.loads(line))
                except json.JSONDecodeError:
                    continue
    return [r for r in rows if isinstance(r, dict)]


def publish_pick(state: DataFrame, spec: dict, folder: str, published_at: str, computed_by: str, dry_run: bool = False) -> tuple[int, dict | None]:
    """Put the last session's best name on record, once: an exit code and the entry.

    0: written, only tried, or on record already with this name; 1: no name is eligible; 2: on record with another name, which stays.
    """
    today = state.where(F.col("date") == F.lit(state.agg(F.max("date")).first()[0]))
    best = top_names(today, "composite", 1).where("place = 1").first()  # one row
    if best is None:
        return 1, None
    entry = {
        "as_of": str(best["date"]), "symbol": best["symbol"], "buy_at": "open of the next session", "composite": round(best["composite"], 6), "close": None if best["close"] is None else round(best["close"], 4),
        "eligible_names": today.where("eligible").count(), "spec_sha256": spec["spec_sha256"], "published_at": published_at, "computed_by": computed_by, "status": STATUS, "orders": [],
    }
    if dry_run:
        return 0, entry
    record = os.path.join(folder, "picks.jsonl")
    same = [r for r in read_record(record) if (r.get("as_of"), r.get("spec_sha256")) == (entry["as_of"], entry["spec_sha256"])]
    if same:
        return (0 if same[0].get("symbol") == entry["symbol"] else 2), entry
    os.makedirs(folder, exist_ok=True)
    with open(record, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    write_json(entry, os.path.join(folder, "latest.json"))
    return 0, entry


def score_log(panel: DataFrame, picks: DataFrame, horizon: int, cost: float) -> DataFrame:
    """Matured predictions: book, universe and net return.

    Picks (date, session_index, symbol). A leg sealed at entry is dropped; a leg sealed down at its exit is held to the first
    session it can be sold in. The universe is what was eligible, sold at the nominal exit.
    """
    bars = sealed_bars(panel).select("session_index", "symbol", "open", "eligible", (F.col("sealed_up") | F.col("sealed_down")).alias("locked"), "sealed_down")
    # the first session from each on in which a name can be sold, found once by a reverse window
    sell = F.first(F.when(F.col("open").isNotNull() & ~F.col("sealed_down"), F.struct("session_index", "open")), ignorenulls=True)
    bars = bars.withColumn("sale", sell.over(W.partitionBy("symbol").orderBy("session_index").rowsBetween(0, W.unboundedFollowing)))
    last = bars.agg(F.max("session_index").alias("n"))
    due = picks.crossJoin(F.broadcast(last)).where(F.col("session_index") + horizon + 1 <= F.col("n")).drop("n")  # one row
    enter = bars.select(F.col("session_index").alias("entry"), "symbol", F.col("open").alias("buy"), "locked")
    leave = bars.select(F.col("session_index").alias("exit"), "symbol", F.col("open").alias("nominal"), "sale")
    legs = due.withColumns({"entry": F.col("session_index") + 1, "exit": F.col("session_index") + horizon + 1}).join(enter, ["entry", "symbol"]).join(leave, ["exit", "symbol"])
    legs = legs.where("not locked and sale is not null").withColumn("r", divided("sale.open", "buy") - 1)
    book = legs.groupBy("date").agg(F.avg("r").alias("book"), F.count("r").alias("legs"), F.count_if(F.col("sale.session_index") > F.col("exit")).alias("carried"))
    names = panel.select("date", "session_index", "symbol", "eligible").where("eligible").join(due.select("date").distinct(), "date")
    held = names.withColumns({"entry": F.col("session_index") + 1, "exit": F.col("session_index") + horizon + 1}).join(enter, ["entry", "symbol"]).join(leave, ["exit", "symbol"])
    universe = held.groupBy("date").agg(F.avg(divided("nominal", "buy") - 1).alias("universe"))
    return book.join(universe, "date").withColumn("net", F.col("book") - F.col("universe") - cost)


def record_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("matured"), F.avg("net").alias("mean_net"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate")).withColumn("verdict", F.when(F.col("matured") >= LEAST_MATURED, "enough entries").otherwise("too few entries"))


def rotation(picks: DataFrame, panel: DataFrame, cost: float) -> DataFrame:
    """A one-name record: next-session return of the pick over the universe; the cost is paid when the name changes."""
    after = panel.withColumn("r", divided(F.lead("open", 2).over(ts()), F.lead("open", 1).over(ts())) - 1)
    mean = after.where("eligible").groupBy("date").agg(F.avg("r").alias("universe"))
    rows = picks.select("date", "symbol").join(after.select("date", "symbol", "r"), ["date", "symbol"]).join(mean, "date")
    line = W.orderBy("date")  # one row a session
    rotated = F.coalesce(F.col("symbol") != F.lag("symbol").over(line), F.lit(True))
    rows = rows.withColumn("rotated", rotated)
    return rows.withColumn("excess", F.col("r") - F.col("universe") - F.when(F.col("rotated"), F.lit(cost)).otherwise(0.0))


def compounded(rows: DataFrame, value: str = "excess") -> DataFrame:
    """Cumulative product over sessions; gaps carry the level."""
    line = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a session
    return rows.withColumn("level", F.product(F.coalesce(1 + F.col(value), F.lit(1.0))).over(line))


def span_return(index: DataFrame, entry: str, exit_: str) -> DataFrame:
    """Returns of an index (date, open, close) from the entry's open to the exit's close, for the named dates."""
    e, x = index.where(F.col("date") == F.lit(entry).cast("date")).select("open"), index.where(F.col("date") == F.lit(exit_).cast("date")).select("close")
    return e.crossJoin(x).select((divided("close", "open") - 1).alias("span_return"))  # a row each


def staleness(picks: DataFrame, today: str) -> DataFrame:
    days = F.datediff(F.lit(today).cast("date"), F.max("date"))
    return picks.agg(days.alias("days"), (days > STALE_DAYS).alias("stale"))

