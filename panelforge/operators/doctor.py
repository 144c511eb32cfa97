"""Checks of research data before use; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.panel import PRICE_COLUMNS

# Names that give the future away, and limits.
FUTURE_WORDS = ("future", "forward", "next", "lead", "target", "label", "outcome", "tomorrow")
MOST_INCOMPLETE, LEAST_SESSIONS = 0.10, 300
EXIT = {"ready": 0, "ready_with_warnings": 0, "blocked": 2}


def key_check(prices: DataFrame) -> DataFrame:
    """Rows with a bad date or no symbol, rows beyond the first of a key, sessions and symbols."""
    date = F.to_date(F.try_to_timestamp(F.col("date").cast("string")))
    rows = prices.select(date.alias("date"), F.nullif(F.trim(F.col("symbol").cast("string")), F.lit("")).alias("symbol"))
    bad = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("date").isNull()).alias("bad_dates"), F.count_if(F.col("symbol").isNull()).alias("empty_symbols"), F.count_distinct("date").alias("sessions"), F.count_distinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    twice = rows.dropna().groupBy("date", "symbol").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return bad.crossJoin(twice)  # a row each


def bar_check(prices: DataFrame) -> DataFrame:
    """Bars with a missing measure, prices out of order, prices not above 0, negative activity."""
    c = {n: F.col(n).cast("double") for n in ("open", "high", "low", "close", "volume", "amount")}
    missing = F.lit(False)
    for v in c.values():
        missing = missing | v.isNull()
    order = (c["high"] < F.greatest(c["open"], c["close"], c["low"])) | (c["low"] > F.least(c["open"], c["close"], c["high"]))
    low = F.least(c["open"], c["high"], c["low"], c["close"])
    return prices.agg(
        F.count("*").alias("rows"), F.avg(missing.cast("double")).alias("incomplete_ratio"), F.count_if(F.coalesce(order, F.lit(False))).alias("out_of_order"), F.count_if(low <= 0).alias("nonpositive"), F.count_if((c["volume"] < 0) | (c["amount"] < 0)).alias("negative_activity")
    )


def statement_check(statements: DataFrame) -> DataFrame:
    """Statements without notice date, with a notice before the report, with an update before the notice, and duplicates."""
    bad = statements.agg(F.count("*").alias("rows"), F.count_if(F.col("notice_date").isNull()).alias("no_notice"), F.count_if(F.col("notice_date") < F.col("report_date")).alias("early_notice"), F.count_if(F.col("update_date") < F.col("notice_date")).alias("early_update"))
    twice = statements.groupBy("symbol", "report_date", "notice_date", "update_date").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return bad.crossJoin(twice)  # a row each


def column_checks(columns: list[str], need: tuple[str, ...] = PRICE_COLUMNS) -> dict:
    low = [c.lower() for c in columns]
    return {
        "missing": sorted(set(need) - set(columns)),
        "future_named": sorted(c for c in low if any(w in c for w in FUTURE_WORDS)),
        "neutralisation": {"industry", "market_cap"} <= set(low),
        "status": "trade_status" in low or "is_suspended" in low,
        "limits": {"limit_up", "limit_down"} <= set(low),
    }


def digest(df: DataFrame) -> str:
    """An order-free digest: number of rows and sums of two hashes of all columns."""
    cols = sorted(df.columns)
    h = F.xxhash64(*cols)
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("a"), F.bit_xor(h).alias("b")).first()
    return f"{r['n']}:{r['a']}:{r['b']}"


def audit(prices: DataFrame, statements: DataFrame | None = None, sessions_needed: int = LEAST_SESSIONS) -> dict:
    """All checks; at best ``ready_with_warnings``, since where data come from cannot be checked."""
    columns = column_checks(prices.columns)
    blocked, warnings = [], ["provenance of the data is not checked", "survivorship of the symbols is not checked"]
    if columns["missing"]:
        return {"status": "blocked", "blocked": [f"missing columns: {', '.join(columns['missing'])}"], "warnings": warnings, "columns": columns, "orders": [], "automatic_trading_changes": []}
    keys, bars = key_check(prices).first().asDict(), bar_check(prices).first().asDict()
    if keys["bad_dates"] or keys["empty_symbols"] or keys["duplicates"]:
        blocked.append("invalid or duplicate keys")
    if bars["out_of_order"] or bars["nonpositive"] or bars["negative_activity"] or (bars["incomplete_ratio"] or 0) > MOST_INCOMPLETE:
        blocked.append("bars without integrity")
    if keys["sessions"] < sessions_needed:
        blocked.append(f"{keys['sessions']} sessions; {sessions_needed} are needed")
    for k in ("neutralisation", "status", "limits"):
        if not columns[k]:
            (blocked if k == "limits" else warnings).append(f"no columns for {k}")
    if columns["future_named"]:
        warnings.append("columns named after the future: " + ", ".join(columns["future_named"]))
    out = {"keys": keys, "bars": bars, "columns": columns, "digest": digest(prices)}
    if statements is None:
        warnings.append("no statements")
    else:
        out["statements"] = s = statement_check(statements).first().asDict()
        if s["no_notice"] or s["early_notice"] or s["duplicates"]:
            blocked.append("statements without sound disclosure dates")
    return out | {"status": "blocked" if blocked else "ready_with_warnings", "blocked": blocked, "warnings": warnings, "orders": [], "automatic_trading_changes": []}
