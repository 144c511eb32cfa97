"""Command line: discover, doctor, evidence, forward, demo. Results are files; nothing is traded."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import platform
import sys

from pyspark.sql import SparkSession

from panelforge.operators import doctor, evidence, forward
from panelforge.plans import discovery
from panelforge.sources import readers, record_log


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _statements(spark: SparkSession, path: str | None):
    if not path:
        return None
    from pyspark.sql import functions as F

    raw = readers.read_prices(spark, path)
    dates = [c for c in ("report_date", "notice_date", "update_date") if c in raw.columns]
    return raw.select("symbol", *[F.to_date(c).alias(c) for c in dates], *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c not in ("symbol", *dates)])


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="panelforge")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("discover")
    for a in ("--prices", "--config", "--output"):
        p.add_argument(a, required=True)
    p.add_argument("--fundamentals")
    p = sub.add_parser("doctor")
    p.add_argument("--prices", required=True)
    for a in ("--fundamentals", "--config", "--output"):
        p.add_argument(a)
    p.add_argument("--strict-warnings", action="store_true")
    p = sub.add_parser("evidence")
    for a in ("--performance", "--benchmark", "--output"):
        p.add_argument(a, required=True)
    p.add_argument("--date-column", default="date")
    p.add_argument("--repetitions", type=int, default=999)
    p.add_argument("--expected-block-length", type=int, default=10)
    p.add_argument("--confidence", type=float, default=0.95)
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--random-seed", type=int, default=7)
    p = sub.add_parser("forward")
    p.add_argument("action", choices=("freeze", "log", "score", "publish"))
    p.add_argument("--spec", required=True)
    for a in ("--draft", "--prices", "--log", "--output"):
        p.add_argument(a)
    p.add_argument("--listed", type=int)
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("demo")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--days", type=int, default=650)
    p.add_argument("--symbols", type=int, default=20)
    p.add_argument("--seed", type=int, default=7)
    o = top.parse_args(args)
    if o.command == "forward" and o.action == "freeze":
        draft, frozen = (o.draft, o.spec) if o.draft else (o.spec, o.output)
        forward.freeze_spec(_json(draft), frozen, dt.datetime.now(dt.timezone.utc).isoformat())
        return 0
    spark = _session()
    if o.command == "discover":
        forward.write_json(discovery.run(readers.read_prices(spark, o.prices), _statements(spark, o.fundamentals), _json(o.config)), o.output)
    elif o.command == "doctor":
        found = doctor.audit(readers.read_prices(spark, o.prices), _statements(spark, o.fundamentals))
        if o.output:
            forward.write_json(found, o.output)
        print(found["status"])
        return 3 if o.strict_warnings and found["status"] != "blocked" and found["warnings"] else doctor.EXIT[found["status"]]
    elif o.command == "evidence":
        design = evidence.BootstrapDesign(o.repetitions, o.expected_block_length, o.confidence, o.alpha, o.random_seed)
        forward.write_json(evidence.report(readers.read_performance(spark, o.performance, o.benchmark, o.date_column), design), o.output)
    elif o.command == "forward" and o.action == "publish":
        spec = forward.load_spec(o.spec)
        state, funnel = forward.build_state(readers.read_prices(spark, o.prices), spec, o.listed)
        code, entry = forward.publish_pick(state, spec, o.output, dt.datetime.now(dt.timezone.utc).isoformat(), platform.node(), o.dry_run)
        print(json.dumps({"funnel": funnel, "entry": entry}, default=str))
        return code
    elif o.command == "forward":
        spec = forward.load_spec(o.spec)
        state, _ = forward.build_state(readers.read_prices(spark, o.prices), spec, o.listed, 0.0)
        state = state.persist()
        if o.action == "log":
            last = state.agg({"date": "max"}).first()[0]
            record_log.append_predictions(forward.entries(state, spec, dt.datetime.now(dt.timezone.utc).isoformat(), last), o.log)
        else:
            picks = record_log.logged_picks(record_log.read_log(spark, o.log), state, spec["spec_sha256"])
            scored = forward.score_log(state, picks, int(spec["holding_days"]), float(spec["round_trip_cost"]))
            forward.write_json({"status": forward.STATUS, "orders": [], "automatic_trading_changes": [], "summary": forward.record_summary(scored).first().asDict()}, o.output)
    else:
        prices, statements = readers.synthetic_market(spark, o.days, o.symbols, o.seed)
        readers.write_csv(prices, f"{o.output_dir}/prices")
        readers.write_csv(statements, f"{o.output_dir}/fundamentals")
        forward.write_json(readers.demo_config() | {"random_seed": o.seed}, f"{o.output_dir}/config.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
