"""Factor expressions: nested JSON, checked against allow-lists and compiled to columns of a panel.

Windows cannot hold windows, so every sub-expression with one becomes a column of its own, once for equal
sub-expressions. All of them share one order (symbol, date): one exchange and one sort.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import ROLLING, divided, rolling, rolling_corr, ts, zscore
from panelforge.functions.ranges import FRAMES_TO, rolling_median

UNARY = {"abs": F.abs, "neg": lambda c: -c, "tanh": F.tanh, "signed_log1p": lambda c: F.signum(c) * F.log1p(F.abs(c))}
BINARY = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divided}
KINDS = ("field", "unary", "binary", "rolling", "lag", "corr", "zscore")
WINDOWS = frozenset((3, 5, 10, 20, 60, 120, 252))
MOST_DEPTH, MOST_LAG = 8, 252


def f(name: str) -> dict:
    return {"field": name}


def unary(op: str, arg: dict) -> dict:
    return {"unary": op, "arg": arg}


def binary(op: str, left: dict, right: dict) -> dict:
    return {"binary": op, "left": left, "right": right}


def roll(op: str, arg: dict, window: int) -> dict:
    return {"rolling": op, "arg": arg, "window": window}


def lag(k: int, arg: dict) -> dict:
    return {"lag": k, "arg": arg}


def canonical(expr: dict) -> str:
    return json.dumps(expr, sort_keys=True, separators=(",", ":"))


def identifier(expr: dict) -> str:
    return "factor_" + hashlib.sha256(canonical(expr).encode()).hexdigest()[:20]


def children(expr: dict) -> list[dict]:
    return [expr[k] for k in ("arg", "left", "right") if k in expr]


def fields_used(expr: dict) -> set[str]:
    return {expr["field"]} if "field" in expr else set().union(*map(fields_used, children(expr)))


def validate(expr: dict, fields: Iterable[str], windows: Iterable[int] = WINDOWS, depth: int = MOST_DEPTH) -> None:
    """Raise if anything but allowed fields, operators, windows and lags occurs, or a node has several kinds."""
    if depth < 1:
        raise ValueError("expression too deep")
    if not isinstance(expr, dict) or len(kind := [k for k in KINDS if k in expr]) != 1:
        raise ValueError(f"a node has exactly one of {', '.join(KINDS)}")
    kind = kind[0]
    allowed = {"field": fields, "unary": UNARY, "binary": BINARY, "rolling": ROLLING}.get(kind)
    if allowed is not None and expr[kind] not in set(allowed):
        raise ValueError(f"{kind} {expr[kind]!r} is not allowed")
    if kind == "lag" and (isinstance(expr["lag"], bool) or not isinstance(expr["lag"], int) or not 0 <= expr["lag"] <= MOST_LAG):
        raise ValueError("a lag is a number of sessions from 0 to 252")
    if kind in ("rolling", "corr", "zscore") and expr.get("window") not in set(windows):
        raise ValueError(f"window {expr.get('window')!r} is not allowed")
    need = {"field": 0, "binary": 2, "corr": 2}.get(kind, 1)
    if len(children(expr)) != need:
        raise ValueError(f"{kind} takes {need} operands")
    for child in children(expr):
        validate(child, fields, windows, depth - 1)


def evaluate(panel: DataFrame, exprs: dict[str, dict]) -> DataFrame:
    """``panel`` with a column for each named expression."""
    made: dict[str, str] = {}
    keep = list(panel.columns)

    def compiled(expr: dict) -> Column:
        nonlocal panel
        key = canonical(expr)
        if key in made:
            return F.col(made[key])
        if "field" in expr:
            return F.col(expr["field"])
        args = [compiled(c) for c in children(expr)]
        if "unary" in expr:
            return UNARY[expr["unary"]](*args)
        if "binary" in expr:
            return BINARY[expr["binary"]](*args)
        if "lag" in expr:
            value = F.lag(args[0], expr["lag"]).over(ts()) if expr["lag"] else args[0]
        elif expr.get("rolling") == "median" and expr["window"] > FRAMES_TO:
            made[key] = f"_x{len(made)}"
            panel = rolling_median(panel.withColumn("_of", args[0].cast("double")), "_of", expr["window"], max(2, expr["window"] // 2), made[key]).drop("_of")
            return F.col(made[key])
        elif "rolling" in expr:
            value = rolling(expr["rolling"], args[0], expr["window"])
        elif "corr" in expr:
            value = rolling_corr(*args, expr["window"])
        else:
            value = zscore(args[0], expr["window"])
        made[key] = f"_x{len(made)}"
        panel = panel.withColumn(made[key], value)
        return F.col(made[key])

    columns = {name: compiled(e).cast("double") for name, e in exprs.items()}
    return panel.select(*keep, *[c.alias(n) for n, c in columns.items()])
