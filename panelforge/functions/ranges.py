"""Trailing windows that are computed in Python: series cut into ranges that overlap by a window.

A row is sent to the range it lies in and, near its end, to those after it that look back on it: window - 1 rows more a
range, whatever the window's cost in Python. A range is a task's group, so a long series is many groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.functions.columns import rolling

RANGE = 8192
#: Rows of a median's window up to which sorting each row's frame costs less than sending wide rows to Python.
FRAMES_TO = 60


def over_ranges(frame: DataFrame, series: str, order: str, column: str, window: int, run: Callable[[np.ndarray, int], list[np.ndarray]], added: str, size: int = RANGE) -> DataFrame:
    """``frame`` with the columns ``added``, of doubles (NaN: null). ``run`` takes the values of ``column`` in order, null
    as NaN, and the place of the first row of the range; it returns an array a column, from that row on. A null series is one
    of its own; rows of equal order come in any order, as in a window; an empty frame stays empty."""
    names = StructType.fromDDL(added).fieldNames()
    schema = StructType([*frame.schema.fields, *StructType.fromDDL(added).fields])
    place = F.row_number().over(W.partitionBy(series).orderBy(order)) - 1
    ranges = F.sequence(F.floor(F.col("_place") / size), F.floor((F.col("_place") + (window - 1)) / size))
    dealt = frame.withColumn("_place", place.cast("long")).withColumn("_range", F.explode(ranges))

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        at = table["_place"].to_numpy()
        first = int(np.searchsorted(at, table["_range"][0].as_py() * size))
        values = table[column].cast(pa.float64()).to_numpy(zero_copy_only=False)
        rows = table.slice(first).drop_columns(["_place", "_range"])
        made = run(values, first) if len(rows) else [np.zeros(0)] * len(names)
        for name, a in zip(names, made):
            rows = rows.append_column(name, pa.array(a, pa.float64(), from_pandas=True))
        return rows

    return dealt.groupBy(series, "_range").applyInArrow(group, schema)


def rolling_median(frame: DataFrame, column: str, window: int, least: int, name: str, series: str = "symbol", order: str = "date", size: int = RANGE, frames_to: int = FRAMES_TO) -> DataFrame:
    """``frame`` with the median of the last ``window`` rows, where ``least`` have a value: over windows longer than
    ``frames_to`` one sorted window slides over a range, so a row costs the logarithm of the window; shorter ones are
    window expressions, which sort each row's frame but send no row to Python."""
    if window <= frames_to:
        return frame.withColumn(name, rolling("median", column, window, least, W.partitionBy(series).orderBy(order)))

    def run(values: np.ndarray, first: int) -> list[np.ndarray]:
        return [pd.Series(values).rolling(window, min_periods=max(least, 1)).median().to_numpy()[first:]]

    return over_ranges(frame, series, order, column, window, run, f"`{name}` double", size)
