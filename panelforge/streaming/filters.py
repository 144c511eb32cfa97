"""Filters as streams: the two-state filter on values as they come, change points on values in the order of their time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelforge.operators.mechanisms import ChangeModel, hmm_step


def hmm_stream(series: DataFrame, stay=(0.95, 0.95), mean=(0.0, 0.0), sd=(1.0, 2.0), start=(0.5, 0.5)) -> DataFrame:
    """Each row of a streaming (series_id, t, value) with the probability of the second state; rows of one trigger are ordered by t."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = state.get if state.exists else tuple(start)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for x in rows["value"]:
            p = hmm_step(p, None if pd.isna(x) else float(x), stay, mean, sd)
            out.append(p[1])
        state.update((float(p[0]), float(p[1])))
        yield pd.DataFrame({"series_id": rows["series_id"], "t": rows["t"], "probability": out})

    return series.groupBy("series_id").applyInPandasWithState(run, "series_id string, t long, probability double", "p0 double, p1 double", "append", GroupStateTimeout.NoTimeout)


class ChangePoints(StatefulProcessor):
    """A series' run lengths as a list, and the rows that wait for the watermark as another.

    Rows may come in any order within the watermark's delay. A row waits until the watermark is past its time; then a timer
    takes all that are due, in order, through the model. So the result does not depend on how the stream is cut into triggers.
    """

    def __init__(self, model: ChangeModel):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "p double, mean double, precision double")
        self.waiting = handle.getListState("waiting", "t long, value double, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            at = pd.to_datetime(pdf["at"]).astype("int64") // 1_000_000 if str(pdf["at"].dtype).startswith("datetime64[ns") else pd.to_datetime(pdf["at"]).astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([(int(t), None if pd.isna(v) else float(v), int(d)) for t, v, d in zip(pdf["t"], pdf["value"], at)])
            due.update(int(d) for d in at)
        for d in due:
            self.handle.registerTimer(d)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get())
        ready = sorted((r for r in held if r[2] <= now), key=lambda r: (r[2], r[0]))
        if not ready:
            return
        self.waiting.put([tuple(r) for r in held if r[2] > now]) if len(ready) < len(held) else self.waiting.clear()
        runs = np.array([tuple(r) for r in self.runs.get()]) if self.runs.exists() else self.model.start()
        out = []
        for t, value, _ in ready:
            known = value is not None and np.isfinite(value)
            if known:
                runs = self.model.step(runs, value)
            out.append((key[0], t, float(runs[0, 0]) if known else self.model.hazard))
        self.runs.put([tuple(map(float, r)) for r in runs])
        yield pd.DataFrame(out, columns=["series_id", "t", "probability"])

    def close(self) -> None:
        pass


def change_stream(series: DataFrame, model: ChangeModel = ChangeModel(), delay: str = "0 seconds") -> DataFrame:
    """Change probability of each row of a streaming (series_id, t, value, at), at being its time, in order within a series.

    Rows later than ``delay`` behind the latest time seen are left out. The state store is RocksDB, which list states and timers need.
    """
    series.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = series.select("series_id", "t", "value", "at").withWatermark("at", delay)
    return rows.groupBy("series_id").transformWithStateInPandas(ChangePoints(model), "series_id string, t long, probability double", "append", "eventTime")
