"""The prediction log: JSON lines, one entry a (data_as_of, spec_sha256), appended to by a data source of its own.

A task writes its entries to a draft that no reader sees, and says in its commit message which draft it wrote and which
keys are in it. Only when all tasks have ended does the driver's commit put the drafts of the attempts that count in
place; drafts of attempts that failed or ran twice never become part of the log, and an abort removes what is known of
them. A commit that meets a key that is in the log by then (another writer was faster) puts nothing in place and fails.
Entries of one commit are few, one a session and specification, so their keys may travel in messages.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

KEY = ("data_as_of", "spec_sha256")
# Fixed value: the columns of an entry.
LOG = "spec_name string, spec_sha256 string, logged_at string, data_as_of date, eligible_names long, picks array<struct<symbol: string, composite_rank: double, close: double>>, status string, orders array<string>"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _plain(value):
    """A row's value as JSON takes it."""
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


@dataclass
class _Draft(WriterCommitMessage):
    path: str | None
    keys: list[tuple[str, str]]


class RecordLog(DataSource):
    """``df.write.format("record_log").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return LOG

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a record is appended to, never overwritten")
        return _RecordWriter(self.options["path"], schema.fieldNames())


class _RecordWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def write(self, rows: Iterator) -> _Draft:
        entries = [dict(zip(self.names, map(_plain, r))) for r in rows]
        if not entries:
            return _Draft(None, [])
        store, at = _store(self.folder)
        store.create_dir(f"{at}/_drafts", recursive=True)
        task = TaskContext.get()
        path = f"{at}/_drafts/{task.partitionId():05d}-{task.attemptNumber()}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(path) as out:
            out.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in entries).encode())
        return _Draft(path, [tuple(str(e[k]) for k in KEY) for e in entries])

    def commit(self, messages: list) -> None:
        store, at = _store(self.folder)
        drafts = [m for m in messages if m is not None and m.path]
        keys = [k for m in drafts for k in m.keys]
        if len(set(keys)) < len(keys) or set(keys) & log_keys(self.folder):
            self.abort(messages)
            raise ValueError("the log has an entry of these by now; read it again")
        for m in drafts:
            store.move(m.path, f"{at}/part-{uuid.uuid4().hex}.json")

    def abort(self, messages: list) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


def log_keys(folder: str) -> set[tuple[str, str]]:
    """Keys of the log's entries, read by the driver: one a session and specification."""
    from pyarrow import fs

    store, at = _store(folder)
    out = set()
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            with store.open_input_stream(info.path) as f:
                for line in f.read().decode("utf-8", "replace").splitlines():
                    try:
                        entry = json.loads(line)
                    except json.JSONDecodeError:
                        continue
                    if isinstance(entry, dict):
                        out.add(tuple(str(entry.get(k)) for k in KEY))
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log, a folder or one file; lines that can't be read, or without a key, are left out."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("data_as_of is not null and spec_sha256 is not null")


def append_predictions(entries: DataFrame, folder: str, log: DataFrame | None = None) -> int:
    """Append what the log has no (data_as_of, spec_sha256) for, whole or not at all. Returns the number appended."""
    spark = entries.sparkSession
    spark.dataSource.register(RecordLog)
    log = log if log is not None else read_log(spark, folder) if log_keys(folder) else spark.createDataFrame([], LOG)
    new = entries.dropDuplicates(list(KEY)).join(log.select(*KEY), list(KEY), "left_anti").select(*entries.columns).persist()
    n = new.count()
    if n:
        new.write.format("record_log").mode("append").save(folder)
    new.unpersist()
    return n


def logged_picks(log: DataFrame, panel: DataFrame, spec_sha256: str | None = None) -> DataFrame:
    """date, session_index, symbol of the picks of a log, on the panel's sessions."""
    rows = log if spec_sha256 is None else log.where(F.col("spec_sha256") == spec_sha256)
    named = rows.select(F.col("data_as_of").alias("date"), F.explode("picks.symbol").alias("symbol"))
    return named.join(panel.select("date", "session_index", "symbol"), ["date", "symbol"]).select("date", "session_index", "symbol")
