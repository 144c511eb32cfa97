"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session sets none and runs in this process alone (local runs, tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="panelforge-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive executors.

    With ``release`` the shuffle files behind ``df`` go as soon as it is written; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: other columns, whatever their names, never meet the operators' own."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def keyed_bytes(docs: DataFrame) -> DataFrame:
    """As ``keyed_text``, with texts as UTF-8, which Python workers then need not decode and encode."""
    return keyed_text(docs).withColumn("text", F.col("text").cast("binary"))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z lower-cased: what bytes.lower and bytes.split do."""
    return raw.lower().split() if raw else []


def exact(values: list[int | None]) -> pd.api.extensions.ExtensionArray:
    """Integers and nulls as a column; a frame made of rows would turn them into floats, which round 64-bit hashes."""
    return pd.array(values, dtype="Int64")


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, one value after another without copies, and the values' bounds; a null has none."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at
