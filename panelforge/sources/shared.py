"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; under a temporary folder only in local runs that set none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="panelforge-core-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = "file://" + _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
