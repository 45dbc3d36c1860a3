"""Folders that all executors see."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver ends; only a session of one process may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="veilframe-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = "file://" + _own[0]
    path = f"{base.rstrip('/')}/veilframe-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
