"""Intermediate tables, written to the shared folder: read by several branches of a plan, they are
computed once, and their lineage ends there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="lexmill-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        root = "file://" + _OWN[app]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def small(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table, written already, marked to be sent to all tasks if it has no more than `most` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def saved(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
