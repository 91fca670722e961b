"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all tasks run on this machine, a temporary one of it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in the folder of the run if there is one, that nothing else has."""
    return f"{_run.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """All that is stored inside lies in one folder, whose contents are removed at the end: results must be written or read before.

    They are removed by writing an empty table over them, so the folder may lie in any store that Spark writes to.
    """
    folder = new_folder(spark, "run")
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        spark.createDataFrame([], "nothing int").write.mode("overwrite").parquet(folder)


def saved(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, so that a lost executor costs no more than its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """As ``saved``, as Parquet: who reads it reads only the columns it needs, and joins know its size. Rows keep their order inside files only."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
