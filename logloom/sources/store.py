"""Where alerts and verdicts are kept."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.verdicts import read_journal


def write_alerts(alerts: DataFrame, folder: str) -> None:
    """One JSON object a line, in folders by day and severity, so that a reader of some skips the rest; nulls are left out."""
    alerts.withColumns({"day": F.to_date("event_time"), "level": F.col("severity")}).write.mode("append").partitionBy("day", "level").json(folder)


def read_alerts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What ``write_alerts`` has written; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def append_journal(records: DataFrame, folder: str) -> None:
    """Adds lines of verdicts in a folder of their own, named by the next number and a name that nothing else has; those that are there never change.

    Several may append at once, and nothing is lost: two that see the same last number write to different folders, and are read in the order of their names. Only Spark's own
    writers and file lists are used, so the folder may lie in any store that Spark reads.
    """
    number = 1 + max((int(n) for f in _files(records.sparkSession, folder) for n in re.findall(r"/append=(\d+)-", f)), default=0)
    records.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/append={number:012d}-{uuid.uuid4().hex}")


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files; it need not exist. No file is read."""
    try:
        return spark.read.text(folder).inputFiles()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def load_journal(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of verdicts with pos, the order in which they came: by the number of their append, then by file and line. A copied folder keeps it."""
    lines = spark.read.schema("value string, append string").text(folder)
    return read_journal(lines.select("value", F.struct("append", F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos")))
