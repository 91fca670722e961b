"""Streams in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators import alerts as alert_ops
from logloom.operators import reports, verdicts
from logloom.operators.detect import Rule


def line_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(value, path, pos) of files as they come, oldest first; where to start is the checkpoint's.

    pos is a text that sorts as the lines came: by the file's time, its path, where its split begins, and the number of the line there. Files may be of any size: they are read in splits, line by line.
    """
    files = spark.readStream.option("latestFirst", "false").option("maxFilesPerTrigger", per_trigger).text(path)
    time = F.unix_micros("_metadata.file_modification_time")
    lines = files.select("value", F.col("_metadata.file_path").alias("path"), time.alias("time"), F.col("_metadata.file_block_start").alias("begin")).mapInArrow(_numbered, "value string, path string, time long, begin long, n long")
    digits = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return lines.where("value <> ''").select("value", "path", F.concat_ws(" ", digits("time", 20), "path", digits("begin", 20), digits("n", 10)).alias("pos"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with n, the number of each in its split, which stands as one run."""
    last, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        at, path, begin = np.arange(b.num_rows), b.column("path").dictionary_encode().indices.to_numpy(), b.column("begin").to_numpy()
        new = np.append(True, (path[1:] != path[:-1]) | (begin[1:] != begin[:-1]))
        number = at - np.maximum.accumulate(np.where(new, at, 0))
        if last == (b.column("path")[0].as_py(), begin[0]):
            number[np.cumsum(new) == 1] += n
        last, n = (b.column("path")[-1].as_py(), begin[-1]), number[-1] + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], names=[*b.schema.names, "n"])


def _each_batch(rows: DataFrame, make: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, trigger: dict[str, object]) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> DataFrame:
    """(batch, operator, n): how many rows each step with state has dropped in each micro-batch of a query, as they came after the watermark; a row for each that has dropped some.

    Of what the query still tells of its run: the last spark.sql.streaming.numRecentProgressUpdates micro-batches.
    """
    told = [(p.batchId, k, o.numRowsDroppedByWatermark) for p in query.recentProgress for k, o in enumerate(p.stateOperators) if o.numRowsDroppedByWatermark]
    return SparkSession.active().createDataFrame(sorted(set(told)), "batch long, operator int, n long")


def write_alerts(alerts: DataFrame, folder: str, checkpoint: str, journal: Callable[[], DataFrame] | None = None, **trigger: object) -> StreamingQuery:
    """Alerts of each micro-batch in a folder of its number, so that a batch that runs again replaces what it wrote.

    journal, if given, is read anew for each batch, so that verdicts of meanwhile annotate its alerts.
    """
    return _each_batch(alerts, lambda batch: verdicts.annotate(batch, verdicts.latest(journal())) if journal else batch, folder, checkpoint, trigger)


def detect_stream(events: DataFrame, rules: Callable[[], list[Rule]], folder: str, checkpoint: str, min_severity: str | None = None, **trigger: object) -> StreamingQuery:
    """Alerts of a stream of events (canonical columns with ts and seq) under rules that are read anew for each micro-batch.

    Only for rules without a threshold or throttle, as those need what earlier batches had; they go through ``suppress_stream``.
    """

    def make(batch: DataFrame) -> DataFrame:
        now = rules()
        if held := [r.name for r in now if r.enabled and (r.threshold or r.throttle_s)]:
            raise ValueError(f"rules with a threshold or throttle need state: {held}")
        return alert_ops.build(batch, now, min_severity)

    return _each_batch(events, make, folder, checkpoint, trigger)


def live_queue(alerts: DataFrame, journal: Callable[[], DataFrame], least: str, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """The alerts of a stream that are not closed, by the verdicts of the time of their micro-batch, and of at least a severity."""

    def make(batch: DataFrame) -> DataFrame:
        known = verdicts.effective(batch, verdicts.latest(journal()))
        return reports.with_status(known, "open").where(reports.at_least(F.col("severity"), least))

    return _each_batch(alerts, make, folder, checkpoint, trigger)
