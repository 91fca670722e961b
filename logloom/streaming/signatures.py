"""The index of signatures kept up to date by a stream of the journal's lines, of which each is read once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.verdicts import CLOSED, read_journal

#: What the index needs of an alert's last record; gone says that the alert has left the signature.
RECORD = "signature string, alert_id string, updated_at string, first_pos string, verdict string, gone boolean"


def journal_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The lines of verdicts of a journal (see ``store.append_journal``) as they come, with pos, a text that sorts as ``store.load_journal`` orders them. An append is read whole, to number its lines."""
    files = spark.readStream.schema("value string, append string").option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
    lines = files.select("append", F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return read_journal(lines.where("value <> ''").select("value", F.format_string("%s %s %010d", "append", "file", "n").alias("pos")))


class LatestRecord(StatefulProcessor):
    """State of an alert: its last record, and where its first line stands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "pos string, first_pos string, signature string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        old, lines = self.last.get(), sorted(rows, key=lambda r: r.pos)
        new, first = lines[-1], lines[0].pos
        if old is not None:
            before, first_before, signature = old
            first = min(first, first_before)
            if before > new.pos:  # late lines are no last ones, but may be the first
                self.last.update((before, first, signature))
                return
            if signature and signature != new.signature:
                yield Row(signature=signature, alert_id=key[0], updated_at=None, first_pos=None, verdict=None, gone=True)
        self.last.update((new.pos, first, new.signature))
        if new.signature:
            yield Row(signature=new.signature, alert_id=key[0], updated_at=new.updated_at, first_pos=first, verdict=new.verdict, gone=False)

    def close(self) -> None:
        pass


def _rank(record: tuple) -> tuple:
    """Records of a signature are ordered by time, a missing one first, then by the alert's first line."""
    updated_at, first_pos, _ = record
    return updated_at is not None, updated_at or "", first_pos


class NewestRecord(StatefulProcessor):
    """State of a signature: the last record of each of its alerts, and which is the newest. All are looked through only when the newest one goes, or becomes older."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "alert_id string", "updated_at string, first_pos string, verdict string")
        self.newest = handle.getValueState("newest", "alert_id string, updated_at string, first_pos string, verdict string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        had = self.newest.get()
        had = tuple(had) if had is not None else None
        best, lost = had, False
        for r in rows:
            if r.gone:
                self.records.removeKey((r.alert_id,))
                lost = lost or (best is not None and best[0] == r.alert_id)
                continue
            new = (r.updated_at, r.first_pos, r.verdict)
            self.records.updateValue((r.alert_id,), new)
            if best is None or _rank(new) >= _rank(best[1:]):
                best = (r.alert_id, *new)
            elif best[0] == r.alert_id:
                lost = True
        if lost:
            best = max(((k[0], *v) for k, v in self.records.iterator()), key=lambda x: _rank(x[1:]), default=None)
        self.newest.update(best) if best else self.newest.clear()
        told = lambda x: (x[3], x[0]) if x and x[3] in CLOSED else None
        if told(best) != told(had):
            verdict, alert = told(best) or (None, None)
            yield Row(signature=key[0], verdict=verdict, alert_id=alert)

    def close(self) -> None:
        pass


def index_changes(journal: DataFrame) -> DataFrame:
    """(signature, verdict, alert_id): what a stream of a journal's lines changes in ``verdicts.signature_index``; both others are null where a signature leaves it. At most one row for each signature in a micro-batch.

    Two steps with state: the last record of each alert, and of those the newest of each signature. Lines may come in any order. The session's state store has to be that of RocksDB.
    """
    records = journal.select("alert_id", "pos", "signature", "verdict", "updated_at").groupBy("alert_id").transformWithState(LatestRecord(), RECORD, "Append", "None")
    return records.groupBy("signature").transformWithState(NewestRecord(), "signature string, verdict string, alert_id string", "Append", "None")


def index_of(changes: DataFrame) -> DataFrame:
    """The index (signature, verdict, alert_id) after all changes (see ``index_changes``) that are stored in folders of their batch, as ``sinks.write_alerts`` does."""
    last = changes.groupBy("signature").agg(F.max_by(F.struct("verdict", "alert_id"), "batch").alias("r"))
    return last.select("signature", "r.*").where("verdict is not null")
