"""Audit events from a stream of lines: an event is out when its end marker comes, or when it has been quiet for a while.

Lines stay text until their event is out: only their heads are read before, and they wait, are put in order and are joined as columns of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.sources import audit
from logloom.streaming.parts import gathered, in_order, packed, unpacked

#: A line: its event (time, serial and source), that time in milliseconds, what orders it, whether it names its host, whether it ends its event, its text and its key.
LINE = pa.schema([("event", pa.string()), ("t", pa.int64()), ("pos", pa.string()), ("named", pa.bool_()), ("ends", pa.bool_()), ("line", pa.string()), ("seq", pa.string())])
#: Events are dealt into so many parts by a hash. Each part is a key of the state, as calls from Python to the state are dear for each key; of a micro-batch, a task holds the lines of one part at a time.
PARTS = 1024
#: Signs in place of a break inside a line, and of the first of these signs itself.
_ESCAPE = "\x10"


class OpenEvents(StatefulProcessor):
    """State of the events of a part that have no end yet: a list of packed tables of lines, to which a micro-batch adds one unless it ends an event that waits."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "lines binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = gathered(rows, LINE)
        if not new.num_rows:
            return
        ended = pc.unique(new.column("event").filter(new.column("ends")))
        is_out = pc.is_in(new.column("event"), ended)
        left = new.filter(pc.invert(is_out))
        waited = self.waiting() if len(ended) else LINE.empty_table()
        had = pc.is_in(waited.column("event"), ended)
        yield from self.out(pa.concat_tables([waited.filter(had), new.filter(is_out)]))
        if pc.any(had).as_py():
            self.keep(pa.concat_tables([waited.filter(pc.invert(had)), left]))
        elif left.num_rows:
            self.held.appendValue((packed(left, "zstd"),))
        if left.num_rows:
            self.wake(left, timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """All that has been quiet for long enough; a timer is set for what comes next. One that is left finds nothing."""
        now, waited = timerValues.getCurrentWatermarkInMs(), self.waiting()
        is_out = pc.less_equal(waited.column("t"), now - self.quiet_ms)
        rest = waited.filter(pc.invert(is_out))
        if rest.num_rows < waited.num_rows:
            self.keep(rest)
        yield from self.out(waited.filter(is_out))
        if rest.num_rows:
            self.wake(rest, now + 1)

    def wake(self, lines: pa.Table, least: int) -> None:
        self.handle.registerTimer(max(pc.min(lines.column("t")).as_py() + self.quiet_ms, least))

    def waiting(self) -> pa.Table:
        return pa.concat_tables([LINE.empty_table(), *(unpacked(x) for (x,) in self.held.get())])

    def keep(self, lines: pa.Table) -> None:
        self.held.put([(packed(lines, "zstd"),)]) if lines.num_rows else self.held.clear()

    def out(self, lines: pa.Table) -> Iterator[pd.DataFrame]:
        """A row for each event, with its lines in order; end markers are none."""
        rows, begins = in_order(lines.filter(pc.invert(lines.column("ends"))), ("event",), ("pos",))
        if rows.num_rows:
            texts = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rows.column("line").combine_chunks())
            first = rows.select(["event", "seq"]).take(pa.array(begins[:-1]))
            named = np.logical_or.reduceat(rows.column("named").to_numpy(), begins[:-1])
            yield first.append_column("named", pa.array(named)).append_column("lines", pc.binary_join(texts, "\n")).to_pandas()

    def close(self) -> None:
        pass


def assemble_stream(lines: DataFrame, quiet_ms: int = 1000, delay: str = "5 seconds") -> DataFrame:
    """(host, epoch, serial, records, seq) of a stream of lines (value, pos, path), as ``audit.assemble`` gives them.

    pos, a number or a text that sorts as the lines came, gives the order of an event's records, as in a batch. Time is that of the records. Records that come after their event is out, but before the watermark, make a second event.
    The session's state store has to be that of RocksDB.
    """
    read = audit.heads(lines).withColumn("ts", F.timestamp_millis(F.col("sec") * 1000 + F.col("msec")))
    place = F.col("pos") if dict(read.dtypes)["pos"] == "string" else F.lpad(F.col("pos").cast("string"), 20, "0")
    event = F.concat("sec", F.lit("."), "msec", F.lit(":"), "serial", F.lit(" "), F.coalesce("node", "path"))
    line = F.replace(F.replace("raw", F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0")), F.lit("\n"), F.lit(f"{_ESCAPE}1"))
    rows = read.select("ts", event.alias("event"), (F.col("sec") * 1000 + F.col("msec")).alias("t"), place.alias("pos"), F.col("node").isNotNull().alias("named"), (F.col("type") == "EOE").alias("ends"), line.alias("line"), "seq").withWatermark("ts", delay)
    dealt = rows.select(F.pmod(F.xxhash64("event"), F.lit(PARTS)).alias("part"), "*").groupBy("part")
    made = dealt.transformWithStateInPandas(OpenEvents(quiet_ms), "event string, seq string, named boolean, lines string", "Append", "EventTime")
    head = F.substring_index("event", " ", 1)
    at, host = F.substring_index(head, ":", 1), F.when(F.col("named"), F.substr("event", F.length(head) + F.lit(2)))
    epoch = F.substring_index(at, ".", 1).cast("long") + F.substring_index(at, ".", -1).cast("long") / 1000.0
    as_they_came = lambda x: F.replace(F.replace(x, F.lit(f"{_ESCAPE}1"), F.lit("\n")), F.lit(f"{_ESCAPE}0"), F.lit(_ESCAPE))
    texts = F.split("lines", "\n")
    texts = F.when(F.col("lines").contains(_ESCAPE), F.transform(texts, as_they_came)).otherwise(texts)
    return made.select(host.alias("host"), epoch.alias("epoch"), F.substring_index(head, ":", -1).alias("serial"), audit.records_of(texts).alias("records"), "seq")


def event_stream(lines: DataFrame, quiet_ms: int = 1000, delay: str = "5 seconds") -> DataFrame:
    """Canonical columns of a stream of audit lines."""
    return audit.derive(assemble_stream(lines, quiet_ms, delay))
