"""Parent processes in a stream: what ``enrich.with_parents`` adds, from the last program of each process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.streaming.parts import gathered, in_order, packed, part_of, unpacked

#: What waits: its process, a time, what orders it among those of one time, 0 for a row that asks and 1 for a program, the program, and the row that asks as JSON.
ROW = pa.schema([("host", pa.string()), ("p", pa.int64()), ("t", pa.int64()), ("s", pa.string()), ("place", pa.int64()), ("exe", pa.string()), ("comm", pa.string()), ("row", pa.string())])


class LastPrograms(StatefulProcessor):
    """State of a part of the processes: the last program of each, and programs and questions that wait for the watermark."""

    def __init__(self, forget_s: float | None):
        self.forget_us = None if forget_s is None else int(forget_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.programs = handle.getValueState("programs", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new, now = gathered(rows, ROW), timerValues.getCurrentWatermarkInMs()
        if new.num_rows and (first := pc.min(new.column("t")).as_py()) > now * 1000:  # nothing is ready before a timer says so
            self.waiting.appendValue((packed(new),))
            self.handle.registerTimer(max(first // 1000, now) + 1)
        elif new.num_rows:
            yield from self.move_on(now, new)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self.move_on(timerValues.getCurrentWatermarkInMs(), ROW.empty_table())

    def move_on(self, now: int, new: pa.Table) -> Iterator[pd.DataFrame]:
        rows = pa.concat_tables([new, *(unpacked(x) for (x,) in self.waiting.get())])
        is_ready = pc.less_equal(rows.column("t"), now * 1000)
        ready, left = rows.filter(is_ready), rows.filter(pc.invert(is_ready))
        before = unpacked(held[0]) if (held := self.programs.get()) else ROW.empty_table()
        last, found = self.walk(before, ready, left, now)
        if ready.num_rows or new.num_rows:
            self.waiting.put([(packed(left),)]) if left.num_rows else self.waiting.clear()
        if pc.any(pc.equal(ready.column("place"), 1)).as_py() or last.num_rows < before.num_rows:
            self.programs.update((packed(last),)) if last.num_rows else self.programs.clear()
        if left.num_rows:
            self.handle.registerTimer(max(pc.min(left.column("t")).as_py() // 1000, now) + 1)
        elif last.num_rows and self.forget_us is not None:
            self.handle.registerTimer(max((pc.max(last.column("t")).as_py() + self.forget_us) // 1000, now) + 2)
        if found.num_rows:
            yield found.rename_columns(["row", "parent_exe", "parent_name"]).to_pandas()

    def walk(self, before: pa.Table, ready: pa.Table, left: pa.Table, now: int) -> tuple[pa.Table, pa.Table]:
        """The last program of each process, and (row, exe, comm) of the questions with the latest program before each; of one time and name, a question comes first."""
        marked = [x.append_column("new", pa.array(np.full(x.num_rows, n, np.int8))) for n, x in enumerate((before, ready))]
        rows, begins = in_order(pa.concat_tables(marked), ("host", "p"), ("new", "t", "s", "place"))
        at, place = np.arange(rows.num_rows), rows.column("place").to_numpy()
        latest = np.maximum.accumulate(np.where(place == 1, at, -1)) if len(at) else at
        latest = np.where(latest >= np.repeat(begins[:-1], np.diff(begins)), latest, -1)
        asks, ends = np.flatnonzero(place == 0), latest[begins[1:] - 1]
        program = pa.array(latest[asks], pa.int64(), mask=latest[asks] < 0)
        found = pa.table([rows.column("row").take(pa.array(asks)), rows.column("exe").take(program), rows.column("comm").take(program)], ["row", "exe", "comm"])
        last = rows.take(pa.array(ends[ends >= 0], pa.int64())).select(ROW.names)
        if self.forget_us is not None and last.num_rows:  # not what others still wait for
            names = lambda x: list(zip(x.column("host").to_pylist(), x.column("p").to_pylist(), strict=True))
            wanted = set(names(left))
            last = last.filter(pa.array([n in wanted or (t + self.forget_us) // 1000 >= now for n, t in zip(names(last), last.column("t").to_pylist(), strict=True)]))
        return last, found

    def close(self) -> None:
        pass


def parents_stream(events: DataFrame, delay: str = "10 minutes", forget_s: float | None = None) -> DataFrame:
    """A stream of events (host, pid, ppid, ts, seq, exe, comm, action, and any others) with parent_exe and parent_name, where unknown, of the latest earlier execve on the same host
    whose pid is their ppid, as ``enrich.with_parents`` gives them of a table.

    Rows wait for the watermark, delay behind the latest time seen, and are then taken in the order of time and seq (numbers of up to 20 digits, or texts); later ones are dropped. Events that ask
    for nothing go on at once. The state is one program for each process that has run on a host; with forget_s, a program is forgotten so long after it began, if nothing waits. The session's
    state store has to be that of RocksDB.
    """
    for c in ("parent_exe", "parent_name"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    events = events.withWatermark("ts", delay)
    starts = F.coalesce((F.col("action") == "execve") & F.col("pid").isNotNull(), F.lit(False))
    asks = F.coalesce(F.col("parent_name").isNull() & F.col("ppid").isNotNull(), F.lit(False))
    place = F.col("seq") if dict(events.dtypes)["seq"] == "string" else F.lpad(F.col("seq").cast("string"), 20, "0")
    nothing = F.lit(None).cast("string")
    program = F.struct(F.col("pid").cast("long").alias("p"), F.lit(1).alias("place"), F.col("exe").cast("string").alias("exe"), F.col("comm").cast("string").alias("comm"), nothing.alias("row"))
    question = F.struct(F.col("ppid").cast("long").alias("p"), F.lit(0).alias("place"), nothing.alias("exe"), nothing.alias("comm"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("row"))
    lines = events.select("host", "ts", F.unix_micros("ts").alias("t"), place.alias("s"), F.explode(F.array_compact(F.array(F.when(starts, program), F.when(asks, question)))).alias("x")).select("host", "ts", "t", "s", "x.*")
    made = lines.select(part_of("host", "p"), "*").groupBy("part").transformWithStateInPandas(LastPrograms(forget_s), "row string, parent_exe string, parent_name string", "Append", "EventTime")
    found = made.withColumn("r", F.from_json("row", events.schema)).select(*[F.coalesce(F.col(f"r.`{c}`"), F.col(c)).alias(c) if c in ("parent_exe", "parent_name") else F.col(f"r.`{c}`").alias(c) for c in events.columns])
    return found.unionByName(events.where(~asks))
