"""Thresholds and throttles on streams: the batch functions, fed in the order of event time.

Rows of a micro-batch come in any order, so each key holds back what the watermark has not passed. What is kept of a key
is no more than the hits of one window and what waits, in lists to which a micro-batch only adds; timers of event time take from them and clear them. Keys share their state by parts (see ``parts``).

Thresholds and throttles stand one after the other in one query: what a threshold fires goes on with the time of the watermark that made it ready, which is late for no one, and the throttle
orders it by its own time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.suppress import SHOWN, emissions, firings, seq_type
from logloom.streaming.parts import gathered, in_order, packed, part_of, unpacked

Times = tuple[np.ndarray, np.ndarray]
#: By so much a second step waits for the first, whose timers are of whole milliseconds.
LAG_MS = 10


def threshold_step(kept: Times, rows: Times, count: int, window: int) -> tuple[Times, list]:
    """(what is kept, firings) after sorted hits (times, seqs), from what was kept before. A firing names the row by its number."""
    t, s = (np.concatenate([a, b]) for a, b in zip(kept, rows, strict=True))
    places, rest = firings(t, count, window)
    out = [(i - len(kept[0]), count, s[max(i - count + 1, i - SHOWN + 1) : i + 1].tolist()) for i in places]
    rest = max(rest, len(t) - count + 1)
    return (t[rest:], s[rest:]), out


def throttle_step(kept: Times, rows: Times, count: int, window: int) -> tuple[Times, list]:
    places = emissions(rows[0], window, int(kept[0][0]) if len(kept[0]) else None)
    return (tuple(x[places[-1:]] for x in rows) if places else kept), [(i, None, None) for i in places]


STEPS = {"threshold": threshold_step, "throttle": throttle_step}


class Suppressor(StatefulProcessor):
    """State of a part of the keys: hits that wait for the watermark, and those that may still count, with their rules' limits."""

    def __init__(self, kind: str, seq: pa.DataType, lag_ms: int = 0):
        self.kind, self.lag_ms = kind, lag_ms
        self.schema = pa.schema([("rule", pa.string()), ("key", pa.string()), ("ts_us", pa.int64()), ("seq", seq), ("carried", pa.string()), ("count", pa.int64()), ("window_us", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = gathered(rows, self.schema)
        if not new.num_rows:
            return
        now, first = timerValues.getCurrentWatermarkInMs(), pc.min(new.column("ts_us")).as_py()
        if first > (now - self.lag_ms) * 1000:  # nothing is ready before a timer says so
            self.waiting.appendValue((packed(new),))
            self.wake(first, now)
        else:
            yield from self.move_on(now, new)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self.move_on(timerValues.getCurrentWatermarkInMs(), self.schema.empty_table())

    def wake(self, us: int, now: int, more: int = 1) -> None:
        self.handle.registerTimer(max(us // 1000 + self.lag_ms, now) + more)

    def move_on(self, now: int, new: pa.Table) -> Iterator[pd.DataFrame]:
        """Takes all that is ready through the machines of its keys; a timer is set for what comes next."""
        mark = (now - self.lag_ms) * 1000
        rows = pa.concat_tables([new, *(unpacked(x) for (x,) in self.waiting.get())])
        is_ready = pc.less_equal(rows.column("ts_us"), mark)
        ready, left = rows.filter(is_ready), rows.filter(pc.invert(is_ready))
        before = unpacked(held[0]) if (held := self.kept.get()) else self.schema.empty_table()
        if ready.num_rows or new.num_rows:
            self.waiting.put([(packed(left),)]) if left.num_rows else self.waiting.clear()
        kept, out = self.walk(before, ready, mark)
        if ready.num_rows or kept.num_rows < before.num_rows:
            self.kept.update((packed(kept),)) if kept.num_rows else self.kept.clear()
        if left.num_rows:
            self.wake(pc.min(left.column("ts_us")).as_py(), now)
        elif kept.num_rows:
            self.wake(pc.max(pc.add(kept.column("ts_us"), kept.column("window_us"))).as_py(), now, 2)
        if len(out):
            out["at"] = pd.Timestamp(now + 1, unit="ms")  # what goes on has to be later than the watermark
            yield out[["rule", "key", "at", "ts_us", "seq", "match_count", "members", "carried"]]

    def walk(self, before: pa.Table, ready: pa.Table, mark: int) -> tuple[pa.Table, pd.DataFrame]:
        """(what is kept of all keys, what goes on) after hits that are ready, from what was kept before. Of a key that has had none for a window nothing is kept."""
        marked = [x.append_column("new", pa.array(np.full(x.num_rows, n, np.int8))) for n, x in enumerate((before, ready))]
        rows, begins = in_order(pa.concat_tables(marked), ("rule", "key"), ("new", "ts_us", "seq"))
        t, new, count, window = (rows.column(c).to_numpy() for c in ("ts_us", "new", "count", "window_us"))
        s = rows.column("seq").to_numpy()
        places, keep, counts, members = [], [], [], []
        for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False):
            n = a + int(np.searchsorted(new[a:b], 1))
            had, last = np.arange(a, n), t[b - 1]
            if n < b:
                had, out = STEPS[self.kind]((t[a:n], np.arange(a, n)), (t[n:b], np.arange(n, b)), int(count[b - 1]), int(window[b - 1]))
                had = had[1]
                for i, c, m in out:
                    places.append(n + i)
                    counts.append(c)
                    members.append(None if m is None else s[m].tolist())
                last = t[had[-1]] if len(had) else last
            if len(had) and last + window[b - 1] >= mark:
                keep.append(had)
        kept = rows.take(pa.array(np.concatenate(keep) if keep else [], pa.int64())).select(self.schema.names)
        found = rows.take(pa.array(places, pa.int64())).select(["rule", "key", "ts_us", "seq", "carried"]).to_pandas()
        found["match_count"], found["members"] = pd.Series(counts, dtype=object), pd.Series(members, dtype=object)
        return kept, found

    def close(self) -> None:
        pass


def _step(hits: DataFrame, kind: str, lag_ms: int = 0) -> DataFrame:
    """hits (rule, key, a column of event time, ts_us, seq, carried, count, window_us) through the machines of their keys, with the time at of the watermark that let each go, and with match_count and members where it is a threshold."""
    seq, kind_of_seq = seq_type(hits)
    out = f"rule string, key string, at timestamp, ts_us long, seq {seq}, match_count long, members array<{seq}>, carried string"
    dealt = hits.select(part_of("rule", "key"), "*")
    return dealt.groupBy("part").transformWithStateInPandas(Suppressor(kind, kind_of_seq, lag_ms), out, "Append", "EventTime", eventTimeColumnName="at")


def suppress_stream(hits: DataFrame, kind: str, delay: str = "10 minutes") -> DataFrame:
    """What a threshold fires, or a throttle lets through, of a stream of hits (rule, key, ts, seq, count, window_us): (rule, key, ts_us, seq, match_count, members).

    Rows that come after the watermark, delay behind the latest time seen, are dropped (``sinks.late_rows`` tells how many). The result is that of the batch functions on all others.
    The session's state store has to be that of RocksDB.
    """
    seq, _ = seq_type(hits)
    rows = hits.withWatermark("ts", delay).select("rule", "key", "ts", F.unix_micros("ts").alias("ts_us"), "seq", F.lit(None).cast("string").alias("carried"), "count", "window_us")
    return _step(rows, kind).select("rule", "key", "ts_us", "seq", *_shown(seq))


def _shown(seq: str) -> list[Column]:
    """match_count and members, of a hit that no threshold has counted too."""
    return [F.coalesce("match_count", F.lit(1).cast("long")).alias("match_count"), F.coalesce("members", F.array().cast(f"array<{seq}>")).alias("members")]


def passing_stream(hits: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """(rule, ts_us, seq, match_count, members): the stream of hits that become alerts, as ``alerts.passing`` gives them of a table.

    hits are a stream (rule, ts, seq, and the columns of ``alerts.keyed``: group, count, within_us where the rule has a threshold, dedup, wait_us where it has a throttle). A threshold comes
    first; what it fires goes on to the throttle by the key of the hit that made it fire. Both are steps of one query with one checkpoint. Without a delay ts has its watermark already.
    """
    seq, _ = seq_type(hits)
    timed = hits.withWatermark("ts", delay) if delay else hits
    own = timed.select("rule", "ts", F.unix_micros("ts").alias("ts_us"), "seq", F.when(F.col("wait_us").isNotNull(), F.to_json(F.struct("dedup", "wait_us"))).alias("carried"), "group", "dedup", "count", "within_us", "wait_us")
    none = [F.lit(None).cast("long").alias("match_count"), F.lit(None).cast(f"array<{seq}>").alias("members")]
    out = lambda df: df.select("rule", "ts_us", "seq", *_shown(seq))
    # Each hit goes through the steps of its own rule only: a step that two others read would be two steps with a state each.
    counted = lambda condition: _step(own.where(f"count is not null and {condition}").select("rule", F.col("group").alias("key"), "ts", "ts_us", "seq", "carried", "count", F.col("within_us").alias("window_us")), "threshold")
    # What a threshold has found goes through the throttle as text; its key and limit are those of the hit that made it fire.
    slowed = lambda df, key, wait, found: df.select("rule", key.alias("key"), "at", "ts_us", "seq", found.cast("string").alias("carried"), F.lit(1).alias("count"), wait.cast("long").alias("window_us"))
    fired = counted("carried is not null").withColumn("t", F.from_json("carried", "dedup string, wait_us long"))
    waiting = slowed(own.where("count is null and wait_us is not null").withColumn("at", F.col("ts")), F.col("dedup"), F.col("wait_us"), F.lit(None)).unionByName(slowed(fired, F.col("t.dedup"), F.col("t.wait_us"), F.to_json(F.struct("match_count", "members"))))
    passed = _step(waiting, "throttle", LAG_MS).withColumn("t", F.from_json("carried", f"match_count long, members array<{seq}>")).withColumns({"match_count": F.col("t.match_count"), "members": F.col("t.members")})
    return out(own.where("count is null and wait_us is null").select("*", *none)).unionByName(out(counted("carried is null"))).unionByName(out(passed))
