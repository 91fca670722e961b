"""Thresholds and throttles: what is kept depends on the row kept last, so each key is walked in the order of time.

Keys are cut at quiet times first: after a gap longer than the window nothing that came before matters, nor do hits that are too few
to fill a threshold's window with those that follow, so the parts of a busy key between such times are walked in different tasks. A part is read from sorted rows batch by batch, with no more
than the hits of one window in memory.

A part of very many hits is cut by time as well, into sorted ranges of about equal size. Only the first group of a range can go on from the range before, so what it begins with is one state
for each range: all ranges are walked at once from every state that they might begin with, and the true ones follow from range to range. Then all are walked once more. The number of jobs does
not depend on that of the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import saved, stored

SHOWN = 25
#: How many hits one task walks of a part that is cut.
MOST = 20_000_000
NAMES = ("rule", "key", "part")
EDGE = pa.schema([("pid", pa.int32()), ("rule", pa.string()), ("key", pa.string()), ("part", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("begin", pa.int64()), ("end", pa.int64())])


def firings(t: np.ndarray, count: int, window: int) -> tuple[list[int], int]:
    """Where a threshold fires on sorted times: when so many hits lie within the window, edges included, counted anew after each firing.

    Returns the places, and the first place that no firing has used.
    """
    last = np.arange(count - 1, len(t))
    last = last[t[last] - t[last - count + 1] <= window] if len(last) else last
    out, start = [], 0
    while (k := np.searchsorted(last, start + count - 1)) < len(last):
        out.append(int(last[k]))
        start = out[-1] + 1
    return out, start


def emissions(t: np.ndarray, window: int, last: int | None) -> list[int]:
    """Which of sorted times a throttle lets through: those at least a window after the last it let through."""
    out = []
    i = 0 if last is None else int(np.searchsorted(t, last + window, "left"))
    while i < len(t):
        out.append(i)
        i = max(i + 1, int(np.searchsorted(t, t[i] + window, "left")))
    return out


def _slot() -> Column:
    return F.floor(F.col("ts_us") / F.greatest("window_us", F.lit(1))).cast("long")


def parts_of(hits: DataFrame, most: int, needed: str | None = None) -> DataFrame:
    """(rule, key, slot, part, n, large) of hits (rule, key, ts_us, window_us): part is the first of the stretches of a window's length (slots) that are walked together.

    A part begins after an empty stretch; and where hits have to be as many as the column needed says, also where two stretches that follow each other have fewer hits than it needs, as no window that
    lies in both can then be full. So of a busy key only those times stay together at which the threshold is near to firing. Parts with fewer hits than needed are left out. A part of over most hits is large.
    """
    used = hits.groupBy("rule", "key", _slot().alias("slot")).agg(F.count("*").alias("n"), F.max(needed if needed else F.lit(0)).alias("needed"))
    order = W.partitionBy("rule", "key").orderBy("slot")
    apart = (F.col("slot") - F.lag("slot").over(order) > 1) | (F.col("n") + F.lag("n").over(order) < F.col("needed"))
    begins = used.withColumn("begin", F.when(F.coalesce(apart, F.lit(True)), F.col("slot")))
    parts = begins.withColumn("part", F.last("begin", ignorenulls=True).over(order))
    whole = parts.groupBy("rule", "key", "part").agg(F.sum("n").alias("all"), F.max("needed").alias("needed")).where(F.col("all") >= F.col("needed"))
    return parts.drop("needed").join(whole.select("rule", "key", "part", (F.col("all") > most).alias("large")), ["rule", "key", "part"]).select("rule", "key", "slot", "part", "n", "large")


def group_edges(batch: pa.RecordBatch) -> list[int]:
    """Where the groups of equal rule, key and part begin in a batch, and its end."""
    changed = np.zeros(batch.num_rows - 1, bool)
    for c in NAMES:
        own = batch.column(c)
        codes = (own.dictionary_encode().indices if pa.types.is_string(own.type) else own).to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]


def groups(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, int, dict[str, np.ndarray]]]:
    """(name, batch, first row, columns as arrays) of each piece of a group that lies in one batch of sorted rows."""
    for batch in batches:
        if batch.num_rows:
            cuts = group_edges(batch)
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(batch.column(c)[a].as_py() for c in NAMES), batch, a, {c: v[a:b] for c, v in values.items()}


@dataclass
class Machine:
    """A walk: a state's start, a step over sorted rows (it yields the number of a row that goes on, and values of the columns that are made), and what it looks at."""

    start: Callable[[], object]
    step: Callable[[object, dict[str, np.ndarray]], Iterator[tuple]]
    extra: list[str]
    made: list[tuple[str, str, pa.DataType]]


def emitted(rows: DataFrame, machine: Machine, first: dict[int, object]) -> DataFrame:
    """What the machine lets go on of sorted rows of whole partitions; first has the state with which a partition's first group begins, if not anew."""
    carried = [f for f in rows.schema if f.name not in [n for n, _, _ in machine.made] and f.name not in ("part", "large", "slot", "pid")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + [f"{n} {t}" for n, t, _ in machine.made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for name, _, a, values in groups([batch], ["ts_us", "seq", *machine.extra]):
                if name != now:
                    known = first.get(batch.column("pid")[0].as_py()) if first and now is None else None
                    now, state = name, machine.start() if known is None else known
                found += [(a + i, *x) for i, *x in machine.step(state, values)]
            if found:
                kept = batch.take(pa.array([x[0] for x in found]))
                new = [pa.array([x[k + 1] for x in found], t) for k, (_, _, t) in enumerate(machine.made)]
                yield pa.RecordBatch.from_arrays([kept.column(f.name) for f in carried] + new, names=[f.name for f in carried] + [n for n, _, _ in machine.made])

    return rows.mapInArrow(run, schema)


def walk(hits: DataFrame, machine: Machine, link: Callable[[DataFrame], dict[int, object]], most: int, needed: str | None = None) -> DataFrame:
    """The hits that the machine lets go on; link finds what the partitions of ranges begin with."""
    parts = stored(parts_of(hits, most, needed), "parts")
    n_large = parts.where("large").agg(F.sum("n")).first()[0]
    placed = hits.withColumn("slot", _slot()).join(parts.drop("n"), [*NAMES[:2], "slot"])
    order = [*NAMES, "ts_us", "seq"]
    out = emitted(placed.where("not large").repartition(*NAMES).sortWithinPartitions(*order), machine, {})
    if not n_large:
        return out
    # Partitions are what is linked, so they are kept as they are.
    ranges = saved(placed.where("large").repartitionByRange(-(-n_large // most), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    return out.unionByName(emitted(ranges, machine, link(ranges)))


#: What a range tells: its first and last group, whether they are one, and what its last group ends with if it begins in the range; then a row for each piece of what it makes of
#: a state that comes into its first group: of all up to this one (upto), that it ends with this one (end).
TOLD = pa.schema([("pid", pa.int32()), ("place", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()), ("window", pa.int64()), ("upto", pa.int64()), ("end", pa.int64())])


def told(ranges: DataFrame, columns: list[str], tell: Callable[[Iterator], Iterator[tuple]]) -> DataFrame:
    """The rows of TOLD that tell makes of the groups of each range, in the order of ranges and places, for one task to follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(tell(groups(batches, columns)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), TOLD, strict=True)], schema=TOLD)

    schema = "pid int, place long, first string, last string, one boolean, window long, upto long, end long"
    return ranges.mapInArrow(run, schema).repartition(1).sortWithinPartitions("pid", "place")


def edges_of(ranges: DataFrame) -> list[Row]:
    """Of each partition its first and its last group (one row, if they are one): rule, key, part, first, last, and its first and last time."""
    schema = "pid int, rule string, key string, part long, first boolean, last boolean, begin long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pid, n, begin, end = None, 0, 0, 0, 0
        row = lambda last: pa.RecordBatch.from_pylist([dict(zip(EDGE.names, (pid, *now, n == 1, last, begin, end), strict=True))], schema=EDGE)
        for name, batch, _, values in groups(batches, ["ts_us"]):
            pid = batch.column("pid")[0].as_py()
            if name != now:
                if n == 1:
                    yield row(False)
                now, n, begin = name, n + 1, int(values["ts_us"][0])
            end = int(values["ts_us"][-1])
        if now is not None:
            yield row(True)

    return sorted(ranges.mapInArrow(run, schema).collect(), key=lambda r: (r.pid, r.last))


def continued(edges: list[Row]) -> list[tuple[Row, Row | None]]:
    """For each partition in turn its first group, and the last group of the partition before if that is the same one."""
    out, before = [], None
    for r in edges:
        if r.first:
            out.append((r, before if before is not None and tuple(before[c] for c in NAMES) == tuple(r[c] for c in NAMES) else None))
        if r.last:
            before = r
    return out


def of_last_group(ranges: DataFrame, columns: list[str], schema: str, fields: pa.Schema, begin: Callable[[int, bool], object], feed: Callable[[object, dict[str, np.ndarray]], None], end: Callable[[object], tuple]) -> dict[int, tuple]:
    """What end tells of the last group of each partition after feed has seen all of its rows; begin is told the partition, and whether the group is its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, pid, state = None, 0, 0, None
        for name, batch, _, values in groups(batches, columns):
            if name != now:
                pid = batch.column("pid")[0].as_py()
                now, n = name, n + 1
                state = begin(pid, n == 1)
            feed(state, values)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, (pid, *end(state)), strict=True))], schema=fields)

    return {r[0]: tuple(r[1:]) for r in ranges.mapInArrow(run, schema).collect()}


def seq_type(hits: DataFrame) -> tuple[str, pa.DataType]:
    """What names events: numbers or texts."""
    return ("string", pa.string()) if isinstance(hits.schema["seq"].dataType, StringType) else ("long", pa.int64())


class Hits:
    """A threshold's state: the last hits that no firing has used, fewer than its count."""

    def __init__(self, t: np.ndarray | None = None, s: np.ndarray | None = None):
        self.t, self.s = (np.zeros(0, np.int64) if x is None else x for x in (t, s))


def count_hits(state: Hits, rows: dict[str, np.ndarray]) -> Iterator[tuple]:
    count, before = int(rows["count"][0]), len(state.t)
    t, s = np.concatenate([state.t, rows["ts_us"]]), np.concatenate([state.s, rows["seq"]])
    places, rest = firings(t, count, int(rows["window_us"][0]))
    for i in places:  # what was kept has not fired, so each is a new row
        yield i - before, count, s[max(i - count + 1, i - SHOWN + 1) : i + 1].tolist()
    rest = max(rest, len(t) - count + 1)
    state.t, state.s = t[rest:], s[rest:]


def link_thresholds(ranges: DataFrame) -> dict[int, Hits]:
    """A range may begin with any number of unused hits below the count, which are then the last before it. So it is walked from each number, those that come to the same are walked
    on as one, and what a range ends with, for each number that it begins with, is followed from range to range. The driver holds fewer hits of each range than a threshold's count.
    """
    edges = continued(edges_of(ranges))
    columns = ["ts_us", "seq", "count", "window_us"]
    seq_name, seq_kind = seq_type(ranges)
    pair = lambda *names: pa.schema([("pid", pa.int32()), *[(n, pa.list_(seq_kind if n == "s" else pa.int64())) for n in names]])

    def keep(state: Hits, rows: dict[str, np.ndarray]) -> None:
        most = int(rows["count"][0]) - 1
        state.t, state.s = (np.concatenate([x, rows[c]])[-most:] if most else x for x, c in ((state.t, "ts_us"), (state.s, "seq")))

    tails = of_last_group(ranges, columns, f"pid int, t array<long>, s array<{seq_name}>", pair("t", "s"), lambda pid, first: Hits(), keep, lambda s: (s.t.tolist(), s.s.tolist()))
    least = {r[0]: r[1] for r in ranges.groupBy("pid").agg(F.max("count")).collect()}
    halo: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    nothing = np.zeros(0, np.int64), np.zeros(0, seq_kind.to_pandas_dtype())
    for r, before in edges:
        if before is not None:
            t, s = np.array(tails[before.pid][0], np.int64), np.array(tails[before.pid][1], seq_kind.to_pandas_dtype())
            if before.first and before.pid in halo and len(t) < least[r.pid] - 1:  # a range of few hits: those before it count too
                t, s = (np.concatenate([x, y])[-(least[r.pid] - 1) :] for x, y in zip(halo[before.pid], (t, s), strict=True))
            halo[r.pid] = (t, s)

    def begin(pid: int, first: bool) -> dict:
        t, s = halo.get(pid, nothing) if first else nothing
        return {"at": list(range(len(t) + 1)), "states": {u: Hits(t[len(t) - u :], s[len(s) - u :]) for u in range(len(t) + 1)}}

    def feed(state: dict, rows: dict[str, np.ndarray]) -> None:
        for h in state["states"].values():
            for _ in count_hits(h, rows):
                pass
        state["at"] = [len(state["states"][u].t) for u in state["at"]]
        state["states"] = {len(h.t): h for h in state["states"].values()}

    ends = of_last_group(ranges, columns, "pid int, ends array<long>", pair("ends"), begin, feed, lambda s: (s["at"],))
    number: dict[int, int] = {}
    for r, before in edges:
        if before is not None:
            number[r.pid] = ends[before.pid][0][number.get(before.pid, 0) if before.first else 0]
    return {p: Hits(*(x[len(x) - n :] for x in halo[p])) for p, n in number.items()}


def threshold(hits: DataFrame, most: int = MOST) -> DataFrame:
    """The hits (rule, key, ts_us, seq, count, window_us, and any others) that make a threshold fire, with match_count and members.

    seq breaks ties of ts_us and names the event; members are the seqs of the last 25 hits that made it fire. A part of a key that has over most hits is cut into ranges of about so many.
    """
    name, kind = seq_type(hits)
    machine = Machine(Hits, count_hits, ["count", "window_us"], [("match_count", "long", pa.int64()), ("members", f"array<{name}>", pa.list_(kind))])
    return walk(hits, machine, link_thresholds, most, needed="count")


@dataclass
class Last:
    """A throttle's state: when it last let a hit through."""

    at: int | None = None


def let_through(state: Last, rows: dict[str, np.ndarray]) -> Iterator[tuple]:
    for i in emissions(rows["ts_us"], int(rows["window_us"][0]), state.at):
        state.at = int(rows["ts_us"][i])
        yield (i,)


def landings(t: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """What a throttle makes of sorted times, by the time from which on it may let through again: (upto, end), where for all such times up to one of upto, and after the one before,
    the last hit that is let through is at end. A time after all of upto is after all hits.

    The first hit that is let through is one of those within a window of the first of all. Walks from all of them jump at once, and those that meet go on as one, so no hit is looked at twice.
    """
    upto = np.unique(t[: np.searchsorted(t, t[0] + window, "left") + 1])
    end, at, walk_of = np.zeros(len(upto), np.int64), np.searchsorted(t, upto, "left"), np.arange(len(upto))
    walking = np.ones(len(upto), bool)
    while walking.any():
        if len(at) == 1:
            end[walking] = t[at[0] + emissions(t[at[0] :], window, None)[-1]]
            break
        after = np.maximum(np.searchsorted(t, t[at] + window, "left"), at + 1)
        over = after >= len(t)
        ends = walking & over[walk_of]
        end[ends] = t[at[walk_of[ends]]]
        walking &= ~ends
        new, number = np.unique(after[~over], return_inverse=True)
        renamed = np.zeros(len(at), np.int64)
        renamed[~over] = number
        at, walk_of = new, renamed[walk_of]
    last = np.append(end[1:] != end[:-1], True)
    return upto[last], end[last]


def tell_landings(pieces: Iterator) -> Iterator[tuple]:
    """The rows of TOLD of one range; of its first group it holds the times, of the others a state."""
    first, now, pid, window, times, state = None, None, 0, 0, [], Last()
    for name, batch, _, values in pieces:
        if first is None:
            first, pid, window = name, batch.column("pid")[0].as_py(), int(values["window_us"][0])
        if name != now:
            now, state = name, Last()
        if name == first:
            times.append(values["ts_us"])
        else:
            for _ in let_through(state, values):
                pass
    if first is None:
        return
    upto, end = landings(np.concatenate(times), window)
    text = lambda n: "\x1f".join(map(str, n))
    yield pid, 0, text(first), text(now), first == now, window, None, int(end[0]) if first == now else state.at
    for k, (u, e) in enumerate(zip(upto.tolist(), end.tolist(), strict=True)):
        yield pid, k + 1, None, None, None, None, u, e


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, at) of each range whose first group goes on from the range before, by putting together what all have told, in their order. Holds one state."""
    group, at, wanted, mine = None, None, None, None  # the last group so far, when it last let a hit through, and the time that is looked for in the pieces of the first group of this range
    schema = pa.schema([("pid", pa.int32()), ("at", pa.int64())])
    for batch in batches:
        found: list[tuple[int, int]] = []
        place, upto, end = (batch.column(c).fill_null(0).to_numpy() for c in ("place", "upto", "end"))
        cuts = [*np.flatnonzero(place == 0).tolist(), len(place)]
        for a, b in zip([0, *cuts], cuts, strict=False):
            if a == b:
                continue
            if place[a] == 0:
                row = {c: batch.column(c)[a].as_py() for c in ("pid", "first", "last", "one", "window", "end")}
                goes_on, wanted, mine = row["first"] == group and at is not None, None, row["one"]
                if goes_on:
                    found.append((row["pid"], at))
                    wanted = at + row["window"]
                if not (goes_on and mine):
                    group, at = row["last"], row["end"]
                a += 1
            if wanted is not None and mine:
                k = a + int(np.searchsorted(upto[a:b], wanted, "left"))
                if k < b:
                    at, wanted = int(end[k]), None
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def link_throttles(ranges: DataFrame) -> dict[int, Last]:
    """Each range is a function from when the key last let a hit through before it to when it does so last in it, which is told in pieces: as many as there are ends that it can come to,
    at most the hits within a window of its first. One task puts them together, reading them in order. So there is one job, however many ranges there are, and the driver gets a number for each.
    """
    columns = ["ts_us", "window_us"]
    return {r["pid"]: Last(r["at"]) for r in told(ranges, columns, tell_landings).mapInArrow(follow, "pid int, at long").collect()}


def throttle(hits: DataFrame, most: int = MOST) -> DataFrame:
    """The hits (rule, key, ts_us, seq, window_us, and any others) that a throttle lets through. A part of a key that has over most hits is cut into ranges of about so many."""
    return walk(hits, Machine(Last, let_through, ["window_us"], []), link_throttles, most)
