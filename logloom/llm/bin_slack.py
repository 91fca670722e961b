"""Operator 12: minimum-bin-slack packing of token ids into as few windows as it can."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import stored
from logloom.llm.bpe import default_vocabulary, library_encoder
from logloom.llm.common import Texts, over_texts, rows, whole_texts


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often each length is taken in the combination of available lengths that fills room most; of equally full ones, one with long pieces.

    A bitset has a bit for each sum that can be made. Lengths enter from the shortest, each in as many copies as there are and as fit, in powers of two; on the way
    back from the largest sum a copy of a longer length is taken wherever the sums of all before it allow that.
    """
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # the sums before the step, its length, its copies
    for length in sorted(x for x, n in counts.items() if n and x <= room):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((sums, length, copies))
            sums |= sums << length * copies & mask
            left, copies = left - copies, 2 * copies
    at, taken = sums.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if at >= length * copies and before >> at - length * copies & 1:
            at -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return taken


@dataclass
class Plan:
    """Windows by what they hold. A run is a number of windows of one combination; for each length in it: the run's first window, how many copies a window has, the
    offset of the first copy, and the rank of the first piece of that length which goes to the run."""

    n_windows: int
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window and the offset of each piece, from its length and its rank among all pieces of that length."""
        window, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for x in np.unique(length).tolist():
            own = np.flatnonzero(length == x)
            first, copies, begin, start = self.runs[x]
            k = np.searchsorted(start, rank[own], "right") - 1
            q, slot = np.divmod(rank[own] - start[k], copies[k])
            window[own], offset[own] = first[k] + q, begin[k] + slot * x
        return window, offset


def planned(counts: dict[int, int], capacity: int) -> Plan:
    """Each window takes the longest length that is left and the fullest combination for its remaining room, and then both are removed.

    What is found is used for as many windows as its pieces last, so the work depends on the different lengths, not on their numbers: a
    combination is done when a length has fewer pieces left than it takes.
    """
    left, used = {x: n for x, n in counts.items() if n}, dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in left}
    n_windows = 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        taken = fullest(rest, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times, begin = min(left[x] // n for x, n in taken.items()), 0
        for x, n in sorted(taken.items()):
            runs[x].append((n_windows, n, begin, used[x]))
            used[x] += n * times
            left[x] -= n * times
            begin += n * x
            if not left[x]:
                del left[x]
        n_windows += times
    return Plan(n_windows, {x: tuple(np.array(column, np.int64) for column in zip(*r, strict=True)) for x, r in runs.items()})


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids, sequence_id, offset).

    A document's ids are those of its text (null or empty: none) and then end_id. Only one of over capacity ids is cut, the first piece taking what is over whole windows.
    Which window a piece goes to follows from its length and its rank among all pieces of that length: tasks number their own pieces, the counts of
    each task and length give what comes before, and the plan is made of one count for each length. So windows are filled from the whole corpus, whatever its partitions, and
    neither texts nor ids are gathered. Rows that repeat are packed each; an empty table gives no rows.
    """
    return _packed(docs, vocabulary, capacity, end_id, id_col, text_col, False)


def pack_digests(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``pack`` returns with ids_crc32 (of unsigned little-endian 32-bit ids) in place of ids."""
    return _packed(docs, vocabulary, capacity, end_id, id_col, text_col, True)


def _packed(docs: DataFrame, path: str | None, capacity: int, end_id: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    if capacity < 1:
        raise ValueError("a window holds one id at least")
    shown, kind, field = ("ids_crc32", "long", pa.int64()) if digest else ("ids", "array<int>", pa.list_(pa.int32()))
    cut_schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), (shown, field), ("task", pa.int32()), ("local", pa.int64())])

    def cut(texts: Texts) -> Iterator[pa.RecordBatch]:
        encoder, task = library_encoder(path or default_vocabulary()), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for doc_ids, part in texts:
            out: list[tuple] = []
            for doc, ids in zip(doc_ids, encoder(part), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    own = ids[a:b]
                    out.append((doc, k, a, b - a, zlib.crc32(own.astype("<u4", copy=False).tobytes()) if digest else own.astype(np.int32), task, int(seen[b - a])))
                    seen[b - a] += 1
            if out:
                yield rows(cut_schema, *zip(*out, strict=True))

    pieces = stored(over_texts(whole_texts(docs, id_col, text_col), cut, f"doc_id long, piece int, start long, length long, {shown} {kind}, task int, local long"))
    counts = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))  # up to capacity rows for each task
    plan = planned({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", shown, (F.col("before") + F.col("local")).alias("rank"))
    schema = pa.schema([*[cut_schema.field(c) for c in ("doc_id", "piece", "start", "length", shown)], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(schema, *batch.columns[:5], *plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy()))

    return numbered.mapInArrow(place, f"doc_id long, piece int, start long, length long, {shown} {kind}, sequence_id long, offset long")
