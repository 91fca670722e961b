"""Operator 3: sum-of-squares online packing of token ids into fixed windows."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.bpe import default_vocabulary, library_encoder
from logloom.llm.common import Texts, first_id, over_texts, rows, whole_texts

Document = tuple[int, int, np.ndarray, int]  # its id, what of it has been placed, the ids that have not, and how many it has
Placed = tuple[int, int, np.ndarray, int, int, int, bool]  # document, start, ids, tokens of the document, window, offset, whether it is of the tail


class SumOfSquares:
    """The level array and its open windows.

    levels[h] counts the open windows filled to h, and windows[h] has their numbers; a piece that is placed is done with, so nothing but this and the last documents is held. A piece goes
    where the sum of squares of all counts ends least; a full window leaves the array. The last documents wait until the end, as many as have the ids
    that open windows lack: then sizes are free, and each is cut to what lowers the sum most, so that all windows get full.
    """

    def __init__(self, capacity: int, first_window: int = 0):
        self.capacity, self.next_window = capacity, first_window
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.waiting: deque[Document] = deque()
        self.held = self.lacking = 0  # ids that wait, and ids that open windows lack

    def level_for(self, size: int, new: bool = True) -> int:
        """The level, 0 being a new window if that is allowed, to which a piece of under the capacity goes."""
        n, top = self.levels, self.capacity - size
        into = np.append(n[size : self.capacity], -0.5)  # a full window counts nowhere: 2 * -0.5 + 1 = 0
        change = 2 * into + 1
        change[1:] += 1 - 2 * n[1 : top + 1]
        change[1:][n[1 : top + 1] == 0] = np.inf
        return int(np.argmin(change)) if new else 1 + int(np.argmin(change[1:]))

    def put(self, level: int, doc: Document, size: int) -> Placed:
        """The first size ids of what is left of a document into a window of a level."""
        name, start, ids, tokens = doc
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
        else:
            window = self.next_window
            self.next_window += 1
            self.lacking += self.capacity
        self.lacking -= size
        if level + size < self.capacity:
            self.levels[level + size] += 1
            self.windows[level + size].append(window)
        return name, start, ids[:size], tokens, window, level, False

    def place(self, doc: Document) -> Iterator[Placed]:
        """A document's full windows, each alone, and its rest by sums of squares."""
        name, start, ids, tokens = doc
        while len(ids):
            size = min(len(ids), self.capacity)
            yield self.put(0 if size == self.capacity else self.level_for(size), (name, start, ids, tokens), size)
            start, ids = start + size, ids[size:]

    def add(self, doc: Document) -> Iterator[Placed]:
        """A document joins those that wait; those that need not wait longer are placed."""
        self.waiting.append(doc)
        self.held += len(doc[2])
        while self.held - len(self.waiting[0][2]) >= self.lacking + self.capacity:
            first = self.waiting.popleft()
            self.held -= len(first[2])
            yield from self.place(first)

    def finish(self) -> Iterator[Placed]:
        """Those that wait fill all windows. What is then over, less than a window, are the last ids: they are cut at powers of two, which need no padding."""
        over, at = (self.held - self.lacking) % self.capacity, 0
        fill = self.held - over
        tails = [1 << k for k in reversed(range(over.bit_length())) if over >> k & 1]
        while self.waiting:
            name, start, ids, tokens = self.waiting.popleft()
            while len(ids):
                if fill:
                    size = min(len(ids), fill)
                    least = max(self.capacity - size, 1)
                    levels = least + np.flatnonzero(self.levels[least:])
                    if len(levels):  # a window that gets full takes 2 * n - 1 from the sum of squares
                        level = int(levels[np.argmax(self.levels[levels])])
                        size = self.capacity - level
                    elif size >= self.capacity:
                        level, size = 0, self.capacity
                    else:
                        level = self.level_for(size, new=False) if self.levels.any() else 0
                    fill -= size
                    yield self.put(level, (name, start, ids, tokens), size)
                else:
                    size = min(len(ids), tails[0] - at)
                    yield name, start, ids[:size], tokens, self.next_window, at, True
                    at += size
                    if at == tails[0]:
                        tails, at, self.next_window = tails[1:], 0, self.next_window + 1
                start, ids = start + size, ids[size:]
        self.held = 0


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, settled).

    A document's ids are those of its text (null: none) and then end_id. Its full windows are sequences of their own; the
    rest is placed online by sums of squares, one level array for each task. Nothing is shuffled, and a task holds the levels of its open windows and its last documents, by
    which these get full. settled marks what is over then, under a window for each task, in sequences of a power of two. Rows that repeat are packed each.
    """
    return _packed(docs, vocabulary, capacity, end_id, id_col, text_col, False)


def pack_digests(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``pack`` returns with ids_crc32 (of unsigned little-endian 32-bit ids) in place of ids."""
    return _packed(docs, vocabulary, capacity, end_id, id_col, text_col, True)


def _packed(docs: DataFrame, path: str | None, capacity: int, end_id: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    ids_field = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ids_field, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path or default_vocabulary())
        packer = SumOfSquares(capacity, first_id())

        def shown(placed: list[Placed]) -> Iterator[pa.RecordBatch]:
            if placed:
                made = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()) if digest else ids.astype(np.int32), tokens, window, at, tail) for doc, start, ids, tokens, window, at, tail in placed]
                yield rows(schema, *zip(*made, strict=True))

        for doc_ids, part in texts:
            own = [np.append(ids, np.uint32(end_id)) for ids in encoder(part)]
            yield from shown([x for doc, ids in zip(doc_ids, own, strict=True) for x in packer.add((doc, 0, ids, len(ids)))])
        yield from shown(list(packer.finish()))

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return over_texts(whole_texts(docs, id_col, text_col), run, f"doc_id long, start long, length long, {kind}, doc_tokens long, sequence_id long, offset long, settled boolean")
