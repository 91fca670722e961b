"""Operator 1: best-fit-decreasing packing into id matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.bpe import default_vocabulary, library_encoder
from logloom.llm.common import Texts, first_id, over_texts, rows, whole_texts


class CapacityTree:
    """A segment tree over free capacities: the least one that is at least a size, in steps of its logarithm."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, size: int) -> int:
        """-1 if none is large enough."""
        node = self.leaves + size
        if self.count[node]:
            return size
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.count[2 * node])
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes; the largest first, each into the fullest bin that has room. Ties go by index."""
    tree, bins = CapacityTree(capacity), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        free = tree.least(size)
        if free < 0:
            bins.append([i])
            at, free = len(bins) - 1, capacity
        else:
            at = by_free[free].pop()
            tree.add(free, -1)
            bins[at].append(i)
        if free - size:
            by_free[free - size].append(at)
            tree.add(free - size, 1)
    return bins


def pack_matrices(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, matrix_rows: int = 64, end_id: int | None = None, pad_id: int = 0, batch_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each matrix: (matrix_id, n_rows, id_bytes, ids, cu_seqlens, position_ids, n_tokens, pieces).

    ids is the row-major matrix of n_rows times capacity unsigned little-endian ids of id_bytes each; cu_seqlens has the ends of
    all segments in it, padding being segments too; position_ids has a 16-bit position for each id that starts anew with every segment.
    pieces has (doc_id, start, length, row, offset). A document's ids are those of its text and then end_id (by default the vocabulary's
    first special id). One of over capacity ids is cut into full rows and a rest, so that all ids are kept. Each task packs as many documents at once as have
    batch_tokens, so memory is bounded and nothing is shuffled. A null text counts as empty; rows that repeat are packed each.
    """
    if not 0 < capacity <= 65_535:
        raise ValueError("capacity must fit in 16 bits")
    path = vocabulary
    piece = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("row", pa.int32()), ("offset", pa.int32())])
    schema = pa.schema([("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("n_tokens", pa.int64()), ("pieces", pa.list_(piece))])

    def matrices(pieces: list[tuple[int, int, np.ndarray]], kind: type, next_id: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        bins = best_fit_decreasing(sizes, capacity)
        for a in range(0, len(bins), matrix_rows):
            part = bins[a : a + matrix_rows]
            ids = np.full((len(part), capacity), pad_id, kind)
            ends, where, used = [], [], 0
            for r, members in enumerate(part):
                at = 0
                for i in members:
                    doc, start, own = pieces[i]
                    ids[r, at : at + len(own)] = own
                    where.append({"doc_id": doc, "start": start, "length": len(own), "row": r, "offset": at})
                    at += len(own)
                    ends.append(r * capacity + at)
                used += at
                if at < capacity:
                    ends.append((r + 1) * capacity)
            ends = np.array([0, *ends], np.int32)
            lengths = np.diff(ends)
            positions = np.arange(ids.size, dtype=np.int64) - np.repeat(ends[:-1], lengths)
            yield rows(schema, [next_id], [len(part)], [ids.itemsize], [ids.tobytes()], [ends], [positions.astype("<u2").tobytes()], [used], [where])
            next_id += 1

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path or default_vocabulary())
        vocab = encoder.vocabulary
        last = end_id if end_id is not None else next(iter(vocab.special.values()), 0)
        kind = np.dtype("<u2") if max(len(vocab.tokens), last + 1, pad_id + 1) <= 1 << 16 else np.dtype("<u4")
        next_id, held, pieces = first_id(), 0, []
        for doc_ids, part in texts:
            for doc, ids in zip(doc_ids, encoder(part), strict=True):
                ids = np.append(ids, np.uint32(last)).astype(kind)
                pieces += [(doc, start, ids[start : start + capacity]) for start in range(0, len(ids), capacity)]
                held += len(ids)
                if held >= batch_tokens:
                    for out in matrices(pieces, kind, next_id):
                        yield out
                        next_id += 1
                    held, pieces = 0, []
        yield from matrices(pieces, kind, next_id)

    return over_texts(whole_texts(docs, id_col, text_col), run, "matrix_id long, n_rows int, id_bytes int, ids binary, cu_seqlens array<int>, position_ids binary, n_tokens long, pieces array<struct<doc_id:long,start:long,length:int,row:int,offset:int>>")
