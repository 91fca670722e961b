"""Operator 2: token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.bpe import BatchEncoder, default_vocabulary, library_encoder
from logloom.llm.common import Texts, over_texts, rows, whole_texts
from logloom.llm.textvec import slices


def spliced_count(text: str, encoder: BatchEncoder, chunk: int, overlap: int) -> int:
    """Tokens of one text from chunks of so many characters.

    A cut of a chunk that began at a true cut is true if what decides it lies inside: the character
    after it, or a special string that begins there. From a true cut on, the cuts depend only on the text after it.
    So where two chunks both have a cut, and that of the first is true, they agree from there on, and
    tokens never cross cuts. Without such a place the overlap is doubled, and the chunk too once it is used up.
    """
    margin = 2 + max(map(len, encoder.vocabulary.special), default=0)
    n, total, true_from = len(text), 0, 0
    begin, end, wide = 0, min(len(text), chunk), overlap
    cuts, counts = encoder.offsets(text[:end])
    while end < n:
        start = end - wide
        if start <= true_from:
            begin, end, wide = true_from, min(n, true_from + 2 * (end - true_from)), overlap
            cuts, counts = encoder.offsets(text[begin:end])
            continue
        until = min(n, start + max(chunk, 2 * wide))
        later, later_counts = encoder.offsets(text[start:until])
        both = np.intersect1d(begin + cuts, start + later, assume_unique=True)
        both = both[(both > true_from) & (both <= end - margin)]
        if not len(both):
            wide *= 2
            continue
        splice = int(both[-1])
        there = begin + cuts
        total += int(counts[(there >= true_from) & (there < splice)].sum())
        begin, end, true_from, wide, cuts, counts = start, until, splice, overlap, later, later_counts
    return total + int(counts[begin + cuts >= true_from].sum())


def windows_of(size: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of chunks that cover so many characters, neighbours overlapping."""
    out = [(0, min(size, chunk))]
    while out[-1][1] < size:
        begin = out[-1][1] - overlap
        out.append((begin, min(size, begin + chunk)))
    return out


def joined(ends: list[int], cuts: list[np.ndarray], counts: list[np.ndarray], margin: int) -> int | None:
    """Tokens of a text from its chunks' cuts (places in the text) and the tokens that begin at each, spliced as ``spliced_count`` does; None if two neighbours have no place in common."""
    total, at = 0, 0  # at: the cut of the chunk from which on its cuts are true
    for k in range(len(cuts)):
        if k + 1 == len(cuts):
            return total + int(counts[k][at:].sum())
        first = max(at + 1, int(np.searchsorted(cuts[k], cuts[k + 1][0])))
        there = cuts[k][first : np.searchsorted(cuts[k], ends[k] - margin, "right")]
        common = np.flatnonzero(np.isin(there, cuts[k + 1], assume_unique=True))
        if not len(common):
            return None
        splice = first + int(common[-1])
        total += int(counts[k][at:splice].sum())
        at = int(np.searchsorted(cuts[k + 1], cuts[k][splice]))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, chunk: int = 2048, overlap: int = 256, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks) of each whole text.

    Texts of over a chunk's characters are encoded as overlapping chunks, those of many texts at a time, and spliced; where an overlap holds no
    common cut, that text is done again with overlaps that widen. A null or empty text has no tokens. Rows that repeat give rows that repeat.
    """
    if not 0 < overlap < chunk:
        raise ValueError("an overlap must be shorter than its chunk")
    path = vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int64())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path or default_vocabulary())
        margin = 2 + max(map(len, encoder.vocabulary.special), default=0)
        for doc_ids, part in texts:
            windows = [windows_of(len(t), chunk, overlap) for t in part]
            pieces = [t[a:b] for t, w in zip(part, windows, strict=True) for a, b in w]
            cuts: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for a, b in slices(pieces):
                start, entry, per = encoder.found(pieces[a:b])
                edge = np.cumsum(per)[:-1]
                begin = np.cumsum([0, *map(len, pieces[a : b - 1])])
                cuts += [x - o for x, o in zip(np.split(start, edge), begin.tolist(), strict=True)]
                counts += np.split(encoder.table.size[entry].astype(np.int64), edge)
            at, totals = 0, []
            for t, w in zip(part, windows, strict=True):
                found = joined([b for _, b in w], [c + a for c, (a, _) in zip(cuts[at : at + len(w)], w, strict=True)], counts[at : at + len(w)], margin)
                totals.append(spliced_count(t, encoder, chunk, 2 * overlap) if found is None else found)
                at += len(w)
            totals = np.array(totals, np.int64)
            yield rows(schema, doc_ids, [len(t.encode("utf-8", "surrogatepass")) for t in part], totals, totals > limit, list(map(len, windows)))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
