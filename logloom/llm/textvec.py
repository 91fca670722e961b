"""Vectorised text helpers that run inside tasks: one pass of numpy over a bounded batch of texts.

A batch of texts is laid end to end as an array of code points with the start of every
text, so that cutting into words and hashing them costs a few array operations for the batch
and not a Python step for each word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
import xxhash

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_MULT = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
#: Longer spans are hashed one by one: polynomials modulo a power of two are equal for pairs of regular texts from some hundred characters on.
SHORT = 32


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            gap = [x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1)]
            out[gap[0] : gap[1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x = x ^ (x >> np.uint64(27))
    x = x * _B
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _MULT, np.uint64)
    up[0] = 1
    down = np.full(size, np.uint64(pow(int(_MULT), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def _char_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * _MULT)


@dataclass
class Batch:
    """Texts laid end to end. starts has one entry more than there are texts."""

    chars: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Batch:
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        return cls(chars, starts)

    def classes(self) -> np.ndarray:
        return char_classes()[self.chars]

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans' characters, alike wherever a span stands."""
        n = len(self.chars)
        up, down = _powers(1 << max(16, int(n).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_char_codes()[self.chars] * up[:n], out=total[1:])
        out = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.chars[start[i] : end[i]].tobytes())
        return out

    def words(self, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs without white space, or of letters and numbers only, and the number of the text of each."""
        kind = self.classes()
        solid = (kind == LETTER) | (kind == NUMBER) if bare else kind != SPACE
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        cuts = self.starts[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(solid))]
        first[cuts] |= solid[cuts]
        last[cuts - 1] |= solid[cuts - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(self.starts[1:], start, "right")


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with so many parts each: the item of each part, and the part's number in it."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def shingle_hashes(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of size lower-case words, the text of each, and the first word of each.

    A text with fewer words has one shingle of all its words, and one without words has none.
    """
    batch = Batch.of([t.lower() for t in texts])
    start, end, doc = batch.words()
    return shingles_of(batch.span_hashes(start, end), doc, len(texts), size)


def shingles_of(word: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    per = np.bincount(doc, minlength=n_docs)
    have = np.where(per > 0, np.maximum(per - size + 1, 1), 0)
    item, part = ragged(have)
    at = (np.cumsum(per) - per)[item] + part
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = part + k < per[item]
        w = word[np.minimum(at + k, len(word) - 1)] if len(word) else np.zeros(0, np.uint64)
        out = np.where(there, mix(out * _MULT + w + np.uint64(k + 1)), out)
    return out, item, part


def slices(texts: list[str], most_chars: int = 300_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about most_chars characters; one long text is alone."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > most_chars:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)
