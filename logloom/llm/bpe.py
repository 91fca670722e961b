"""Byte-level BPE inside tasks: exact ids for batches of whole texts.

Texts are cut into pieces (runs of letters, numbers, marks and white space) for a whole batch at
once; each different piece is encoded once and kept, since merges never cross a piece.
Two encoders of a piece are here: that of a tokenizer library, and ``Backtracker``.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np

from logloom.llm.textvec import LETTER, SPACE, Batch, ragged, slices

#: Pieces that a worker keeps, and characters or ids of all of them.
MOST_KEPT, MOST_KEPT_CHARS = 700_000, 32_000_000
_QUOTE, _BLANK = ord("'"), ord(" ")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer's file asks for besides byte-level BPE with its usual pattern, plain merges and special strings that are taken as they stand."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    asked = {
        "a normalizer": spec.get("normalizer"),
        "another pre-tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True),
        "another model": model.get("type", "BPE") != "BPE",
        **{k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")},
        "flags of added tokens": any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    return [k for k, v in asked.items() if v]


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of each id, ranks of merges and strings that are one id each."""

    tokens: tuple[bytes, ...]
    ranks: dict[tuple[bytes, bytes], int]
    special: dict[str, int]

    @classmethod
    @functools.cache
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unlike = unsupported(spec)
        if unlike:
            raise ValueError(f"{path} needs what this encoder does not do: {', '.join(unlike)}")
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
        tokens = [b""] * size
        for t, i in spec["model"]["vocab"].items():
            if t not in special:
                tokens[i] = raw(t)
        for t, i in special.items():
            tokens[i] = t.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        return cls(tuple(tokens), {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}, special)

    @functools.cached_property
    def ids(self) -> dict[bytes, int]:
        plain = set(self.special.values())
        return {t: i for i, t in enumerate(self.tokens) if t and i not in plain}


def merged(data: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """BPE by its definition: merge the first of the lowest ranked neighbours until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Backtracker:
    """Exact merges in linear time.

    Tokens stand in a row in BPE's result exactly if no merge crosses any border between two
    neighbours. So the longest token (found by an Aho-Corasick automaton) is taken at each place if
    it is compatible with the one before, else the next shorter; a place from which no way leads
    on is never tried again. The pair-compatibility table is filled as pairs are met.
    """

    BLOCK = 4096

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.size = vocabulary.ids, [len(t) for t in vocabulary.tokens]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (left, right), rank in vocabulary.ranks.items():
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a << 32 | b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or i in self.parts:
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        self.table: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that stand at a token's edge while it is merged, each with the rank of the merge that ends it."""
        out = self.edges[right].get(token)
        if out is None:
            out, at, until = [], token, len(self.rank)
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][right]
            self.edges[right][token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of both, merged together, stay these two tokens.

        They don't if two tokens that meet at the border have a merge before either is merged
        away from it. Of equal merges the one further left is first.
        """
        key = a << 32 | b
        known = self.table.get(key)
        if known is None:
            rank = self.rank.get
            known = True
            for u, until_u in self.edge(a, True):
                for v, until_v in self.edge(b, False):
                    r = rank(u << 32 | v)
                    if r is not None and r < until_u and r <= until_v:
                        known = False
            if len(self.table) < 2 * MOST_KEPT:
                self.table[key] = known
        return known

    def _matches(self, text: str, begin: int, stop: int) -> list[list[tuple[int, int]]]:
        """For each place from begin to stop: the tokens that start there, longest last."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(stop - begin)]
        for end, match in self.automaton.iter(text, begin, min(len(text), stop + self.longest)):
            at = end + 1 - match[0] - begin
            if at < stop - begin:
                found[at].append(match)
        return found

    def encode(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None and (whole in self.parts or len(data) == 1):
            return [whole]
        text, size = data.decode("latin-1"), len(data)
        blocks: dict[int, list[list[tuple[int, int]]]] = {}
        table, compatible = self.table, self.compatible
        out: list[int] = []
        left: list[int] = []  # how many options each place on the way has left
        dead = bytearray(size + 1)
        at, rest, last = 0, -1, -1
        while at < size:
            block, place = divmod(at, self.BLOCK)
            if block not in blocks:
                if len(blocks) > 3:
                    del blocks[min(blocks)]
                blocks[block] = self._matches(text, block * self.BLOCK, min(size, (block + 1) * self.BLOCK))
            here = blocks[block][place]
            rest = len(here) if rest < 0 else rest
            while rest:
                rest -= 1
                length, token = here[rest]
                if not dead[at + length]:
                    fits = last < 0 or table.get(last << 32 | token)
                    if fits or fits is None and compatible(last, token):
                        out.append(token)
                        left.append(rest)
                        at, rest, last = at + length, -1, token
                        break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                at -= self.size[out.pop()]
                rest, last = left.pop(), out[-1] if out else -1
        return out


def piece_starts(batch: Batch, special: dict[str, int], texts: list[str]) -> tuple[np.ndarray, dict[int, int]]:
    """Where the pieces of all texts start, and the ids of those that are special strings.

    A space goes with the run after it; of other white space before a run the last character is alone,
    and white space at an end is one piece. English endings after an apostrophe are pieces.
    """
    chars, n = batch.chars, len(batch.chars)
    fixed: dict[int, int] = {}
    cuts = batch.starts[:-1]
    for s, i in special.items():
        for k, t in enumerate(texts):
            at = t.find(s)
            while at >= 0:
                fixed[int(batch.starts[k]) + at] = i
                at = t.find(s, at + len(s))
    if fixed:
        by_id = {i: len(s) for s, i in special.items()}
        cuts = np.unique(np.concatenate([cuts, np.fromiter(fixed, np.int64), np.fromiter((a + by_id[i] for a, i in fixed.items()), np.int64)]))
    cuts = cuts[cuts < n]
    kind = batch.classes()
    cut = np.zeros(n, bool)
    cut[cuts] = True
    start = cut.copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start & ~cut & (kind != SPACE))
    runs = runs[kind[runs - 1] == SPACE]
    start[runs - 1] = True
    start[runs[chars[runs - 1] == _BLANK]] = False
    quotes = np.flatnonzero((chars[:-1] == _QUOTE) & start[:-1] & start[1:] & ~cut[1:] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    ends = np.append(np.flatnonzero(cut), n)
    for q in quotes.tolist():
        stop = min(int(ends[np.searchsorted(ends, q, "right")]), q + 3)
        tail = "".join(map(chr, chars[q + 1 : stop]))
        size = 1 if tail[:1] in "stmd" else 2 if tail[:2] in ("re", "ve", "ll") else 0
        if size:
            start[q + 1] = False
            if q + 1 + size < n:
                start[q + 1 + size] = True
    for a, i in fixed.items():
        start[a + 1 : a + len(next(s for s, k in special.items() if k == i))] = False
    return np.flatnonzero(start), fixed


class PieceTable:
    """Open addressing over numpy arrays: pieces by hash, each with its characters and its ids.

    Entry 0 is kept free. A piece whose hash is that of another one is in ``other``, by its text.
    """

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entry = np.zeros(1 << bits, np.int64)
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.char_first, self.char_size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.chars = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.used = self.used_chars = 0
        self.count = 1
        self.other: dict[bytes, int] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, 0 where it is not kept."""
        slot = (hashes & self.mask).astype(np.int64)
        at = self.keys[slot]
        out = np.where(at == hashes, self.entry[slot], 0)
        todo = np.flatnonzero((at != hashes) & (at != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            at = self.keys[slot[todo]]
            hit = at == hashes[todo]
            out[todo[hit]] = self.entry[slot[todo[hit]]]
            todo = todo[~hit & (at != 0)]
        return out

    def same(self, entry: np.ndarray, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each entry holds just the characters of its piece."""
        out = self.char_size[entry] == end - start
        fits = np.flatnonzero(out)
        item, part = ragged((end - start)[fits])
        differs = self.chars[self.char_first[entry[fits]][item] + part] != chars[start[fits][item] + part]
        out[fits[item[differs]]] = False
        return out

    def keep(self, texts: list[np.ndarray], ids: list[list[int]]) -> np.ndarray:
        """New entries for pieces of so many characters and ids."""
        size, char_size = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(map(len, texts), np.int64, len(texts))
        entries = np.arange(self.count, self.count + len(ids))
        self.ids = _grown(self.ids, self.used + int(size.sum()))
        self.chars = _grown(self.chars, self.used_chars + int(char_size.sum()))
        self.ids[self.used : self.used + int(size.sum())] = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        self.chars[self.used_chars : self.used_chars + int(char_size.sum())] = np.concatenate([np.zeros(0, np.uint32), *texts])
        for name, values in (("first", self.used + np.cumsum(size) - size), ("size", size), ("char_first", self.used_chars + np.cumsum(char_size) - char_size), ("char_size", char_size)):
            column = _grown(getattr(self, name), self.count + len(ids))
            column[entries] = values
            setattr(self, name, column)
        self.used, self.used_chars, self.count = self.used + int(size.sum()), self.used_chars + int(char_size.sum()), self.count + len(ids)
        return entries

    def add(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slot, todo = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = hashes[free]
            won = free[self.keys[slot[free]] == hashes[free]]
            self.entry[slot[won]] = entries[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & int(self.mask)


def _grown(column: np.ndarray, least: int) -> np.ndarray:
    return column if least <= len(column) else np.concatenate([column, np.zeros(max(least - len(column), len(column)), column.dtype)])


class BatchEncoder:
    """Ids of whole texts; encode is called once for each different piece while it is kept.

    Pieces are found by hash and then compared by their characters, so equal hashes of different pieces do no harm.
    """

    def __init__(self, vocabulary: Vocabulary, encode: Callable[[bytes], list[int]]):
        self.vocabulary, self.encode = vocabulary, encode
        self.table, self.special = PieceTable(), {}

    def _ids_of(self, piece: np.ndarray) -> list[int]:
        return self.encode(piece.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"))

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts of the pieces, their entries in the table, and the number of pieces of each text."""
        batch = Batch.of(texts)
        if not len(batch.chars):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        start, fixed = piece_starts(batch, self.vocabulary.special, texts)
        end = np.append(start[1:], len(batch.chars))
        hashes = self.hashes(batch, start, end)
        if self.table.count > MOST_KEPT or max(self.table.used, self.table.used_chars) > MOST_KEPT_CHARS:
            self.table, self.special = PieceTable(), {}
        table, chars = self.table, batch.chars
        entry = table.find(hashes)
        missed = np.flatnonzero(entry == 0)
        if len(missed):
            new, at = np.unique(hashes[missed], return_index=True)
            pieces = [chars[a:b] for a, b in zip(start[missed[at]].tolist(), end[missed[at]].tolist(), strict=True)]
            table.add(new, table.keep(pieces, [self._ids_of(p) for p in pieces]))
            entry[missed] = table.find(hashes[missed])
        for i in np.flatnonzero(~table.same(entry, chars, start, end)).tolist():
            piece = chars[start[i] : end[i]]
            if (name := piece.tobytes()) not in table.other:
                table.other[name] = int(table.keep([piece], [self._ids_of(piece)])[0])
            entry[i] = table.other[name]
        for a, i in fixed.items():
            if i not in self.special:
                self.special[i] = int(table.keep([np.zeros(0, np.uint32)], [[i]])[0])
            entry[np.searchsorted(start, a)] = self.special[i]
        of_text = np.searchsorted(batch.starts[1:], start, "right")
        return start, entry, np.bincount(of_text, minlength=len(texts))

    @staticmethod
    def hashes(batch: Batch, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = batch.span_hashes(start, end)
        out[out == 0] = 1
        return out

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a text start, and the number of tokens of each."""
        start, slot, _ = self.found([text])
        return start, self.table.size[slot].astype(np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        _, slot, per_text = self.found(texts)
        total = np.append(0, np.cumsum(self.table.size[slot], dtype=np.int64))
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for a, b in slices(texts):
            _, slot, per_text = self.found(texts[a:b])
            per_piece = self.table.size[slot].astype(np.int64)
            item, part = ragged(per_piece)
            ids = self.table.ids[self.table.first[slot][item] + part]
            at = np.append(0, np.cumsum(per_piece))[np.append(0, np.cumsum(per_text))]
            out += [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out


@functools.cache
def library_encoder(path: str) -> BatchEncoder:
    """Pieces are encoded by a tokenizer library's merges over the same vocabulary."""
    import tiktoken

    vocabulary = Vocabulary.load(path)
    whole = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.ids, special_tokens={})
    return BatchEncoder(vocabulary, lambda piece: whole.encode_ordinary(piece.decode()))


@functools.cache
def backtracking_encoder(path: str) -> BatchEncoder:
    vocabulary = Vocabulary.load(path)
    return BatchEncoder(vocabulary, Backtracker(vocabulary).encode)


class OffsetTable:
    """All tokens' bytes end to end with their offsets: ids become bytes by one gather."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        item, part = ragged(self.size[ids])
        return self.data[self.first[ids][item] + part].tobytes()

