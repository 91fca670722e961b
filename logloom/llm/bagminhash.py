"""BagMinHash: signatures whose places agree with the probability of the weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np

from logloom.llm.textvec import mix, ragged

_STEP, _PLACE, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)

CHUNK = 1 << 15


def bags(shingle: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of each text and how often each occurs."""
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return shingle[first], doc[first], np.diff(np.append(first, len(doc)))


def signatures(element: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, size: int, seed: int = 1) -> np.ndarray:
    """size 64-bit places for each bag; 0 in all of an empty bag's.

    The weights 0 to count of an element are cut into levels: up to 1, and from each power of two to the next. Each level has a
    Poisson process of points in time, at a rate of its width for each place; a point falls on a place and on a weight inside
    the level, and holds for the bag if that weight is below its count. So the processes of two bags share what weights they share. A place's value
    names its earliest point. Points are made in the order of time, and only until a bag's places are likely to be full; a
    bag with an empty place goes on from there, so the result is that of the endless processes.
    """
    best = np.full(n_docs * size, np.inf)
    value = np.zeros(n_docs * size, np.uint64)
    total = np.bincount(doc, count, n_docs)
    n_levels = np.array([int(c - 1).bit_length() + 1 for c in range(1, 65)])[np.minimum(count, 64) - 1]
    for i in np.flatnonzero(count > 64):
        n_levels[i] = int(count[i] - 1).bit_length() + 1
    of, level = ragged(n_levels)
    low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    state = mix(element[of] + np.uint64(seed) * _LEVEL + (level + 1).astype(np.uint64) * _PLACE)
    owner, most = doc[of], count[of]
    time, made = np.zeros(len(of)), np.zeros(len(of), np.uint64)
    until = (np.log(size) + 3) / np.maximum(total, 1)
    open_bags = total > 0
    while open_bags.any():
        active = np.flatnonzero(open_bags[owner] & (time <= until[owner]))
        many = until[owner[active]] * size * width[active] > 3
        for part, block in ((active[~many], 1), (active[many], 16)):
            for a in range(0, len(part), CHUNK // block):
                _follow(part[a : a + CHUNK // block], block, size, owner, low, width, most, state, time, made, until, best, value)
        full = np.isfinite(best.reshape(n_docs, size)).all(1)
        # A point later than the time to which all of a bag's processes were followed may not be the earliest.
        open_bags &= ~(full & (np.where(np.isfinite(best), best, 0).reshape(n_docs, size).max(1) <= until))
        until = np.where(open_bags, until * 1.5, until)
    return value.reshape(n_docs, size)


def _follow(part: np.ndarray, block: int, size: int, owner: np.ndarray, low: np.ndarray, width: np.ndarray, most: np.ndarray, state: np.ndarray, time: np.ndarray, made: np.ndarray, until: np.ndarray, best: np.ndarray, value: np.ndarray) -> None:
    """Makes the points of some processes, so many at a time, until each is past its bag's time; keeps the earliest of each place."""
    while len(part):
        step = made[part][:, None] + np.arange(1, block + 1, dtype=np.uint64)
        random = mix(state[part][:, None] + step * _STEP)
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = time[part][:, None] + np.cumsum(gaps, 1) / (size * width[part])[:, None]
        where = mix(random ^ _PLACE)
        place = (where >> np.uint64(40)).astype(np.int64) % size
        weight = low[part][:, None] + ((where & np.uint64(0xFFFFFFFF)).astype(np.int64) * width[part][:, None] >> 32)
        holds = weight < most[part][:, None]
        key = (owner[part][:, None] * size + place)[holds]
        at, name = times[holds], random[holds]
        np.minimum.at(best, key, at)
        first = best[key] == at
        value[key[first]] = name[first]
        time[part] = times[:, -1]
        made[part] += np.uint64(block)
        part = part[times[:, -1] <= until[owner[part]]]

