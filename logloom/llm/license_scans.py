"""Operator 6: licence statements in whole texts, by MinHash bands over overlapping windows and exact containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import Texts, over_texts, rows, whole_texts
from logloom.llm.textvec import Batch, mix, ragged, shingles_of, slices

#: Statements by which public licences are declared.
STATEMENTS: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Statements of fewer than five words. They are apart so that license_scans() without statements finds what it always has.
NOTICES: dict[str, str] = {"all-rights-reserved": "All rights reserved."}


def _bands(places: np.ndarray, per_band: int) -> np.ndarray:
    """A number for each band of each row of MinHash places."""
    grouped = places.reshape(len(places), -1, per_band)
    out = np.broadcast_to(np.arange(1, grouped.shape[1] + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(per_band):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return out


@dataclass
class Templates:
    """Templates by length class, with their MinHash bands.

    Shingles are runs of so many words; a template of fewer words is one shingle of all its words, and is sought among shingles of its own word count.

    Windows of a class have at least as many shingles as its longest template plus a stride, of a quarter of its shortest. So a window holds every
    occurrence whole. Of a template of n shingles, present to the least containment c, and a window of w shingles the similarity is
    at least c * n / (w + (1 - c) * n); n_bands is set for each class so that they meet in a band with a probability of at least sure.
    """

    names: list[str]
    shingles: list[np.ndarray]
    least: float
    per_band: int
    sure: float
    sizes: list[int]
    prepared: dict[int, list[tuple[int, int, int, list[tuple[int, np.ndarray]]]]]

    @classmethod
    def of(cls, texts: dict[str, str], least: float = 0.8, per_band: int = 2, sure: float = 0.99999, words: int = 5) -> Templates:
        names = sorted(texts)
        word, doc = cls._words([texts[n] for n in names])
        shingle, owner, _ = shingles_of(word, doc, len(names), words)
        sizes = np.minimum(np.bincount(doc, minlength=len(names)), words).tolist()
        out = cls(names, [np.unique(shingle[owner == i]) for i in range(len(names))], least, per_band, sure, sizes, {})
        for size in sorted({*sizes} - {0}):
            out.prepared[size] = [(window, stride, n, [(t, out.bands_of(t, n)) for t in members]) for window, stride, n, members in out.classes(size)]
        return out

    def bands_of(self, t: int, n_bands: int) -> np.ndarray:
        own = self.shingles[t]
        return _bands(np.array([[mix(own ^ mix(np.full(1, s + 1, np.uint64))).min() for s in range(n_bands * self.per_band)]]), self.per_band)

    @staticmethod
    def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lower-case words, which are runs of letters and numbers, and the text of each. So marks of comments and punctuation do not count."""
        batch = Batch.of([t.lower() for t in texts])
        start, end, doc = batch.words(bare=True)
        return batch.span_hashes(start, end), doc

    def classes(self, size: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(shingles of a window, stride, bands, templates) for templates of up to 1, 2, 4, ... shingles of size words."""
        by: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            if len(s) and self.sizes[i] == size:
                by.setdefault((len(s) - 1).bit_length(), []).append(i)
        for members in by.values():
            sizes = [len(self.shingles[i]) for i in members]
            stride = max(1, min(sizes) // 4)
            window = max(sizes) + stride
            similar = self.least * min(sizes) / (window + (1 - self.least) * min(sizes))
            yield window, stride, int(np.ceil(np.log(1 - self.sure) / np.log(1 - similar**self.per_band))), members

    def scan(self, texts: list[str]) -> list[tuple[int, str, float, int, int]]:
        """(text, template, largest containment, first word, number of separate places) of those that reach the least containment."""
        word, owner = self._words(texts)
        return self._places([x for size in self.prepared for x in self._windows(word, owner, len(texts), size)])

    def _windows(self, word: np.ndarray, of: np.ndarray, n_texts: int, size: int) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of the windows that reach the least containment of a template with shingles of size words."""
        shingle, doc, _ = shingles_of(word, of, n_texts, size)
        known = np.unique(np.concatenate([s for s, n in zip(self.shingles, self.sizes, strict=True) if n == size]))
        found = known[np.minimum(np.searchsorted(known, shingle), len(known) - 1)] == shingle
        if not found.any():
            return []
        per = np.bincount(doc, minlength=n_texts)
        base = np.cumsum(per) - per
        hits = np.flatnonzero(found)
        out = []
        for window, stride, n_bands, members in self.prepared[size]:
            # Only windows with a shingle of a template can meet one.
            place = hits - base[doc[hits]]
            low, high = np.maximum(-(-(place - window + 1) // stride), 0), place // stride
            item, k = ragged(high - low + 1)
            key = np.unique(doc[hits][item].astype(np.int64) << 32 | (low[item] + k))
            owner, begin = key >> 32, (key & 0xFFFFFFFF) * stride
            length = np.minimum(window, per[owner] - begin)
            at = base[owner] + begin
            span, part = ragged(length)
            content = shingle[at[span] + part]
            edge = np.cumsum(length) - length
            bands = _bands(np.stack([np.minimum.reduceat(mix(content ^ mix(np.full(1, s + 1, np.uint64))), edge) for s in range(n_bands * self.per_band)], 1), self.per_band)
            for t, mine in members:
                own = self.shingles[t]
                for w in np.flatnonzero((bands == mine).any(1)).tolist():
                    inside = content[edge[w] : edge[w] + length[w]]
                    hit = np.isin(inside, own)
                    share = len(np.unique(inside[hit])) / len(own)
                    if share >= self.least:
                        where = int(begin[w] + np.flatnonzero(hit)[0])
                        out.append((int(owner[w]), t, share, where))
        return out

    def _places(self, out: list[tuple[int, int, float, int]]) -> list[tuple[int, str, float, int, int]]:
        """One row for each text and template; windows whose first matching words lie closer than the template is long are one place."""
        by: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for text, t, share, where in out:
            by.setdefault((text, t), []).append((where, share))
        done = []
        for (text, t), found in sorted(by.items()):
            n, last = 0, -1 << 60
            for where, _ in sorted(found):
                if where - last >= len(self.shingles[t]):
                    n, last = n + 1, where
            best = max(s for _, s in found)
            done.append((text, self.names[t], best, min(w for w, s in found if s == best), n))
        return done


def license_scans(docs: DataFrame, statements: dict[str, str] | DataFrame | None = None, most_statements: int = 10_000, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, places): which statements a text has, to at least this share of their runs of five lower-case words of letters and numbers.

    first_word is where the first of the best windows has its first match. Texts without a match, empty and null ones have no rows. A statement of
    fewer than five words is found wherever its words stand in a row. The statements are STATEMENTS if none are given; the registered query adds NOTICES. A table (name, text)
    of whole notices may be given as well; all go to every task, so more than most_statements are refused. Rows that repeat are scanned each and give equal rows, a null id stays null, an empty
    table gives no rows.
    """
    if isinstance(statements, DataFrame):
        statements = {r["name"]: r["text"] or "" for r in statements.select("name", "text").limit(most_statements + 1).collect()}
        if len(statements) > most_statements:
            raise ValueError(f"more than {most_statements} statements")
    templates = Templates.of(STATEMENTS if statements is None else statements, least, words=words)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("places", pa.int64())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        for doc_ids, part in texts:
            found = [(doc_ids[a + t], *rest) for a, b in slices(part) for t, *rest in templates.scan(part[a:b])]
            if found:
                yield rows(schema, *zip(*found, strict=True))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, license string, containment double, first_word long, places long")
