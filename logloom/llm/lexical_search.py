"""Operator 13: exact ranked lexical search with block-max pruning."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import stored
from logloom.llm.common import Texts, over_texts, rows, whole_texts
from logloom.llm.textvec import ragged

#: In UTF-8: digits, small letters and all bytes of characters that are not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_ID = np.iinfo(np.int64).max


def term_counts(text: str, most_bytes: int = 4_000_000) -> Counter[bytes]:
    """Terms of a text with A-Z alone made small, and how often each occurs; cut after every most_bytes where a term ends, so that few are held at a time."""
    data, found, at = text.encode("utf-8", "surrogatepass").lower(), Counter(), 0
    while at < len(data):
        end = at + most_bytes
        if end < len(data) and (cross := TERM.match(data, end)):
            end = cross.end()
        found.update(TERM.findall(data, at, end))
        at = end
    return found


@dataclass
class Queries:
    """Items as rows of (term, occurrences): the terms of item k are terms[first[k]:first[k + 1]], by their number in vocabulary."""

    vocabulary: dict[bytes, int]
    first: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        counted = [term_counts(t) for t in texts]
        terms = [vocabulary.setdefault(t, len(vocabulary)) for c in counted for t in c]
        return cls(vocabulary, np.cumsum([0, *map(len, counted)]), np.array(terms, np.int64), np.array([n for c in counted for n in c.values()], np.int64))

    def __len__(self) -> int:
        return len(self.first) - 1


@dataclass
class Statistics:
    """N documents with a term, L terms in all of them, and the documents that hold each term of the vocabulary."""

    n_docs: int
    n_terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for df in self.holding], np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray, b: int) -> np.ndarray:
        """What a term of weight 1 adds to the score of a document of n terms that holds it tf times."""
        m = 100 - b + (b * n * self.n_docs) // max(self.n_terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Block:
    """A range of documents: their terms with impacts, document by document, and the greatest impact of each term in it."""

    ids: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, per: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_vocabulary: int) -> Block:
        most, some = np.zeros(n_vocabulary, np.int64), per > 0  # a document without a term of the vocabulary has no score
        np.maximum.at(most, terms, impacts)
        return cls(ids[some], (np.cumsum(per) - per)[some], terms, impacts, most)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """Of each document, by a weight for each term of the vocabulary."""
        return np.add.reduceat(weight[self.terms] * self.impacts, self.first)


class Search:
    """Runs inside a task over groups of blocks; best holds the found (score, id) of each item, and floor what a document must reach."""

    def __init__(self, queries: Queries, weights: np.ndarray, keep: int, floor: np.ndarray):
        self.queries, self.keep, self.floor = queries, keep, floor.copy()
        self.value = weights[queries.terms] * queries.repeats
        self.dense = np.zeros(len(weights), np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(queries))]
        self.pairs = self.scored = 0

    def bounds(self, blocks: list[Block]) -> np.ndarray:
        """The most that a document of each block (columns) can score for each item (rows)."""
        q = self.queries
        per = np.diff(q.first)
        out = np.zeros((len(q), len(blocks)), np.int64)
        some = np.flatnonzero(per)
        if len(some):
            for k, block in enumerate(blocks):
                out[some, k] = np.add.reduceat(block.most[q.terms] * self.value, q.first[:-1][some])
        return out

    def visit(self, item: int, blocks: list[Block], bounds: np.ndarray, most_blocks: int | None = None) -> None:
        """Scores blocks from the highest bound on, until the next one cannot hold a document that is among the best."""
        a, b = self.queries.first[item], self.queries.first[item + 1]
        self.dense[self.queries.terms[a:b]] = self.value[a:b]
        for k in np.argsort(-bounds, kind="stable")[:most_blocks].tolist():
            if bounds[k] < max(self.floor[item], 1):
                break
            score = blocks[k].scores(self.dense)
            there = np.flatnonzero(score >= max(self.floor[item], 1))
            self.scored += 1
            if len(there):
                score, ids = np.append(self.best[item][0], score[there]), np.append(self.best[item][1], blocks[k].ids[there])
                top = np.lexsort((ids, -score))[: self.keep]
                self.best[item] = score[top], ids[top]
                if len(top) == self.keep:
                    self.floor[item] = max(self.floor[item], int(score[top[-1]]))
        self.dense[self.queries.terms[a:b]] = 0

    def over(self, blocks: list[Block], most_blocks: int | None = None) -> None:
        bounds = self.bounds(blocks)
        self.pairs += int(np.count_nonzero(bounds))
        for item in np.flatnonzero(bounds.any(1)).tolist():
            self.visit(item, blocks, bounds[item], most_blocks)


def groups_of_blocks(batches: Iterator[pa.RecordBatch], known: Statistics, b: int, block_docs: int, group_blocks: int) -> Iterator[list[Block]]:
    """Blocks of block_docs consecutive rows of the index, at most group_blocks at a time."""
    group: list[Block] = []
    for batch in batches:
        for at in range(0, batch.num_rows, block_docs):
            part = batch.slice(at, block_docs)
            listed = part.column("terms")
            per = pc.list_value_length(listed).to_numpy().astype(np.int64)
            doc, _ = ragged(per)
            terms, tf = listed.flatten().to_numpy().astype(np.int64), part.column("tfs").flatten().to_numpy()
            impacts = known.impacts(tf, part.column("n").to_numpy()[doc], b)
            group.append(Block.of(pc.fill_null(part.column("doc_id"), NO_ID).to_numpy(), per, terms, impacts, len(known.holding)))
            if len(group) == group_blocks:
                yield group
                group = []
    if group:
        yield group


def forward_index(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row with a term, in the order of the table: n terms in all, and of the vocabulary those that it holds with their occurrences."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
    vocabulary = queries.vocabulary

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for doc_ids, part in texts:
            out = []
            for doc, text in zip(doc_ids, part, strict=True):
                counts = term_counts(text)
                if n := counts.total():
                    own = sorted((vocabulary[t], counts[t]) for t in known & counts.keys())
                    out.append((doc, n, [t for t, _ in own], [c for _, c in own]))
            if out:
                yield rows(schema, *zip(*out, strict=True))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, n long, terms array<int>, tfs array<long>")


def statistics(index: DataFrame, n_vocabulary: int) -> Statistics:
    """Over the whole index; each task adds up what it has read, and what comes back has one row for each term at most."""
    totals = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = np.zeros(n_vocabulary, np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        holding[r["term"]] = r["df"]
    return Statistics(totals["docs"], totals["terms"], holding)


def search(docs: DataFrame, items: DataFrame, keep: int = 10, b: int = 75, block_docs: int = 256, group_blocks: int = 64, most_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the keep rows of docs with the highest score above 0, equal ones by the smaller id, null last.

    Items are taken in groups of about most_chars of text, which is what the driver and each task hold of them. For a group, one pass over docs writes the forward index
    (for each document, its terms that an item holds); its totals give all weights. Then two passes over the index cut it into blocks of block_docs consecutive
    documents with the greatest impact of each term. The first scores, for each item and group of blocks, the one with the highest bound: the keep-th best score found is a
    floor that no document of the result is under. The second takes each item's blocks by falling bound and stops where the bound is under the floor, which rises with what is found. Scores
    are whole numbers and bounds are never too low, so the result is exact. No row is made for a pair of an item and a document but for the
    keep best of each task.

    A null or empty text has no terms: such a document isn't counted, such an item finds nothing. Rows that repeat, in either table, are rows of their own.
    """
    texts = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    texts = stored(texts, "items")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n_groups = max(1, -(-chars // most_chars))
    found = None
    for g in range(n_groups):
        own = texts.where(F.pmod(F.xxhash64("row"), F.lit(n_groups)) == g)
        part = _search(docs, own, keep, b, block_docs, group_blocks, id_col, text_col)
        found = part if found is None else found.unionAll(part)
    return found


def _search(docs: DataFrame, items: DataFrame, keep: int, b: int, block_docs: int, group_blocks: int, id_col: str, text_col: str) -> DataFrame:
    asked = items.toPandas().sort_values("row")
    queries = Queries.of(asked["text"].tolist())
    index = stored(forward_index(docs, queries, id_col, text_col), "index")
    known = statistics(index, len(queries.vocabulary))
    weights = known.weights()
    best_first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def over_index(floor: np.ndarray, most_blocks: int | None) -> DataFrame:
        schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = Search(queries, weights, keep, floor)
            for blocks in groups_of_blocks(batches, known, b, block_docs, group_blocks):
                task.over(blocks, most_blocks)
            item = np.repeat(np.arange(len(task.best)), [len(s) for s, _ in task.best])
            score, ids = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in task.best)]) for k in (0, 1))
            yield rows(schema, item, pa.array(ids, mask=ids == NO_ID), score)

        found = index.mapInArrow(run, "item int, doc_id long, score long")
        return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= keep)

    floor = np.zeros(len(queries), np.int64)
    for r in over_index(floor, 1).where(F.col("rank") == keep).collect():  # a row for each item
        floor[r["item"]] = r["score"]
    names = docs.sparkSession.createDataFrame(pd.DataFrame({"item": np.arange(len(asked), dtype=np.int32), "row": asked["row"].to_numpy(np.int64)}), "item int, row long")
    return over_index(floor, None).join(names, "item").join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
