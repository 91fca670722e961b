"""Operator 7: nearest neighbours by cosine over an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import saved
from logloom.llm.common import rows
from logloom.llm.samples import sampled

BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; angles stay exactly as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    random = np.random.default_rng(seed)
    centre = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, 1)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            centre[:, d] = np.where(n > 0, np.bincount(near, x[:, d], k) / np.maximum(n, 1), centre[:, d])
    return centre


@dataclass
class Codebooks:
    """Centroids of either half of unit vectors; a vector's cell is the pair of its nearest ones."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int) -> Codebooks:
        x, half = unit(x), x.shape[1] // 2
        k = min(k, len(x))
        return cls(k_means(x[:, :half], k), k_means(x[:, half:], k))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, half = unit(x), x.shape[1] // 2
        return tuple(((part**2).sum(1)[:, None] + (c**2).sum(1) - 2 * part @ c.T) for part, c in ((x[:, :half], self.first), (x[:, half:], self.second)))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(1), b.argmin(1)


def traversal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs (i, j) by the sum a[i] + b[j], least first, by a heap of the pairs whose smaller neighbours are done."""
    by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    next_in_row = [0] * len(by_a)
    heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
    while heap:
        _, p, q = heapq.heappop(heap)
        yield by_a[p], by_b[q]
        next_in_row[p] = q + 1
        if q + 1 < len(by_b) and (p == 0 or next_in_row[p - 1] > q + 1):
            heapq.heappush(heap, (a[by_a[p]] + b[by_b[q + 1]], p, q + 1))
        if p + 1 < len(by_a) and next_in_row[p + 1] == q:
            heapq.heappush(heap, (a[by_a[p + 1]] + b[by_b[q]], p + 1, q))


def probes(a: np.ndarray, b: np.ndarray, count: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """The cells in order until they hold enough rows."""
    out, total = [], 0
    for i, j in traversal(a, b):
        if count[i, j]:
            out.append((i, j))
            total += count[i, j]
            if total >= enough:
                break
    return out


def rows_before(a: np.ndarray, b: np.ndarray, count: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many rows a query visits until it has seen each of the cells, given its distances to either half's centroids."""
    order = np.argsort((a[:, None] + b).ravel(), kind="stable")
    before = np.empty(count.size, np.int64)
    before[order] = np.cumsum(count.ravel()[order])
    return before[cells]


def closest(x: np.ndarray, y: np.ndarray, least: np.ndarray, keep: int, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, cosine) of the keep rows of x with the largest cosine to each row of y, among those it visits; equal ones by least.

    Products of matrices choose what may be among them, with all that tie, and each chosen pair is then reckoned by itself.
    """
    x, y = scaled(x), scaled(y)
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for a in range(0, len(y), 256):
        close = (y[a : a + 256] @ x.T) / norm_x / norm_y[a : a + 256, None]
        if visits is not None:
            close = np.where(visits[a : a + 256], close, -np.inf)
        last = np.partition(close, max(close.shape[1] - keep, 0), axis=1)[:, max(close.shape[1] - keep, 0)]
        k, e = np.nonzero((close >= last[:, None] - 1e-9) & np.isfinite(close))
        k = k + a
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", y[k[c : c + 20_000]], x[e[c : c + 20_000]]) for c in range(0, len(k), 20_000))]) / (norm_y[k] * norm_x[e])
        order = np.lexsort((least[e], -score, k))
        k, e, score = k[order], e[order], score[order]
        first = np.searchsorted(k, k)
        top = np.arange(len(k)) - first < keep
        out.append((k[top], e[top], score[top]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def usable(column: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite, and not all 0."""
    finite = F.forall(column, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(column, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


FOUND = "asker long, entry long, score double"


def _found(entries: pd.DataFrame, askers: pd.DataFrame, keep: int, visits: np.ndarray | None = None) -> pd.DataFrame:
    if not len(entries) or not len(askers):
        return pd.DataFrame({"asker": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0)})
    k, e, score = closest(np.stack(entries.v), np.stack(askers.v), entries.least.to_numpy(), keep, visits)
    return pd.DataFrame({"asker": askers.asker.to_numpy()[k], "entry": entries.entry.to_numpy()[e], "score": score})


def among_few(entries: DataFrame, keep: int) -> DataFrame:
    """(asker, entry, score) of entries (n, entry, least, v, asks) of lengths n that have at most keep of them: all are found, so there is nothing to search."""

    def every(own: pd.DataFrame) -> pd.DataFrame:
        return _found(own, own[own.asks].rename(columns={"entry": "asker"})[["asker", "v"]], keep)

    return entries.groupBy("n").applyInPandas(every, FOUND)


def in_index(entries: DataFrame, n: int, keep: int, recall: float, most_sample: int, rows_per_cell: int, most_centroids: int, n_trials: int) -> DataFrame:
    """(asker, entry, score) by an inverted multi-index over n entries (entry, least, v, asks) of one length of two at least.

    Codebooks are fitted on a bounded sample. How many rows to visit is found on the whole table: the true nearest rows of n_trials entries are looked
    up, and visits go as far as the share recall of them needs. So the number follows the data, and its share falls where more rows lie closer.
    """
    some = sampled(entries.select("entry", "v"), "entry", n, most_sample, 17).toPandas().sort_values("entry")
    sample = np.random.default_rng(1).permutation(np.stack(some.v).astype(np.float64))
    books = Codebooks.fit(sample, int(np.clip(round((n / rows_per_cell) ** 0.5), 2, most_centroids)))
    trials = unit(sample[:n_trials])
    placed_schema = pa.schema([("entry", pa.int64()), ("least", pa.int64()), ("v", pa.list_(pa.float64())), ("asks", pa.bool_()), ("i", pa.int32()), ("j", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(placed_schema, *batch.columns, *books.cells(matrix(batch.column("v"))))

    placed = saved(entries.select("entry", "least", "v", "asks").mapInArrow(place, "entry long, least long, v array<double>, asks boolean, i int, j int"))
    count = np.zeros((len(books.first), len(books.second)), np.int64)
    counted = placed.groupBy("i", "j").count().toPandas()
    count[counted.i, counted.j] = counted["count"]

    def near_trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("trial", pa.int32()), ("close", pa.float64()), ("cell", pa.int64())])
        close, cells = np.full((len(trials), keep), -np.inf), np.zeros((len(trials), keep), np.int64)
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("i").to_numpy().astype(np.int64) * count.shape[1] + batch.column("j").to_numpy()
                both = np.concatenate([close, trials @ unit(matrix(batch.column("v"))).T], 1)
                at = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
                cells = np.take_along_axis(np.concatenate([cells, np.broadcast_to(cell, (len(trials), len(cell)))], 1), at, 1)
                close = np.take_along_axis(both, at, 1)
        k, c = np.nonzero(np.isfinite(close))
        yield rows(schema, k.astype(np.int32), close[k, c], cells[k, c])

    listed = placed.select("i", "j", "v").mapInArrow(near_trials, "trial int, close double, cell long").groupBy("trial").agg(F.slice(F.sort_array(F.collect_list(F.struct("close", "cell")), asc=False), 1, keep).alias("best"))
    a, b = books.distances(trials)
    needs = [x for r in listed.collect() for x in rows_before(a[r["trial"]], b[r["trial"]], count, np.array([c["cell"] for c in r["best"]]))]
    visit = max(float(np.quantile(needs, recall)), 4.0 * keep)
    splits = [max(1, -(-int(c) // BLOCK_ROWS)) for c in count.sum(1)]
    probe_schema = pa.schema([("asker", pa.int64()), ("v", pa.list_(pa.float64())), ("i", pa.int32()), ("js", pa.list_(pa.int32()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = matrix(part.column("v"))
                out: list[tuple] = []
                for asker, v, a, b in zip(part.column("entry").to_pylist(), x, *books.distances(x), strict=True):
                    by: dict[int, list[int]] = {}
                    for i, j in probes(a, b, count, visit):
                        by.setdefault(i, []).append(j)
                    out += [(asker, v, i, js) for i, js in by.items()]
                yield rows(probe_schema, *zip(*out, strict=True))

    probed = saved(placed.where("asks").select("entry", "v").mapInArrow(probe, "asker long, v array<double>, i int, js array<int>"))
    asked = {r["i"]: max(1, -(-r["count"] // BLOCK_QUERIES)) for r in probed.groupBy("i").count().collect()}
    table = lambda values: F.array(*map(F.lit, values))
    of = lambda values: F.element_at(table(values), F.col("i") + 1)
    n_asks = [asked.get(i, 0) for i in range(len(count))]
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.where(of(n_asks) > 0).select("entry", "least", "v", "i", "j", F.pmod(F.xxhash64("entry"), of(splits)).cast("int").alias("s"), spread(of(n_asks)).alias("q"))
    right = probed.select("asker", "v", "i", "js", F.pmod(F.xxhash64("asker"), F.greatest(of(n_asks), F.lit(1))).cast("int").alias("q"), spread(of(splits)).alias("s"))

    def best(entries: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
        visits = np.zeros((len(askers), count.shape[1]), bool)
        for k, js in enumerate(askers.js):
            visits[k, np.asarray(js)] = True
        return _found(entries, askers, keep, visits[:, entries.j.to_numpy()])

    return left.groupBy("i", "s", "q").cogroup(right.groupBy("i", "s", "q")).applyInPandas(best, FOUND)


def nearest_neighbours(vectors: DataFrame, query: Column, nearest: int = 5, recall: float = 0.97, most_sample: int = 16_000, rows_per_cell: int = 32, most_centroids: int = 1024, n_trials: int = 150, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where query holds, the nearest others found, by cosine in double precision.

    Equal scores go by the smaller id. Vectors that are null, zero or hold null or non-finite components take no part; nor do
    rows with a null id. Vectors of different lengths are no candidates for each other. An id that occurs again is a row of its own, and a row is no neighbour of its own id. An empty table gives no rows.

    Equal vectors are one entry, with as many of their least ids as a result can hold, so that copies cost nothing; of one component there are two, as only signs count. Each length is
    indexed for itself (``in_index``), every entry of it, and an entry meets only those blocks of queries that visit its first centroid. Only where all other entries of a length are
    a result anyway, as it has no more than that, is none built.
    """
    keep = nearest + 1
    v = F.col(vector_col).cast("array<double>")
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.size(v) == 1, F.transform(v, F.signum)).otherwise(v).alias("v"), query.alias("asks")).where(F.col("id").isNotNull() & usable(v))
    every = every.withColumn("asks", F.coalesce("asks", F.lit(False)))
    least = every.select("id", "v").withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("k") <= keep)
    asking = every.where("asks").select("v").distinct().withColumn("asks", F.lit(True))
    entries = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asking, "v", "left")
    entries = saved(entries.select("v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), F.get("ids", F.lit(0)).alias("least"), F.size("v").alias("n"), F.monotonically_increasing_id().alias("entry")))
    lengths = {r["n"]: r["count"] for r in entries.groupBy("n").count().collect()}
    common = sorted(n for n, c in lengths.items() if c > keep)  # vectors of one component are two entries
    blocks = among_few(entries.where(~F.col("n").isin(common)), keep)
    for n in common:
        blocks = blocks.unionAll(in_index(entries.where(F.col("n") == n), lengths[n], keep, recall, most_sample, rows_per_cell, most_centroids, n_trials))
    listed = blocks.join(entries.select("entry", "ids"), "entry").select("asker", "score", F.explode("ids").alias("id"))
    top = listed.withColumn("k", F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "id"))).where(F.col("k") <= keep)
    lists = top.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("found"))
    by_vector = lists.join(entries.select(F.col("entry").alias("asker"), "v"), "asker").select("v", "found")
    answered = every.where("asks").select(F.col("id").alias("query_id"), "v").join(by_vector, "v")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, nearest)
    return answered.select("query_id", F.posexplode(others).alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
