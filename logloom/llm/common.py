"""What the operators share: reading whole texts and running a function over Arrow batches of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Texts = Iterator[tuple[list, list[str]]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns whatever else the input holds: the id as it is, and the text with null as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_slices(batch: pa.RecordBatch, text_col: str, most_chars: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about most_chars of text, so that a task never holds many long texts as Python strings."""
    sizes = pa.compute.binary_length(batch.column(text_col)).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + (n or 0) > most_chars:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def text_slices(batches: Iterable[pa.RecordBatch], most_chars: int = 1_000_000) -> Texts:
    """Ids and texts in lists of about most_chars."""
    for batch in batches:
        for part in row_slices(batch, "text", most_chars):
            yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[list[str]], object]) -> DataFrame:
    """The rows of docs, all columns as they are, whose text keep takes, null counting as empty."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [f.name for f in schema].index(text_col)
        for batch in batches:
            for part in row_slices(batch, batch.schema.names[at], 1_000_000):
                yield part.filter(pa.array(keep([t or "" for t in part.column(at).to_pylist()])))

    return docs.mapInArrow(run, schema)


def over_texts(docs: DataFrame, function: Callable[[Texts], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """function over the whole texts of each partition, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(text_slices(batches))

    return docs.mapInArrow(run, schema)


def whole_runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that end where a run of equal values in the first n_keys integer columns ends, and where each run starts."""

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(n_keys):
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(n_keys))
        edge = int(starts_of(pa.Table.from_batches([batch]))[-1])
        if not same or edge:
            if held or edge:
                table = pa.Table.from_batches([*held, batch.slice(0, edge)]).combine_chunks()
                yield table, starts_of(table)
            held = []
        held.append(batch.slice(edge))
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table)


def rows(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def first_id() -> int:
    """The first of 2**33 ids that only this partition gives out; a task that runs again gives the same."""
    return TaskContext.get().partitionId() << 33
