"""Operator 4: exact BPE encoding by backtracking and decoding by an offset table."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.bpe import OffsetTable, Vocabulary, backtracking_encoder, default_vocabulary
from logloom.llm.common import Texts, over_texts, rows, whole_texts


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text. A null text counts as empty, and an empty one has no ids."""
    path, schema = vocabulary, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        encoder = backtracking_encoder(path or default_vocabulary())
        for doc_ids, part in texts:
            found = encoder(part)
            ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
            yield rows(schema, doc_ids, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).astype(np.int32))))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of what ``encode`` returns; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    path, schema = vocabulary, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OffsetTable(Vocabulary.load(path or default_vocabulary()))
        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))
            texts = [table.decode(ids[a:b].astype(np.int64)).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield rows(schema, batch.column("doc_id"), texts)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@functools.cache
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = [b"%d," % i for i in range(size)]
    lengths = np.array(list(map(len, texts)), np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


def decimal_text(ids: np.ndarray, size: int) -> bytes:
    """The ids as decimals with commas between them."""
    from logloom.llm.textvec import ragged

    data, first, lengths = _decimals(size)
    item, part = ragged(lengths[ids])
    return data[first[ids][item] + part].tobytes()[:-1]


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text in its task, so that ids need not leave it.

    A null text counts as empty: no tokens, and both digests those of no bytes. Rows that repeat give rows that repeat.
    """
    path = vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        encoder = backtracking_encoder(path or default_vocabulary())
        table = OffsetTable(encoder.vocabulary)
        size = len(encoder.vocabulary.tokens)
        for doc_ids, part in texts:
            found = encoder(part)
            yield rows(
                schema,
                doc_ids,
                [len(x) for x in found],
                [hashlib.sha256(decimal_text(x, size)).hexdigest() for x in found],
                [hashlib.sha256(table.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in found],
            )

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
