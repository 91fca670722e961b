"""State of many keys as one: keys are dealt into parts by a hash, and a part's state is a few packed tables.

Calls from Python to the state cost in the order of a millisecond a key, and rows of a list of state are packed one by one. So what a micro-batch costs besides its rows is bounded by the number of parts.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a micro-batch, a task holds the rows of one part at a time; a part that lets rows go writes what it keeps anew.
PARTS = 512


def part_of(*names: str) -> Column:
    """The part of a key."""
    return F.pmod(F.xxhash64(*names), F.lit(PARTS)).alias("part")


def packed(rows: pa.Table, compression: str | None = None) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pa.Table:
    with pa.ipc.open_stream(bytes(rows)) as reader:
        return reader.read_all()


def gathered(frames: Iterable[pd.DataFrame], schema: pa.Schema) -> pa.Table:
    """The columns of schema of all frames, as one table."""
    return pa.concat_tables([schema.empty_table(), *(pa.Table.from_pandas(f[schema.names], schema, preserve_index=False) for f in frames if len(f))])


def in_order(rows: pa.Table, keys: tuple[str, ...], order: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    """rows by key and, in a key, by order; and where the keys begin, with the end. A null is a value like others."""
    code = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        own = rows.column(k).combine_chunks().dictionary_encode()
        code = code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
    done = rows.append_column("_code", pa.array(code)).sort_by([(c, "ascending") for c in ("_code", *order)]).combine_chunks()
    sorted_codes = done.column("_code").to_numpy()
    return done.drop_columns(["_code"]), np.concatenate([[0], np.flatnonzero(sorted_codes[1:] != sorted_codes[:-1]) + 1, [len(code)]]) if len(code) else np.zeros(1, np.int64)

