"""Bounded samples of rows for fitting a model on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.checkpoints import stored


def sampled(df: DataFrame, key: str | list[str], n: int, most: int, seed: int) -> DataFrame:
    """At most most of the n rows of df: those whose key's hash is least, the same whatever the partitions.

    Where only some are taken, a bound on the hash leaves few rows to sort. Rows of one key are alike to it, so the key should tell rows apart.
    """
    keys = [key] if isinstance(key, str) else key
    hashed = F.xxhash64(*keys, F.lit(seed)).bitwiseAND((1 << 62) - 1)
    if n > most:
        df = df.where(hashed < int((1 << 62) * min(1.0, (most + 6 * most**0.5) / n)))
    return df.orderBy(hashed, *keys).limit(most)


def collected(rows: DataFrame, most_chars: int, label: str | None = None) -> pd.DataFrame:
    """Rows (text and others) on the driver, in the order of their hash, of at most most_chars of text in all; each label has an equal part of that.

    A row is taken if its text fits in what is left for its label, so a text that is too long leaves out itself only, and where none fits the shortest of the label is
    taken. Texts may be of any length; lengths are looked at first, so that no more than that is ever sent.
    """
    kept = stored(rows.withColumn("_place", F.xxhash64(*rows.columns)), "sample")
    group = F.col(label) if label else F.lit(0)
    sizes = kept.groupBy("_place").agg(F.sum(F.length("text")).alias("n"), F.first(group).alias("group")).toPandas().sort_values("_place")
    taken: list[int] = []
    for _, own in sizes.groupby("group"):
        left, here = most_chars // sizes["group"].nunique(), []
        for place, n in zip(own["_place"].tolist(), own["n"].tolist(), strict=True):
            if n <= left:
                here.append(place)
                left -= n
        taken += here or own.nsmallest(1, "n")["_place"].tolist()
    chosen = rows.sparkSession.createDataFrame([(p,) for p in taken], "_place long")
    return kept.join(F.broadcast(chosen), "_place").toPandas().sort_values("_place").drop(columns="_place")
