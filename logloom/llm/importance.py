"""Operator 11: importance resampling towards a target distribution, in built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import stored

#: What separates words: all of ASCII but digits, letters and the space itself.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")


def words_of(text: Column) -> Column:
    """Runs of digits, small letters and all that is not ASCII, A-Z alone being made small; a null text has none.

    Each other sign of ASCII becomes a space, so that texts are cut at one sign, which takes a third of the time of a pattern.
    """
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase + BETWEEN, string.ascii_lowercase + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def grams_of(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, each joined by single spaces, repeats kept."""
    runs = [words]
    for k in range(2, longest + 1):
        n = F.greatest(F.size(words) - (k - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], 1, n), F.slice(words, k, n), lambda run, word: F.concat(run, F.lit(" "), word)))
    return F.concat(*runs)


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def hashed(docs: DataFrame, longest: int, buckets: int, id_col: str | Column, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, grams) of each row: the buckets of its n-grams, row being a number of its own. Texts are read and hashed here only."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    grams = F.transform(grams_of(F.col("words"), longest), lambda gram: bucket_of(gram, buckets))
    return words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), grams.alias("grams"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: the floored thousandfold logarithm of the target's smoothed share over that of docs, counted over all grams of both."""
    counted = lambda df, name: df.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = stored(every.join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]), "counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda value: value.cast("double")
    share = d(F.col("t") + 1) * float(total["s"] + buckets) / (d(F.col("s") + 1) * float(total["t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def with_scores(docs: DataFrame, gains: DataFrame, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of each row of what ``hashed`` gives."""
    each = ["row", "doc_id", "n_words", "n_features"]
    gained = docs.select("row", "doc_id", "n_words", F.size("grams").cast("long").alias("n_features"), F.explode_outer("grams").alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = gained.groupBy(*each).agg(F.sum("gain").alias("total"))
    n, total = F.greatest(F.col("n_features"), F.lit(1)), F.coalesce(F.col("total"), F.lit(0))
    weight = F.call_function("div", total - F.pmod(total, n), n)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return summed.select("doc_id", "n_features", "n_words", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place, from 1, in a total order: one distributed sort, then each partition adds the sizes of those before it."""
    ordered = stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return ordered.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + inside + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs: the rows drawn without replacement towards the words of target have a rank, others null.

    A row's features are its runs of up to longest words; weight is their floored mean gain; score adds noise of a Gumbel distribution that seed and id give. Of the n rows
    that have least_words, percent * n div 100 with the highest scores are drawn, equal ones by the smaller id, null last.

    All counts are over whole tables. Texts are cut and hashed once, and the buckets of their features written in the order of the table. What moves then is a count for each task and
    bucket, and a sum for each document, made where its features are, so neither long texts nor frequent words meet in one task. The broadcast table has buckets rows.
    A null or empty text has no features, weight 0 and is never drawn. A null id has the noise of an empty one. Rows that repeat are ranked each.
    An empty target counts as one without features, and an empty table gives no rows.
    """
    own = stored(hashed(docs, longest, buckets, id_col, text_col), "grams")
    gains = gain_table(own, hashed(target, longest, buckets, F.lit(None), target_text_col), buckets)
    scored = with_scores(own, gains, seed).withColumn("able", F.col("n_words") >= least_words)
    placed = ranked(scored, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")])
    able = placed.agg(F.count_if("able").alias("n")).first()["n"]
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= percent * able // 100, F.col("place")).alias("rank"))
