"""Feeds that a description makes: lines of one pattern or of JSON objects, as canonical events."""

from __future__ import annotations

import os
import re
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import stored
from logloom.sources.schema import EVENT, line_key, sortable_key, union_feeds

#: Up to so many splits (some 50 MB) their table is broadcast; beyond, Spark chooses the join.
MOST_SPLITS = 1_000_000

_CASTS = {"int": "bigint", "float": "double", "str": "string"}
#: Patterns of times; those without an offset get one, and the one without a year gets that.
_TIMES = ("yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss|", "dd/MMM/yyyy:HH:mm:ss Z", "|MMM d HH:mm:ss|", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


@dataclass(frozen=True)
class FeedSpec:
    """How to read a kind of line. Group names of a pattern are column names; field_map renames them, or drops those it maps to an empty name."""

    name: str
    paths: tuple[str, ...] = ()
    format: str = "regex"
    pattern: str = ""
    json_fields: tuple[str, ...] = ()
    field_map: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    static: dict[str, object] = field(default_factory=dict)
    timestamp_field: str = ""
    category: str = "log"
    action: str | None = None
    message_field: str = "message"
    enabled: bool = True


def groups_of(pattern: str) -> tuple[str, list[str]]:
    """A pattern with plain groups in place of named ones, and the name of each group by its number; unnamed ones have an empty name."""
    compiled = re.compile(pattern)
    names = {i: n for n, i in compiled.groupindex.items()}
    return re.sub(r"\(\?P<\w+>", "(", pattern), [names.get(i, "") for i in range(1, compiled.groups + 1)]


def parse_time(text: Column, year: Column) -> Column:
    """Epoch seconds of a time in one of the known forms, UTC where it says none, or of a plain number; one without a year is of the given year."""
    def attempt(pattern: str) -> Column:
        t = F.regexp_replace(F.trim(text), " +", " ")
        if pattern.startswith("|"):
            t, pattern = F.concat(year.cast("string"), F.lit(" "), t), "yyyy " + pattern[1:]
        if pattern.endswith("|"):
            t, pattern = F.concat(t, F.lit(" +0000")), pattern[:-1] + " Z"
        return F.try_to_timestamp(t, F.lit(pattern))

    tries = [attempt(p) for p in _TIMES]
    seconds = [F.unix_micros(t) / 1_000_000 for t in tries]
    return F.coalesce(*seconds, F.trim(text).try_cast("double"))


def read_events(lines: DataFrame, spec: FeedSpec, now: float) -> DataFrame:
    """Canonical columns of the lines (value, pos) that fit; now, in epoch seconds, is the time of those without one, so that a batch can be read again."""
    line = F.trim("value")
    if spec.format == "json":
        own = lines.select(line.alias("raw"), "pos", line_key(spec.name, lines).alias("seq")).withColumn("j", F.from_json("raw", "map<string,string>")).where(F.col("raw").startswith("{") & F.col("j").isNotNull())
        values = {n: F.col("j")[n] for n in spec.json_fields}
    else:
        plain, names = groups_of(spec.pattern)
        own = lines.select(line.alias("raw"), "pos", line_key(spec.name, lines).alias("seq")).where((F.col("raw") != "") & F.col("raw").rlike(plain))
        values = {n: F.nullif(F.regexp_extract("raw", plain, i), F.lit("")) for i, n in enumerate(names, 1) if n}
    made: dict[str, Column] = {"source": F.lit(spec.name), "category": F.lit(spec.category), "raw": F.col("raw"), "action": F.lit(spec.action)}
    made |= {n: F.lit(v) for n, v in spec.static.items()}
    for name, value in values.items():
        target = spec.field_map.get(name, name)
        if target:
            kind = spec.types.get(target) or spec.types.get(name)
            if kind == "bool":
                value = F.lower(F.trim(value)).isin("1", "true", "yes", "on")
            elif kind in _CASTS:
                value = F.trim(value).try_cast(_CASTS[kind])
            made[target] = F.coalesce(value, made[target]) if target in made else value
    when = parse_time(values[spec.timestamp_field], F.year(F.timestamp_seconds(F.lit(now)))) if spec.timestamp_field in values else F.lit(None).cast("double")
    made["epoch"] = F.coalesce(when, F.lit(float(now)))
    told = made[spec.message_field].cast("string") if spec.message_field in made else F.lit(None).cast("string")
    made["message"] = F.coalesce(made.get("message", F.lit(None).cast("string")), told, F.substring("raw", 1, 400))
    made["message_snippet"] = F.coalesce(F.substring(told, 1, 200), F.substring("raw", 1, 200))
    known = set(EVENT.names) - {"seq"}
    extra = [x for n, v in made.items() if n not in known for x in (F.lit(n), v.cast("string"))]
    out = own.select("pos", "seq", *[v.alias(n) for n, v in made.items() if n in known], (F.map_filter(F.create_map(*extra), lambda _, v: v.isNotNull()) if extra else F.lit(None).cast("map<string,string>")).alias("extra"))
    return out.withColumn("ts", F.timestamp_micros(F.round(F.col("epoch") * 1_000_000).cast("long")))


@dataclass
class Feeds:
    """Feeds by name; each reads its canonical events from paths."""

    readers: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, reader: Callable[[SparkSession, list[str]], DataFrame], replace: bool = False) -> None:
        if name in self.readers and not replace:
            raise ValueError(f"feed {name!r} is registered already")
        self.readers[name] = reader

    def unknown(self, names: list[str]) -> list[str]:
        """Of the feeds that rules name, those that are not here."""
        return sorted(set(names) - set(self.readers) - {"any", "*"})

    def read(self, spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
        """All feeds that have paths, one after the other; paths may hold globs."""
        return union_feeds([self.readers[n](spark, p) for n, p in paths.items() if p])


def numbered_lines(spark: SparkSession, paths: list[str], feed: str) -> DataFrame:
    """(value, path, pos, seq) of text files (folders or globs): path is the file's name below the folder that all paths have in common (a folder's own path ends with /), pos orders all lines, older files first, and
    seq is a key of 128 bits that a line has for ever: from its feed, its file's path and its number in it.

    Keys are the same however the files are split, read or copied with their names. To number lines without moving them, those of each split are counted first; a
    split is a row of some 50 bytes, so the table of them is small beside the text (20 MB for 100 TB in splits of 256 MB), and the lines are read once more for what follows.
    """
    common = os.path.commonprefix([re.split(r"[*?\[{]", p)[0] for p in paths])
    root = urllib.parse.quote(re.sub(r"^\w+:/*(?=/)", "", common[: common.rfind("/") + 1]), safe="/:=+,;@!$&'()~-._")
    uri = F.col("_metadata.file_path")
    name = F.when(uri.contains(root), F.substr(uri, F.instr(uri, root) + F.lit(len(root)))).otherwise(uri)
    lines = spark.read.text(paths).select("value", name.alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.unix_micros("_metadata.file_modification_time").alias("time"), F.monotonically_increasing_id().alias("id"))
    splits = stored(lines.groupBy("path", "begin").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("time").alias("time")), "splits")
    files = splits.groupBy("path").agg(F.max("time").alias("time")).select("path", F.row_number().over(W.orderBy("time", "path")).alias("file"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("begin")) - F.col("n")
    digest = F.md5(F.concat(F.lit(f"{feed}\x1f"), F.col("path")))
    starts = splits.withColumn("before", before).join(files, "path").select("path", "begin", (F.col("before") - F.col("first")).alias("shift"), "file", digest.alias("digest"))
    number = F.col("id") + F.col("shift")
    own = lines.join(F.broadcast(starts) if splits.count() <= MOST_SPLITS else starts, ["path", "begin"])
    return own.select("value", "path", (F.shiftleft(F.col("file").cast("long"), 40) + number).alias("pos"), sortable_key(number, F.col("digest")).alias("seq"))


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, path, pos) of text files; pos orders the lines of a file."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"))
