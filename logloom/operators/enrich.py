"""What an event lacks and an earlier one knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def with_parents(events: DataFrame, slot_s: int = 3600) -> DataFrame:
    """events (host, pid, ppid, ts, seq, exe, comm, action) with parent_exe and parent_name, where unknown, of the latest earlier execve on the same host whose pid is their ppid.

    An as-of join without a range join: programs and what asks for them in one stream in the order of time, and the last program seen. A stream is one process in one
    stretch of slot_s seconds, so a process that lives long, as the first of a host does, is many; what each stretch begins with is found on a table of the
    last programs of stretches. Of programs only what is known moves, rows that ask move once, and rows that do not ask move nowhere.
    """
    for c in ("parent_exe", "parent_name"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    slot = F.floor(F.unix_micros("ts") / (slot_s * 1_000_000)).cast("long").alias("slot")
    starts = F.coalesce((F.col("action") == "execve") & F.col("pid").isNotNull(), F.lit(False))
    asks = F.coalesce(F.col("parent_name").isNull() & F.col("ppid").isNotNull(), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    nobody = F.lit(None).cast("struct<exe:string,comm:string>")
    programs = events.where(starts).select("host", F.col("pid").cast("long").alias("p"), slot, "ts", "seq", F.lit(1).alias("place"), F.struct(F.col("exe").cast("string").alias("exe"), F.col("comm").cast("string").alias("comm")).alias("known"))
    asking = events.where(asks).select("host", F.col("ppid").cast("long").alias("p"), slot, "ts", "seq", F.lit(0).alias("place"), nobody.alias("known"), row.alias("row"))

    stretches = programs.select("host", "p", "slot", "ts", "seq", "known").unionByName(asking.select("host", "p", "slot", "ts", "seq", "known"))
    last = stretches.groupBy("host", "p", "slot").agg(F.max_by("known", F.when(F.col("known").isNotNull(), F.struct("ts", "seq"))).alias("last"))
    before = W.partitionBy("host", "p").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    begun = last.withColumn("known", F.last("last", ignorenulls=True).over(before)).where("known is not null")
    carried = begun.select("host", "p", "slot", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast(events.schema["seq"].dataType).alias("seq"), F.lit(-1).alias("place"), "known")

    # At one time a row that asks comes before a program, as that is no earlier one; what a stretch begins with comes first.
    order = W.partitionBy("host", "p", "slot").orderBy(F.asc_nulls_first("ts"), "seq", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = asking.unionByName(programs, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    found = lines.withColumn("parent", F.last("known", ignorenulls=True).over(order)).where("row is not null").select("row.*", "parent")
    found = found.withColumns({"parent_exe": F.coalesce("parent_exe", "parent.exe"), "parent_name": F.coalesce("parent_name", "parent.comm")}).drop("parent")
    return found.select(*[F.col(f"`{c}`") for c in events.columns]).unionByName(events.where(~asks))
