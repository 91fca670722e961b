"""The journal of verdicts: an append-only table (alert_id, verdict, note, analyst, rule, signature, updated_at, pos), pos being the order of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.operators.alerts import signed
from logloom.sources.schema import lookup

VERDICTS = ("open", "in_progress", "true_positive", "benign_positive", "false_positive", "duplicate")
CLOSED = VERDICTS[2:]
#: Short forms of verdicts.
SHORT = {
    "o": "open", "new": "open", "unreviewed": "open", "w": "in_progress", "wip": "in_progress", "progress": "in_progress", "t": "true_positive", "tp": "true_positive",
    "true": "true_positive", "b": "benign_positive", "bp": "benign_positive", "benign": "benign_positive", "f": "false_positive", "fp": "false_positive",
    "false": "false_positive", "d": "duplicate", "dup": "duplicate",
}
#: What an exclusion may name, most specific first.
CANDIDATES = ("exe", "parent_name", "path", "file_dir", "unit", "service", "remote_ip", "auth_user", "user", "uid", "cwd")
FIELDS = ("verdict", "note", "analyst", "rule", "signature", "updated_at")


def verdict_of(text: Column) -> Column:
    """The verdict that a text names, in any case and with blanks or hyphens, or short; null if none."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[- ]", "_")
    return F.when(t.isin(*VERDICTS), t).otherwise(lookup(t, SHORT))


def read_journal(lines: DataFrame) -> DataFrame:
    """Journal rows of JSON lines (value, pos); lines that are no JSON, or without an alert, are skipped."""
    fields = "alert_id string, verdict string, note string, analyst string, rule string, signature string, updated_at string"
    return lines.select(F.from_json("value", fields).alias("r"), "pos").select("r.*", "pos").where(F.coalesce(F.col("alert_id"), F.lit("")) != "")


def latest(journal: DataFrame) -> DataFrame:
    """The last line of each alert, and first_pos, that of its first. Partial aggregation: no group is gathered."""
    row = journal.groupBy("alert_id").agg(F.max_by(F.struct(*FIELDS, "pos"), "pos").alias("r"), F.min("pos").alias("first_pos"))
    return row.select("alert_id", "r.*", "first_pos")


def history(journal: DataFrame) -> DataFrame:
    """(alert_id, pos, verdict, updated_at, revision): all lines but each alert's last, numbered from 1, oldest first."""
    order = W.partitionBy("alert_id").orderBy("pos")
    numbered = journal.withColumns({"revision": F.row_number().over(order), "next": F.lead("pos").over(order)})
    return numbered.where("next is not null").select("alert_id", "pos", "verdict", "updated_at", "revision")


def signature_index(newest: DataFrame) -> DataFrame:
    """(signature, verdict, alert_id) of signatures whose newest record (by time, then by the alert's first line) is closed."""
    own = newest.where(F.coalesce(F.col("signature"), F.lit("")) != "")
    last = own.groupBy("signature").agg(F.max_by(F.struct("verdict", "alert_id"), F.struct("updated_at", "first_pos")).alias("r"))
    return last.select("signature", "r.verdict", "r.alert_id").where(F.col("verdict").isin(*CLOSED))


def known_signatures(newest: DataFrame, chosen: tuple[str, ...] = CLOSED) -> DataFrame:
    """(signature, verdict, alert_id) of the signatures that have one of the chosen verdicts."""
    return signature_index(newest).where(F.col("verdict").isin(*chosen))


def newest_first(newest: DataFrame) -> DataFrame:
    """The last record of every alert, the newest time first; of one time by alert."""
    return newest.orderBy(F.desc("updated_at"), "alert_id")


def effective(alerts: DataFrame, newest: DataFrame) -> DataFrame:
    """alerts with effective_verdict and inherited: the alert's own record, even an open one, else that of its signature, else open."""
    own = newest.select("alert_id", F.col("verdict").alias("_own"))
    index = signature_index(newest).select("signature", F.col("verdict").alias("_known"))
    joined = signed(alerts).join(own, "alert_id", "left").join(index, "signature", "left")
    return joined.withColumns({"effective_verdict": F.coalesce("_own", "_known", F.lit("open")), "inherited": F.col("_own").isNull() & F.col("_known").isNotNull()}).drop("_own", "_known")


def annotate(alerts: DataFrame, newest: DataFrame, drop_false_positives: bool = False) -> DataFrame:
    """alerts with prior_verdict, that of their signature; repeats of false positives are dropped on request."""
    out = signed(alerts).join(signature_index(newest).select("signature", F.col("verdict").alias("prior_verdict")), "signature", "left")
    return out.where(F.coalesce(F.col("prior_verdict") != "false_positive", F.lit(True))) if drop_false_positives else out


def records(new: DataFrame, newest: DataFrame, updated_at: Column) -> DataFrame:
    """Journal rows for new (alert_id, verdict, note, analyst, rule, signature): empty rule and signature are those of the last record; unknown verdicts are left out."""
    old = newest.select("alert_id", F.col("rule").alias("_rule"), F.col("signature").alias("_signature"))
    valid = new.withColumn("verdict", verdict_of(F.col("verdict"))).where("verdict is not null").join(old, "alert_id", "left")
    filled = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.col(f"_{n}"), F.lit("")).alias(n)
    return valid.select("alert_id", "verdict", "note", "analyst", filled("rule"), filled("signature"), updated_at.alias("updated_at"))


def in_scope(alerts: DataFrame, newest: DataFrame, chosen: DataFrame, scope: str) -> DataFrame:
    """alerts that a verdict on the chosen (alert_id) covers: themselves, and those of the same scope (signature or rule) whose own verdict is not closed."""
    alerts = signed(alerts)
    keys = alerts.join(chosen, "alert_id", "left_semi").where(F.coalesce(F.col(scope), F.lit("")) != "").select(scope).distinct()
    closed = newest.where(F.col("verdict").isin(*CLOSED)).select("alert_id")
    themselves = alerts.join(chosen, "alert_id", "left_semi")
    return alerts.join(keys, scope, "left_semi").select(*alerts.columns).join(closed, "alert_id", "left_anti").select(*alerts.columns).unionByName(themselves).dropDuplicates(["alert_id"])


def verdict_counts(newest: DataFrame) -> DataFrame:
    """(verdict, n) of all six verdicts, those without a record too."""
    listed = newest.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return listed.join(newest.groupBy("verdict").count(), "verdict", "left").select("verdict", F.coalesce("count", F.lit(0)).alias("n"))


def rule_tallies(newest: DataFrame) -> DataFrame:
    """(rule, a column for each verdict); records without a rule are skipped."""
    return newest.where(F.coalesce(F.col("rule"), F.lit("")) != "").groupBy("rule").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def precision(newest: DataFrame, alerts: DataFrame, most: int = 12) -> DataFrame:
    """(rule, fired, true_positive, benign_positive, false_positive, precision) of judged rules, the least precise first."""
    tallies = rule_tallies(newest).where("true_positive + benign_positive + false_positive > 0")
    fired = alerts.groupBy("rule").agg(F.count("*").alias("fired"))
    right = F.col("true_positive") + F.col("benign_positive")
    out = tallies.join(fired, "rule", "left").select("rule", F.coalesce("fired", F.lit(0)).alias("fired"), "true_positive", "benign_positive", "false_positive", (right / (right + F.col("false_positive"))).alias("precision"))
    return out.orderBy("precision", "rule").limit(most)


def exclusions(alerts: DataFrame, newest: DataFrame) -> DataFrame:
    """(rule, field, value, n): what would exclude alerts judged false (first four of their fields) or benign (first one)."""
    judged = alerts.join(newest.where(F.col("verdict").isin("false_positive", "benign_positive")).select("alert_id", "verdict"), "alert_id")
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in CANDIDATES if c in alerts.columns]
    full = F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    top = F.slice(full, 1, F.when(F.col("verdict") == "false_positive", 4).otherwise(1))
    return judged.select("rule", F.explode(top).alias("p")).groupBy("rule", "p.field", "p.value").agg(F.count("*").alias("n"))


def export(alerts: DataFrame, newest: DataFrame) -> DataFrame:
    """Alerts with their own record as triage, null if there is none; nothing is inherited."""
    own = newest.select("alert_id", F.struct(*FIELDS).alias("triage"))
    return alerts.join(own, "alert_id", "left")
