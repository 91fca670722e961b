"""Queries over alerts: filters, queues and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.verdicts import CLOSED, VERDICTS
from logloom.sources.schema import severity_rank


def at_least(severity: Column, least: str) -> Column:
    """A severity of at least least; none counts as info."""
    return severity_rank(F.coalesce(severity, F.lit("info"))) >= severity_rank(F.lit(least))


def with_status(alerts: DataFrame, status: str) -> DataFrame:
    """alerts (with effective_verdict, inherited) of a status: open (not closed), inherited, or one verdict; none of any other."""
    closed = F.col("effective_verdict").isin(*CLOSED)
    if status == "open":
        return alerts.where(~closed)
    if status == "inherited":
        return alerts.where("inherited")
    return alerts.where(F.col("effective_verdict") == status if status in VERDICTS else F.lit(False))


def grep(alerts: DataFrame, text: str) -> DataFrame:
    """alerts with a text anywhere in their JSON form, in any case."""
    return alerts.where(F.lower(F.to_json(F.struct("*"))).contains(text.lower()))


def rule_contains(alerts: DataFrame, text: str) -> DataFrame:
    return alerts.where(F.lower("rule").contains(text.lower()))


def with_tag(alerts: DataFrame, tag: str) -> DataFrame:
    """alerts whose rule has a tag, exactly so; tags are a column or a field of rule."""
    tags = F.col("tags") if "tags" in alerts.columns else F.col("rule.tags")
    return alerts.where(F.coalesce(F.array_contains(tags, tag), F.lit(False)))


def of_host(alerts: DataFrame, host: str) -> DataFrame:
    return alerts.where(F.col("host") == host)


def newest(alerts: DataFrame, n: int) -> DataFrame:
    """The last n, newest first; only n rows of each partition are moved."""
    return alerts.orderBy(F.desc("alert_id")).limit(n)


def find(alerts: DataFrame, text: str) -> DataFrame:
    """Up to two alerts whose id is, begins or ends with a text, so that the caller sees whether it names one."""
    a, t = F.upper("alert_id"), text.upper()
    return alerts.where(a.startswith(t) | a.endswith(t)).orderBy("alert_id").limit(2)


def by_severity(alerts: DataFrame) -> DataFrame:
    """(severity, n), highest first."""
    return alerts.groupBy("severity").agg(F.count("*").alias("n")).orderBy(F.desc(severity_rank(F.col("severity"))))


def top_rules(alerts: DataFrame, k: int = 10) -> DataFrame:
    """(rule, n) of the k rules that fired most; ties by name."""
    return alerts.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(k)


def totals(alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """(alerts, open, open_urgent, untriaged) by own verdicts alone."""
    own = alerts.join(latest.select("alert_id", F.col("verdict").alias("own")), "alert_id", "left")
    is_open = ~F.coalesce(F.col("own").isin(*CLOSED), F.lit(False))
    return own.agg(F.count("*").alias("alerts"), F.count_if(is_open).alias("open"), F.count_if(is_open & at_least(F.col("severity"), "high")).alias("open_urgent"), F.count_if(F.col("own").isNull()).alias("untriaged"))


def open_queue(alerts: DataFrame, least: str, n: int) -> DataFrame:
    """The newest n that are not closed and of at least a severity."""
    return newest(with_status(alerts, "open").where(at_least(F.col("severity"), least)), n)
