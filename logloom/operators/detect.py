"""Rules as data: all rules are evaluated in one pass over the events."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.predicates import Fields, all_of
from logloom.sources.schema import ALIASES, SEVERITIES

DEFAULT_DEDUP = ("host", "uid", "exe", "path", "remote_ip")
PER_ARRAY = 20


@dataclass(frozen=True)
class Threshold:
    """So many hits of one key within so many seconds."""

    count: int
    window_s: float
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """What to look for (when: conditions that must all hold), where, and how to hold back repetition."""

    name: str
    severity: str
    when: Callable[[Fields], list[Column]]
    description: str = ""
    feeds: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    mitre: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    threshold: Threshold | None = None
    throttle_s: float | None = None
    dedup_by: tuple[str, ...] | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}")
        if self.threshold and (self.threshold.count < 1 or self.threshold.window_s <= 0):
            raise ValueError("a threshold needs a count and a window")

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)

    def conditions(self, fields: Fields) -> list[Column]:
        """What must hold, the feeds first; a rule without feeds, or with any of 'any' and '*', looks at every feed."""
        one = [fields.equal("source", self.feeds[0])] if len(self.feeds) == 1 else [fields.is_in("source", list(self.feeds))]
        return [*([] if not self.feeds or {"any", "*"} & set(self.feeds) else one), *self.when(fields)]

    def predicate(self, fields: Fields) -> Column:
        """True where the rule holds."""
        return all_of(self.conditions(fields))


def active(rules: list[Rule], min_severity: str | None = None) -> list[Rule]:
    """Enabled rules of at least a severity; an unknown severity keeps all."""
    least = SEVERITIES.index(min_severity) if min_severity in SEVERITIES else -1
    return [r for r in rules if r.enabled and r.rank >= least]


def matches(events: DataFrame, rules: list[Rule], min_severity: str | None = None) -> DataFrame:
    """The columns of events and rule, a row for each rule that holds on an event. One pass, no shuffle."""
    fields, used = Fields(events.schema), active(rules, min_severity)
    if not used:
        return events.withColumn("rule", F.lit("")).where("false")
    return events.select("*", F.explode(hits_of(used, fields)).alias("rule"))


def hits_of(rules: list[Rule], fields: Fields) -> Column:
    """The names of the rules that hold on an event, in an array.

    Rules are looked at behind gates: those that ask for one value of a field which many rules ask for (a feed, a category, an action) are tried only on events that have it,
    so an event meets its own rules and those without such a condition, and not all.
    """
    conditions = {r.name: r.conditions(fields) for r in rules}
    asked = {name: {x for c in own if (x := fields.text_asked(c))} for name, own in conditions.items()}
    often = Counter(x for own in asked.values() for x in own)
    gates: dict[tuple[str, str] | None, list[str]] = {}
    for name, own in asked.items():
        best = max(own, key=lambda x: (often[x], x), default=None)
        gates.setdefault(best if best and often[best] > 1 else None, []).append(name)

    def flags(names: list[str]) -> list[Column]:
        each = [F.when(all_of(conditions[n]), F.lit(n)) for n in names]
        return [F.array(*each[a : a + PER_ARRAY]) for a in range(0, len(each), PER_ARRAY)]

    nothing = F.array().cast("array<string>")
    arrays = [F.when(fields.equal(*gate), F.concat(*flags(own))).otherwise(nothing) for gate, own in gates.items() if gate] + flags(gates.get(None, []))
    return F.array_compact(F.concat(*arrays))


def with_listed(events: DataFrame, flag: str, field: str, listed: DataFrame, value: str) -> DataFrame:
    """events with flag: whether field is among the values of a table, for rules to test. Null is in no list.

    The list may be of any size: Spark broadcasts it if its size allows, else both sides are shuffled by the value.
    """
    names = listed.select(F.col(value).cast("string").alias("_listed")).where("_listed is not null").distinct().withColumn(flag, F.lit(True))
    joined = events.drop(flag).join(names, F.col(field).cast("string") == F.col("_listed"), "left").drop("_listed")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def listed_only(events: DataFrame, field: str, listed: DataFrame, value: str, negated: bool = False) -> DataFrame:
    """The events whose field is among the values of a table, or, negated, is not; null is in no list."""
    names = listed.select(F.col(value).cast("string").alias("_listed"))
    return events.join(names, F.col(field).cast("string") == F.col("_listed"), "left_anti" if negated else "left_semi")


def key_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """Values joined by bars, with - for null; * if no field is named, so that all rows share the key."""
    if not names:
        return F.lit("*")
    resolved = [n if n in df.columns else ALIASES.get(n, n) for n in names]
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) if n in df.columns else F.lit("-") for n in resolved])


def by_rule(rules: list[Rule], value: Callable[[Rule], object], build: Callable[[object], Column] = F.lit) -> Column:
    """A column that differs by rule: build of the value of each, null for other rules. As many branches as there are different values, side by side."""
    names: dict[object, list[str]] = {}
    for r in rules:
        names.setdefault(value(r), []).append(r.name)
    out = None
    for v, own in names.items():
        is_own = F.col("rule").isin(own)
        out = F.when(is_own, build(v)) if out is None else out.when(is_own, build(v))
    return F.lit(None) if out is None else out
