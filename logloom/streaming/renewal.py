"""Streams of rules with thresholds and throttles whose rules change while events come."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.predicates import Fields
from logloom.operators import alerts
from logloom.operators.detect import DEFAULT_DEDUP, Rule, active, by_rule, matches
from logloom.streaming.sinks import write_alerts
from logloom.streaming.suppression import passing_stream

#: Between the name of a rule and its fingerprint.
MARK = "\x1f"
_VARIABLE = re.compile(r"(\b[xyz]_\d+\b)")


def fingerprint(rule: Rule, schema: T.StructType, default_throttle_s: float | None = None) -> str:
    """A digest of what a rule's state depends on: its conditions on events of a schema, its threshold, its throttle and the keys of both. Name, severity and texts are not part of it."""
    # Spark numbers the variables of functions over arrays anew each time: what differs between two readings is such a number.
    once, again = ([_VARIABLE.split(str(c)) for c in rule.conditions(Fields(schema))] for _ in range(2))
    told = ["".join(x if x == y else x[0] for x, y in zip(a, b, strict=True)) for a, b in zip(once, again, strict=True)]
    limits = [repr(rule.threshold), repr(default_throttle_s if rule.throttle_s is None else rule.throttle_s), repr(tuple(rule.dedup_by or DEFAULT_DEDUP))]
    return md5(MARK.join([*told, *limits]).encode()).hexdigest()[:16]


def fingerprints(rules: list[Rule], schema: T.StructType, min_severity: str | None = None, default_throttle_s: float | None = None) -> dict[str, str]:
    """The fingerprint of each rule that is in use, by its name."""
    return {r.name: fingerprint(r, schema, default_throttle_s) for r in active(rules, min_severity)}


def rules_stream(events: DataFrame, rules: list[Rule], min_severity: str | None = None, default_throttle_s: float | None = None, delay: str = "10 minutes") -> DataFrame:
    """(rule, ts_us, seq, match_count, members): the hits of a stream of events (canonical columns with ts and seq) that become alerts, as ``suppression.passing_stream`` gives them.

    State is kept by the name and the fingerprint of a rule, and the steps with state are the same for every list of rules. So the stream may stop and go on from its checkpoint with other rules: one that
    has not changed goes on with what it has counted, one that has changed starts anew, and what is kept of a rule that is gone is cleared as its window passes.
    What an old rule has counted may still fire at times before the change, as rows wait for the watermark. That is delay behind the latest of all events, also of those that no rule matches.
    """
    events = events.withWatermark("ts", delay)
    used, marks = active(rules, min_severity), fingerprints(rules, events.schema, min_severity, default_throttle_s)
    hits = matches(events, rules, min_severity)
    name = by_rule(used, lambda r: f"{r.name}{MARK}{marks[r.name]}").cast("string")
    own = hits.select(name.alias("rule"), "ts", "seq", *[c.alias(n) for n, c in alerts.keyed(hits, used, default_throttle_s).items()])
    return passing_stream(own, None).withColumn("rule", F.substring_index("rule", MARK, 1))


def follow_rules(events: Callable[[], DataFrame], rules: Callable[[], list[Rule]], folder: str, checkpoint: str, every_s: float = 10.0, until: Callable[[], bool] = lambda: False, delay: str = "10 minutes", **trigger: object) -> int:
    """Runs ``rules_stream`` into a folder, and reads the rules anew every so many seconds: when one that is in use has changed, come or gone, the stream stops and goes on from its checkpoint with the new ones.

    Ends when the stream ends (as it does where it is to take what is there, the default), or when until holds. Gives how many times it has started. A micro-batch that a stop interrupts runs again, under the new rules.
    """
    starts = 0
    while True:
        now, stream = rules(), events()
        schema = stream.schema
        known = fingerprints(now, schema)
        query = write_alerts(rules_stream(stream, now, delay=delay), folder, checkpoint, **trigger)
        starts += 1
        changed = False
        while not changed:
            if query.awaitTermination(every_s):
                return starts
            ended, changed = until(), fingerprints(rules(), schema) != known
            if ended or changed:
                query.stop()
            if ended:
                return starts
