import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import checkpoints
from logloom.operators import alerts, reports, verdicts
from logloom.operators.detect import Rule, Threshold, listed_only, matches, with_listed
from logloom.operators.enrich import with_parents


def signatures(spark, *rows):
    df = spark.createDataFrame(rows, "host string, path string, cmdline string, uid long, remote_ip string")
    return [r[0] for r in df.select(alerts.signature(F.lit("r"), {c: F.col(c) for c in df.columns})).collect()]


def test_noise_is_folded_and_identity_is_not(spark):
    base = ("h", None, None, None, None)
    at = lambda i, v: tuple(v if k == i else x for k, x in enumerate(base))
    same = [(at(1, "/tmp/job-12345/run.sh"), at(1, "/tmp/job-98765/run.sh")), (at(1, "/proc/11/environ"), at(1, "/proc/22/environ")), (at(1, "/var/tmp/a.tmpXY"), at(1, "/var/tmp/tmp_q")), (at(2, "x deadbeefdeadbeef"), at(2, "x  cafecafecafe00")), (at(2, "n 1234567"), at(2, "n 7654321")), (at(1, ""), base)]
    other = [(at(4, "192.0.2.1"), at(4, "192.0.2.2")), (at(2, "tool 4444"), at(2, "tool 5555")), (at(3, 0), base)]
    for a, b in same:
        x, y = signatures(spark, a, b)
        assert x == y
    for a, b in other:
        x, y = signatures(spark, a, b)
        assert x != y and re.fullmatch("[0-9a-f]{16}", x)


def test_ids_sort_by_time(spark):
    df = spark.createDataFrame([(m, f"r{m}") for m in (1, 999, 1_700_000_000_000, 1_700_000_000_001)], "ms long, name string")
    ids = [r[0] for r in df.select(alerts.alert_id(F.col("ms"), F.col("name"))).collect()]
    assert ids == sorted(ids) and all(re.fullmatch("[0-9A-HJKMNP-TV-Z]{26}", i) for i in ids)


RULES = [
    Rule("three", "high", lambda f: [f.equal("action", "x")], threshold=Threshold(3, 10, ("host",)), throttle_s=100, dedup_by=("host",)),
    Rule("plain", "low", lambda f: [f.equal("host", "b")], feeds=("auditd",)),
]


def test_alerts_have_what_made_them_fire(spark):
    rows = [("a", "x", t, i) for i, t in enumerate((0, 5, 10, 20, 21, 22, 200, 201, 202))] + [("b", "y", 1, 20), (None, "x", 3, 30)]
    df = spark.createDataFrame(rows, "host string, action string, s long, seq long").select("host", "action", F.timestamp_seconds("s").alias("ts"), "seq", F.lit("auditd").alias("source"))
    got = {(r["rule"]["name"], r.seq): r for r in alerts.build(df, RULES).collect()}
    assert set(got) == {("three", 2), ("three", 8), ("plain", 20)}  # that at 22 s is throttled, its hits are used up
    assert got["three", 2].match_count == 3 and [e.ts.second for e in got["three", 2].correlated_events] == [0, 5, 10]
    assert got["plain", 20].correlated_events is None and got["plain", 20].severity == "low"
    assert alerts.build(df.where("false"), RULES).count() == 0
    with pytest.raises(ValueError):
        Rule("x", "urgent", lambda f: [])


def test_parents(spark):
    rows = [("h", 1, 0, 1, "execve", "/p1", "one"), ("h", 1, 0, 5, "execve", "/p2", "two"), ("h", 9, 1, 3, "other", "x", "x"), ("h", 9, 1, 7, "other", "x", "x"), ("g", 9, 1, 7, "other", "x", "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "host string, pid long, ppid long, s long, action string, exe string, comm string, seq long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.seq: r.parent_name for r in with_parents(df).where("action = 'other'").collect()} == {2: "one", 3: "two", 4: None}


JOURNAL = [
    ("a", "wip", "", "", "r1", "s1", "2024-01-05"), ("a", "true_positive", "", "", "r1", "s1", "2024-01-01"), ("b", "false_positive", "", "", "r1", "s2", "2024-01-02"),
    ("b", "open", "", "", "r1", "s2", "2024-01-03"), ("c", "benign_positive", "", "", "r2", "s3", "2024-01-02"), ("d", "false_positive", "", "", "", "", "2024-01-09"),
]


def test_journal_order_and_inheritance(spark):
    journal = spark.createDataFrame([(*r, i) for i, r in enumerate(JOURNAL)], "alert_id string, verdict string, note string, analyst string, rule string, signature string, updated_at string, pos long")
    latest = verdicts.latest(journal)
    assert {r.alert_id: r.verdict for r in latest.collect()} == {"a": "true_positive", "b": "open", "c": "benign_positive", "d": "false_positive"}
    assert {r.signature: r.verdict for r in verdicts.signature_index(latest).collect()} == {"s1": "true_positive", "s3": "benign_positive"}
    own = spark.createDataFrame([("a", "s1", "r1", "low"), ("b", "s2", "r1", "high"), ("x", "s3", "r2", "critical"), ("y", None, "r2", None)], "alert_id string, signature string, rule string, severity string")
    effective = verdicts.effective(own, latest)
    assert {r.alert_id: (r.effective_verdict, r.inherited) for r in effective.collect()} == {"a": ("true_positive", False), "b": ("open", False), "x": ("benign_positive", True), "y": ("open", False)}
    assert [r.alert_id for r in reports.open_queue(effective, "info", 9).collect()] == ["y", "b"]
    assert reports.with_status(effective, "nonsense").count() == 0
    new = spark.createDataFrame([("a", "FP", "", "", "", ""), ("zz", "what", "", "", "", "")], "alert_id string, verdict string, note string, analyst string, rule string, signature string")
    assert [(r.verdict, r.rule, r.signature) for r in verdicts.records(new, latest, F.lit("now")).collect()] == [("false_positive", "r1", "s1")]
    lines = spark.createDataFrame([('{"alert_id": "q", "verdict": "open"}', 0), ("{bad", 1), ('{"alert_id": ""}', 2)], "value string, pos long")
    assert [r.alert_id for r in verdicts.read_journal(lines).collect()] == ["q"]


def test_events_are_read_once_and_stay_where_they_are(spark, tmp_path):
    """Alerts are made of what was written with the hits: their plan has no scan of events, and so no exchange of them."""
    rows = [("a", "x", t, t) for t in range(30)]
    df = spark.createDataFrame(rows, "host string, action string, s long, seq long").select("host", "action", F.timestamp_seconds("s").alias("ts"), "seq", F.lit("auditd").alias("source"))
    df.write.parquet(str(tmp_path / "events"))
    made = alerts.build(spark.read.parquet(str(tmp_path / "events")), RULES)
    assert not any("/events/" in f for f in made.inputFiles()) and made.count() == 1


def test_parents_by_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        host, pid, ppid, s = r.choice(["a", "b", None]), r.choice([1, 2, 3, None]), r.choice([1, 2, 3, None]), r.choice([None, *range(40)])
        rows.append((host, pid, ppid, s, r.choice(["execve", "other", None]), f"/p{i}", r.choice([f"c{i}", None]), r.choice([None, None, "had"]), i))
    df = spark.createDataFrame(rows, "host string, pid long, ppid long, s long, action string, exe string, comm string, parent_name string, seq long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.seq: (x.parent_exe, x.parent_name) for x in with_parents(df, slot_s=7).collect()}
    order = lambda x: (x[3] is not None, x[3] or 0, x[8])
    for x in rows:
        want = (None, x[7])
        if x[7] is None and x[2] is not None:
            before = [y for y in rows if y[0] == x[0] and y[1] == x[2] and y[4] == "execve" and order(y) < order(x)]
            if before:
                last = max(before, key=order)
                want = (last[5], last[6])
        assert got[x[8]] == want, x
    assert len(got) == len(rows)


def test_signatures_are_made_where_they_are_missing(spark):
    df = spark.createDataFrame([("a", "r", "h", "kept"), ("b", "r", "h", ""), ("c", "r", "h", None), ("d", None, None, None)], "alert_id string, rule string, host string, signature string")
    got = {x.alert_id: x.signature for x in alerts.signed(df).collect()}
    assert got["a"] == "kept" and got["b"] == got["c"] != got["d"] and re.fullmatch("[0-9a-f]{16}", got["b"])
    nested = df.select("alert_id", F.struct(F.col("rule").alias("name")).alias("rule"), F.struct("host").alias("event"))
    assert {x.alert_id: x.signature for x in alerts.signed(nested).collect()}["b"] == got["b"]
    newest = spark.createDataFrame([("x", "false_positive", "", "", "r", got["b"], "2024", 0, 0)], "alert_id string, verdict string, note string, analyst string, rule string, signature string, updated_at string, pos long, first_pos long")
    assert {x.alert_id: x.inherited for x in verdicts.effective(df, newest).collect()} == {"a": False, "b": True, "c": True, "d": False}
    counts = {x.metric: x.n for x in alerts.run_counts(df, verdicts.annotate(df, newest).withColumn("severity", F.lit("low")), drop_false_positives=True).collect()}
    assert counts == {"matches": 4, "alerts": 2, "suppressed": 0, "sev_low": 2, "known": 2, "known_false_positive": 2, "known_dropped": 2}


def test_lists_that_are_tables(spark):
    e = spark.createDataFrame([("a",), ("b",), (None,)], "who string")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert {x.who: x.seen for x in with_listed(e, "seen", "who", listed, "name").collect()} == {"a": True, "b": False, None: False}
    assert [x.who for x in listed_only(e, "who", listed, "name").collect()] == ["a"]
    assert {x.who for x in listed_only(e, "who", listed, "name", negated=True).collect()} == {"b", None}


def test_events_of_one_name_are_refused(spark):
    """Two feeds that number their events alike can't be told apart; keys of lines can."""
    rules = [Rule("r", "high", lambda f: [f.present("host")], threshold=Threshold(1, 5, ("host",)))]
    one = spark.createDataFrame([("a", 1, "00a"), ("b", 2, "00b")], "host string, seq long, key string").withColumn("ts", F.timestamp_seconds("seq"))
    with pytest.raises(ValueError, match="name an event"):
        alerts.build(one.drop("key").unionAll(one.drop("key")), rules)
    with pytest.raises(ValueError, match="name an event"):
        alerts.build(one.drop("key").withColumn("seq", F.lit(None).cast("long")), rules)
    named = one.withColumn("seq", F.col("key")).drop("key").unionAll(one.withColumn("seq", F.concat("key", F.lit("other"))).drop("key"))
    made = alerts.build(named, rules).collect()
    assert len(made) == 4 and len({r.alert_id for r in made}) == 4


def test_many_rules_in_one_pass(spark):
    """Rules by the hundred, most behind a gate of one category: the same hits and alerts as one by one, and columns that don't grow deep."""
    r = random.Random(1)
    kinds = ["file", "process", "network"]
    rows = [(i, r.choice([*kinds, None, "other"]), r.choice(["auditd", "journald"]), f"/p/{r.randrange(40)}", r.randrange(5), f"h{r.randrange(3)}") for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, category string, source string, path string, k long, host string").withColumn("ts", F.timestamp_seconds("seq"))

    def rule(i):
        asks = [lambda f: [f.equal("category", kinds[i % 3]), f.contains("path", f"/{i % 40}")], lambda f: [f.equal("path", f"/p/{i % 40}")], lambda f: [f.equal("k", i % 5), f.not_equal("category", "file")], lambda f: [f.equal("host", f"h{i % 3}"), f.equal("category", kinds[i % 3])]][i % 4]
        return Rule(f"r{i}", "high", asks, feeds=("auditd",) if i % 5 == 0 else (), threshold=Threshold(1 + i % 3, 5.0 * (1 + i % 7), ("host",) if i % 2 else ()) if i % 4 == 0 else None, throttle_s=float(i % 9 + 1) if i % 3 == 0 else None, dedup_by=("host",) if i % 6 else None)

    rules = [rule(i) for i in range(300)]
    holds = [
        lambda i, c, p, k, h: c == kinds[i % 3] and f"/{i % 40}" in p, lambda i, c, p, k, h: p == f"/p/{i % 40}", lambda i, c, p, k, h: k == i % 5 and c is not None and c != "file", lambda i, c, p, k, h: h == f"h{i % 3}" and c == kinds[i % 3],
    ]
    want = {(f"r{i}", s) for i in range(300) for s, c, source, p, k, h in rows if holds[i % 4](i, c, p, k, h) and (i % 5 or source == "auditd")}
    assert {(x.rule, x.seq) for x in matches(df, rules).select("rule", "seq").collect()} == want
    made, hits = alerts.build_with_hits(df, rules)
    assert hits.count() == len(want) and 0 < made.count() < len(want)


def test_a_run_folder_is_emptied(spark):
    df = spark.range(100)
    with checkpoints.run_folder(spark) as folder:
        kept = checkpoints.stored(df, "x")
        assert kept.count() == 100 and kept.inputFiles()[0].removeprefix("file://").startswith(folder.removeprefix("file://"))
    assert spark.read.schema("id long").parquet(folder).count() == 0
