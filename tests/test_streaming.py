import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators import alerts, enrich, suppress, verdicts
from logloom.operators.detect import Rule, Threshold
from logloom.sources import audit, feeds, store
from logloom.streaming import signatures
from logloom.streaming.assembly import OpenEvents, assemble_stream, event_stream
from logloom.streaming.parents import parents_stream
from logloom.streaming.renewal import fingerprint, follow_rules
from logloom.streaming.sinks import detect_stream, late_rows, line_stream, live_queue, write_alerts
from logloom.streaming.suppression import passing_stream, suppress_stream

DAY = 86_400_000_000


def hits_files(folder, seed=1, n=300):
    random = np.random.default_rng(seed)
    rows = [{"rule": "r", "key": f"k{random.integers(4)}", "ts_us": int(random.integers(0, DAY)), "seq": i} for i in range(n)]
    rows.sort(key=lambda r: r["ts_us"])
    for part in range(6):
        mixed = rows[part * 50 : part * 50 + 50]
        random.shuffle(mixed)
        (folder / f"{part}.json").write_text("\n".join(map(json.dumps, mixed)))
    later = [{"rule": "end", "key": f"k{k}", "ts_us": 5 * DAY + k, "seq": 10_000 + k} for k in range(4)]
    (folder / "7.json").write_text("\n".join(map(json.dumps, later)))
    for k, f in enumerate(sorted(folder.iterdir())):
        os.utime(f, (k + 1, k + 1))
    return "rule string, key string, ts_us long, seq long"


def test_streams_give_what_batches_give(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = hits_files(source)
    shape = lambda df: df.select("rule", "key", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "seq", F.lit(3).alias("count"), F.lit(DAY // 40).cast("long").alias("window_us"))
    for kind, batch in (("threshold", suppress.threshold), ("throttle", suppress.throttle)):
        hits = shape(spark.read.schema(schema).json(str(source))).where("rule = 'r'")
        want = {(r.key, r.ts_us, r.seq) for r in batch(hits).collect()}
        stream = shape(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(source)))
        out = suppress_stream(stream, kind, "6 hours")
        q = write_alerts(out, str(tmp_path / kind), str(tmp_path / f"{kind}-state"))
        q.awaitTermination()
        got = [(r.key, r.ts_us, r.seq) for r in spark.read.parquet(str(tmp_path / kind)).where("rule = 'r'").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_events_are_assembled_from_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda kind, sec, serial, body: f"node=h1 type={kind} msg=audit({sec}.500:{serial}): {body}"
    (source / "a.txt").write_text("\n".join([line("SYSCALL", 100, 1, 'syscall=59 success=yes exe="/bin/ls"'), line("SYSCALL", 100, 2, "syscall=42 success=no"), line("EXECVE", 100, 1, 'argc=2 a0="ls" a1="-l"'), line("EOE", 100, 1, "")]))
    (source / "b.txt").write_text(line("SYSCALL", 900, 3, "syscall=59") + "\n" + line("EOE", 900, 3, ""))
    os.utime(source / "a.txt", (1, 1))  # files are read in the order of their times
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).select("value", F.lit(0).alias("pos"), F.lit("f").alias("path"))
    q = write_alerts(event_stream(lines).select("serial", "action", "cmdline", "success"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = {r.serial: (r.action, r.cmdline, r.success) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["1"] == ("execve", "ls -l", True)
    assert got["2"] == ("connect", None, False)  # no end marker: out when it has been quiet
    assert "3" in got
    whole = audit.read_events(spark.read.text(str(source)).select("value", F.lit(0).alias("pos"), F.lit("f").alias("path")))
    assert {r.serial for r in whole.collect()} == set(got)


def test_lines_of_a_stream_keep_their_order(spark, tmp_path):
    """Records in no order of the alphabet, of which the first of a type counts: as in a batch."""
    source = tmp_path / "in"
    source.mkdir()
    line = lambda kind, serial, body: f"type={kind} msg=audit(100.500:{serial}): {body}"
    lines = [
        line("SYSCALL", 1, "syscall=257 success=yes"), line("PATH", 1, 'item=10 name="/z" nametype=NORMAL'), line("SYSCALL", 2, "syscall=257 success=no"), line("PATH", 1, 'item=2 name="/a" nametype=NORMAL'), line("CWD", 2, 'cwd="/srv"'),
        line("USER_END", 3, "res=failed"), line("USER_ACCT", 3, "res=success acct=x"), line("USER_ACCT", 3, "res=success acct=a"), line("PATH", 2, 'name="q" nametype=PARENT'), line("PATH", 2, 'name="p" nametype=CREATE'), line("PATH", 2, 'name="b" nametype=CREATE'),
    ]
    (source / "a.log").write_text("\n".join(lines) + "\n")
    (source / "b.log").write_text(line("EOE", 1, "") + "\n" + "type=SYSCALL msg=audit(900.000:9): syscall=59\n")
    for k, f in enumerate(("a.log", "b.log")):
        os.utime(source / f, (k + 1, k + 1))
    shown = ("serial", "action", "path", "paths", "auth_user", "auth_result", "success", "raw")
    q = write_alerts(event_stream(line_stream(spark, str(source), per_trigger=1)).select(*shown), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    streamed = {r.serial: r for r in spark.read.parquet(str(tmp_path / "out")).select(*shown).collect() if r.serial != "9"}
    batch = {r.serial: r for r in audit.read_events(feeds.text_lines(spark, [str(source)])).select(*shown).collect() if r.serial != "9"}
    assert streamed == batch and len(batch) == 3
    assert batch["1"].path == "/z" and batch["2"].path == "/srv/p" and (batch["3"].action, batch["3"].auth_user, batch["3"].auth_result) == ("user_end", "x", "failure")


def test_rules_and_verdicts_are_read_anew(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"host": f"h{k}", "seq": k, "s": k}))
        os.utime(source / f"{k}.json", (k + 1, k + 1))
    stream = lambda: spark.readStream.schema("host string, seq long, s long").option("maxFilesPerTrigger", 1).json(str(source)).withColumn("ts", F.timestamp_seconds("s"))
    asked = []

    def rules():
        asked.append(1)
        return [Rule("first" if len(asked) == 1 else "later", "high", lambda f: [f.present("host")])]

    detect_stream(stream(), rules, str(tmp_path / "alerts"), str(tmp_path / "a")).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "alerts"))
    assert sorted((r.host, r.rule["name"]) for r in made.collect()) == [("h0", "first"), ("h1", "later"), ("h2", "later")]
    with pytest.raises(Exception, match="need state"):
        detect_stream(stream(), lambda: [Rule("x", "high", lambda f: [], threshold=Threshold(2, 5))], str(tmp_path / "x"), str(tmp_path / "xs")).awaitTermination()

    read = []

    def journal():
        read.append(1)
        closed = [("A0", "open", 0), ("A1", "false_positive", 1)] if len(read) > 1 else []
        return spark.createDataFrame([(a, v, "", "", "r", "", "2024", p) for a, v, p in closed], "alert_id string, verdict string, note string, analyst string, rule string, signature string, updated_at string, pos long")

    alerts = stream().select(F.concat(F.lit("A"), "seq").alias("alert_id"), F.lit("r").alias("rule"), F.lit("s").alias("signature"), F.when(F.col("seq") < 2, "high").otherwise("low").alias("severity"))
    live_queue(alerts, journal, "medium", str(tmp_path / "queue"), str(tmp_path / "q")).awaitTermination()
    assert [r.alert_id for r in spark.read.parquet(str(tmp_path / "queue")).collect()] == ["A0"]


def test_a_throttle_follows_a_threshold(spark, tmp_path):
    """One stream with both, rows of each file in any order, and a restart: as the batch. Rows behind the watermark are dropped and counted."""
    random = np.random.default_rng(5)
    rules = [
        Rule("both", "high", lambda f: [], threshold=Threshold(3, 900, ("key",)), throttle_s=4000, dedup_by=("kind",)), Rule("counted", "low", lambda f: [], threshold=Threshold(2, 300)),
        Rule("slowed", "low", lambda f: [], throttle_s=2000, dedup_by=("key",)), Rule("plain", "low", lambda f: []), Rule("the end", "low", lambda f: [], throttle_s=1, dedup_by=("key",)),
    ]
    rows = [(str(random.choice(["both", "counted", "slowed", "plain"])), f"k{random.integers(2)}", f"d{random.integers(2)}", int(random.integers(0, 86_400_000_000)), i) for i in range(600)]
    hits = lambda x: spark.createDataFrame(x, "rule string, key string, kind string, ts_us long, seq long").withColumn("ts", F.timestamp_micros("ts_us"))
    shape = lambda df: df.select("rule", "ts", "ts_us", "seq", *[c.alias(n) for n, c in alerts.keyed(df, rules).items()])
    want = sorted((r.rule, r.seq, r.match_count, r.members) for r in alerts.passing(shape(hits(rows)), rules).collect())
    rows.sort(key=lambda r: r[3])
    source, parts = str(tmp_path / "in"), [rows[a : a + 100] for a in range(0, 600, 100)]
    stream = lambda: passing_stream(spark.readStream.schema(shape(hits(rows[:1])).drop("ts_us").schema).option("maxFilesPerTrigger", 1).parquet(source), "10 minutes")
    late = 0
    for step in (parts[:3], parts[3:], [[("plain", "k", "d", 5, 9000)], [("the end", "k", "d", 10**15, 10_000)]]):
        for part in step:
            mixed = [part[i] for i in random.permutation(len(part))]
            shape(hits(mixed)).drop("ts_us").coalesce(1).write.mode("append").parquet(source)
        q = write_alerts(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        late += late_rows(q).count()
    got = sorted((r.rule, r.seq, r.match_count, r.members) for r in spark.read.parquet(str(tmp_path / "out")).where("rule <> 'the end' and seq <> 9000").collect())
    assert got == want and {r[0] for r in got} == {"both", "counted", "slowed", "plain"}
    again = hits([("counted", "k0", "d0", 7, 9001)])
    shape(again).drop("ts_us").coalesce(1).write.mode("append").parquet(source)
    q = write_alerts(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert [r.n for r in late_rows(q).collect()] == [1]


def test_a_fingerprint_tells_what_state_depends_on(spark):
    schema = T.StructType.fromDDL("a string, tags array<string>")
    names = [f"v{i}" for i in range(200)]
    of = lambda when, **more: fingerprint(Rule(more.pop("name", "r"), more.pop("severity", "high"), when, **more), schema)
    plain = lambda f: [f.equal("a", "x")]
    assert of(plain) == of(lambda f: [f.equal("a", "x")], name="other", severity="low", description="d")
    assert of(lambda f: [f.contains("tags", "x_1")]) == of(lambda f: [f.contains("tags", "x_1")]) != of(lambda f: [f.contains("tags", "x_2")])
    assert of(lambda f: [f.is_in("a", names)]) != of(lambda f: [f.is_in("a", [*names[:-1], "w"])])
    assert len({of(plain), of(plain, feeds=("x",)), of(plain, threshold=Threshold(2, 5)), of(plain, threshold=Threshold(2, 5, ("a",))), of(plain, throttle_s=5), of(plain, throttle_s=5, dedup_by=("a",))}) == 6


def test_rules_with_state_are_renewed_while_a_stream_runs(spark, tmp_path):
    """Two of three hits before the change: a rule that stays counts them, one that has changed does not; then a list without any state, and the first again."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rule = lambda name, n, **more: Rule(name, "high", lambda f: [f.present("host")], threshold=Threshold(n, 1000), **more)
    asked = [[rule("stays", 3), rule("changes", 3), rule("goes", 3)], [rule("stays", 3, description="new text"), rule("changes", 2)], [Rule("plain", "low", lambda f: [f.present("host")])], [rule("stays", 3)]]
    hits = [[100, 110], [120], [130], [140, 150, 160], [10**9]]

    def run(n, seconds):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"host": "h", "seq": s, "s": s}) for s in seconds))
        os.utime(source / f"{n}.json", (n + 1, n + 1))
        stream = lambda: spark.readStream.schema("host string, seq long, s long").json(str(source)).withColumn("ts", F.timestamp_seconds("s"))
        return follow_rules(stream, lambda: asked[min(n, 3)], out, str(tmp_path / "state"), delay="1 second")

    assert [run(n, seconds) for n, seconds in enumerate(hits)] == [1] * 5
    got = sorted((r.rule, r.seq, r.match_count) for r in spark.read.parquet(out).collect())
    assert got == [("plain", 130, 1), ("stays", 120, 3), ("stays", 160, 3)]


def test_a_running_stream_starts_again_when_its_rules_change(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text(json.dumps({"host": "h", "seq": 1, "s": 1}))
    stream = lambda: spark.readStream.schema("host string, seq long, s long").json(str(source)).withColumn("ts", F.timestamp_seconds("s"))
    asked = []

    def rules():
        asked.append(1)
        return [Rule("slow", "high", lambda f: [f.present("host")], throttle_s=60 if len(asked) < 3 else 90)]

    assert follow_rules(stream, rules, str(tmp_path / "out"), str(tmp_path / "state"), every_s=1, until=lambda: len(asked) > 4, processingTime="1 second") == 2


def test_signatures_follow_the_journal(spark, tmp_path):
    """Random verdicts of few alerts and signatures, with ties, missing times, alerts that change their signature and reopened ones: after each append as from the whole journal."""
    random, folder = np.random.default_rng(3), str(tmp_path / "journal")
    pick = lambda *x: x[random.integers(len(x))]
    for step in range(4):
        rows = [(f"A{random.integers(12)}", pick("open", "false_positive", "true_positive", "duplicate", None), "", "", "r", pick("s0", "s1", "s2", "", None), pick(None, *(f"2024-01-0{d}" for d in range(1, 6)))) for _ in range(15)]
        store.append_journal(spark.createDataFrame(rows, "alert_id string, verdict string, note string, analyst string, rule string, signature string, updated_at string").coalesce(1), folder)
        q = write_alerts(signatures.index_changes(signatures.journal_stream(spark, folder)), str(tmp_path / "changes"), str(tmp_path / "state"))
        q.awaitTermination()
        assert q.lastProgress.numInputRows == 1  # the new file only
        got = signatures.index_of(spark.read.parquet(str(tmp_path / "changes"))).collect()
        want = verdicts.signature_index(verdicts.latest(store.load_journal(spark, folder))).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_stream_reads_files_line_by_line(spark, tmp_path):
    """A file in several splits is never one row; lines keep their order, those without one in a new split too."""
    source = tmp_path / "in"
    source.mkdir()
    texts = [f"line {i:04d}" + " x" * (i % 7) for i in range(3000)]
    (source / "a.log").write_text("\n".join(texts[:1000]) + "\n\n" + "\n".join(texts[1000:]))
    with_small_splits = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    old = {k: spark.conf.get(k) for k in with_small_splits}
    try:
        for k, v in with_small_splits.items():
            spark.conf.set(k, v)
        q = write_alerts(line_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(p.numInputRows for p in q.recentProgress) == 3001
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.value for r in sorted(got, key=lambda r: r.pos)] == texts and len({r.pos.split()[-2] for r in got}) > 3


def test_events_of_a_part_end_each_by_itself(spark, tmp_path, monkeypatch):
    """Many events in two keys of the state, whose records come in three steps: ended by a marker, now or later, or quiet; each is out once and whole."""
    monkeypatch.setattr("logloom.streaming.assembly.PARTS", 2)
    source, random = tmp_path / "in", np.random.default_rng(4)
    source.mkdir()
    line = lambda n, kind, body="": f"node=h{n % 3} type={kind} msg=audit({100 + n // 10}.{n % 10}00:{n}): {body}"
    steps = [[], [], []]
    for n in range(60):
        for kind, body in (("SYSCALL", "syscall=257 success=yes"), ("CWD", 'cwd="/srv"'), ("PATH", f'name="{n}" nametype=NORMAL')):
            steps[random.integers(2)].append(line(n, kind, body))
        if n % 3:
            steps[1 if n % 3 == 1 else 2].append(line(n, "EOE"))
    steps.append([line(10_000, "SYSCALL", "syscall=59")])
    shown = ("host", "serial", "path", "success", "record_types")
    for k, lines in enumerate(steps):
        (source / f"{k}.log").write_text("\n".join(lines))
        os.utime(source / f"{k}.log", (k + 1, k + 1))
    q = write_alerts(event_stream(line_stream(spark, str(source), per_trigger=1), delay="60 seconds").select(*shown), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) < 20
    order = lambda df: sorted(map(tuple, df.select(*shown).where("serial <> '10000'").collect()))
    got, want = order(spark.read.parquet(str(tmp_path / "out"))), order(audit.read_events(feeds.text_lines(spark, [str(source)])))
    assert got == want and len(got) == 60


def test_keys_share_the_state_of_their_part(spark, tmp_path, monkeypatch):
    """Many keys in two keys of the state, one of them null, with seqs that are texts: thresholds and throttles as in a batch, and nothing is kept of a key whose window has passed."""
    monkeypatch.setattr("logloom.streaming.parts.PARTS", 2)
    random = np.random.default_rng(6)
    rows = sorted((int(random.integers(0, DAY)), f"s{i:04d}", None if i % 40 == 0 else f"k{i % 40}") for i in range(800))
    shape = lambda x: spark.createDataFrame([("r", k, t, s) for t, s, k in x], "rule string, key string, ts_us long, seq string").select("rule", "key", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "seq", F.lit(2).alias("count"), F.lit(DAY // 15).cast("long").alias("window_us"))
    steps = [rows[:300], rows[300:], [(5 * DAY, "s9998", "k1")], [(9 * DAY, "s9999", "k2")]]
    for kind, batch in (("threshold", suppress.threshold), ("throttle", suppress.throttle)):
        known = shape([(t, s, k or "null") for t, s, k in rows])
        want = sorted((r.key, r.ts_us, r.seq, r.match_count if kind == "threshold" else 1, r.members if kind == "threshold" else []) for r in batch(known).collect())
        sizes = []
        for step in steps:
            shape(step).drop("ts_us").coalesce(1).write.mode("append").parquet(str(tmp_path / kind / "in"))
            q = write_alerts(suppress_stream(spark.readStream.schema(shape(rows[:1]).drop("ts_us").schema).parquet(str(tmp_path / kind / "in")), kind), str(tmp_path / kind / "out"), str(tmp_path / kind / "state"))
            q.awaitTermination()
            sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
        got = sorted((r.key or "null", r.ts_us, r.seq, r.match_count, r.members) for r in spark.read.parquet(str(tmp_path / kind / "out")).where("seq < 's9'").collect())
        assert got == want and {x[0] for x in got} > {"null", "k7"}
        assert max(sizes) <= 8 and sizes[-1] <= 2


@pytest.mark.parametrize("forget_s", [None, 86_400.0])
def test_processes_share_the_state_of_their_part(spark, tmp_path, monkeypatch, forget_s):
    """Parents of many processes on hosts of which one has no name, in two keys of the state and three steps: as in a batch; those forgotten were too old for what comes."""
    monkeypatch.setattr("logloom.streaming.parts.PARTS", 2)
    random = np.random.default_rng(8)
    schema = "seq long, host string, pid long, ppid long, exe string, comm string, action string, s long"
    rows = []
    for i in range(600):
        host, one, start = (None, "a", "b")[random.integers(3)], int(random.integers(20)), random.random() < 0.4
        rows.append((i, host, one if start else None, int(random.integers(20)) if random.random() < 0.8 else None, f"/e{i}", f"c{i}" if i % 5 else None, "execve" if start else "open", int(random.integers(0, 40_000))))
    rows.sort(key=lambda r: r[-1])
    shape = lambda x: spark.createDataFrame(x, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    sizes = []
    for step in (rows[:250], rows[250:], [(9000, "z", 1, 1, "/e", "c", "execve", 400_000)], [(9001, "z", None, 1, "/e", "c", "open", 800_000)]):
        shape(step).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = write_alerts(parents_stream(spark.readStream.schema(shape(rows[:1]).schema).parquet(str(tmp_path / "in")), forget_s=forget_s), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    shown = ("seq", "host", "parent_exe", "parent_name")
    order = lambda df: sorted(map(tuple, df.where("seq < 9000").select(*shown).collect()), key=str)
    # In a batch a host without a name has no parents: it is given one here.
    known = shape([(a, b or "-", *c) for a, b, *c in rows])
    want = sorted(((a, None if b == "-" else b, *c) for a, b, *c in order(enrich.with_parents(known))), key=str)
    assert order(spark.read.parquet(str(tmp_path / "out"))) == want and any(x[1] is None and x[2] for x in want)
    assert max(sizes) <= 8


def test_events_that_no_rule_matches_move_the_time_on(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rules = [Rule("twice", "high", lambda f: [f.present("host")], threshold=Threshold(2, 1000)), Rule("slowed", "low", lambda f: [f.present("host")], throttle_s=60, dedup_by=("host",))]
    for n, rows in enumerate(([("h", 100), ("h", 110)], [(None, 10**9)])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"host": h, "seq": s, "s": s}) for h, s in rows))
        stream = lambda: spark.readStream.schema("host string, seq long, s long").json(str(source)).withColumn("ts", F.timestamp_seconds("s"))
        follow_rules(stream, lambda: rules, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.rule, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("slowed", 100), ("twice", 110)]


def test_lines_are_read_into_fields_after_their_event_is_out(spark, tmp_path, capsys):
    """Lines stay text in the state, whatever signs they hold; their fields are those of a batch."""
    head = lambda kind, serial: f"node=h type={kind} msg=audit(100.500:{serial}): "
    texts = [
        head("SYSCALL", 1) + 'a=1 b="x \\"y\\" z" a=2 c=\'q r\' exe=2F62696E a=3', head("EXECVE", 1) + "a0=6C73 x=\x10 y=\x100 z=\x101", head("PATH", 1) + "name=first\nname=second \x10\n=odd f==g\x1dUID=\"u\"", head("EOE", 1),
        "type=A msg=audit(100:2): b=1 type=B msg=audit(7:7): type=C", head("USER_CMD", 3) + "msg='op=x res=yes' \u00e9=\u00e8", head("EMPTY", 4), "no record", head("SYSCALL", 900).replace("100.500", "900.000"),
    ]
    spark.createDataFrame([(t, i, "f") for i, t in enumerate(texts)], "value string, pos long, path string").coalesce(1).write.parquet(str(tmp_path / "in"))
    made = assemble_stream(spark.readStream.schema("value string, pos long, path string").parquet(str(tmp_path / "in")))
    made.explain()
    plan = capsys.readouterr().out
    assert plan.rindex("regexp_extract_all") < plan.index("TransformWithState")
    write_alerts(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    order = lambda df: sorted((r.serial, r.host, r.epoch, r.seq, [(x.type, x.fields, x.raw) for x in r.records]) for r in df.collect() if r.serial != "900")
    got, want = order(spark.read.parquet(str(tmp_path / "out"))), order(audit.assemble(audit.records(spark.read.parquet(str(tmp_path / "in")))))
    assert got == want and len(got) == 4


def test_lines_that_wait_take_less_room_than_their_text():
    """Two steps of events without an end, as a part's state holds them; those that have been quiet are out, whole and in order, and the others stay."""
    held, timers = [], []
    state = type("State", (), {"get": lambda _: iter(list(held)), "appendValue": lambda _, x: held.append(x), "put": lambda _, x: held.__setitem__(slice(None), x), "clear": lambda _: held.clear()})()
    handle = type("Handle", (), {"getListState": lambda *_: state, "registerTimer": lambda _, ms: timers.append(ms)})()
    at = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda _: ms})()
    line = lambda n, i: f"node=h type=PATH msg=audit({n}.000:{n}): item={i} name=\"/srv/{n}/{i}\" nametype=NORMAL mode=0100644 ouid=0 ogid=0"
    step = lambda places: pd.DataFrame([(f"{n}.0:{n} h", n * 1000, f"{i:020d}", True, False, line(n, i), f"{n}-{i}") for i in places for n in range(300, 0, -1)], columns=["event", "t", "pos", "named", "ends", "line", "seq"])
    part = OpenEvents(1000)
    part.init(handle)
    for places in ((2, 0), (3, 1)):
        assert not list(part.handleInputRows((0,), iter([step(places)]), at(0)))
    assert len(held) == 2 and sum(len(x) for (x,) in held) < sum(len(line(n, i)) for n in range(1, 301) for i in range(4)) / 2
    assert timers == [2000, 2000]
    (out,) = part.handleExpiredTimer((0,), at(101_000), None)
    assert sorted(zip(out["event"], out["seq"], out["lines"], strict=True)) == sorted((f"{n}.0:{n} h", f"{n}-0", "\n".join(line(n, i) for i in range(4))) for n in range(1, 101))
    assert len(held) == 1 and timers[-1] == 102_000
    (out,) = part.handleExpiredTimer((0,), at(10**9), None)
    assert len(out) == 200 and not held
