import json
import random
import re
import shutil
import socket
import time

from pyspark.sql import functions as F

from logloom.functions.inet import inet6_text
from logloom.jobs import adapters
from logloom.sources import audit, feeds, journal
from logloom.sources.schema import union_feeds

HEAD = "msg=audit(1704067207.179:41): "


def events(spark, *lines, path="f"):
    df = spark.createDataFrame([(v, i, path) for i, v in enumerate(lines)], "value string, pos long, path string")
    return {r.serial: r for r in audit.read_events(df).collect()}


def test_one_event_of_five_records(spark):
    e = events(
        spark,
        f'node=h1 type=SYSCALL {HEAD}arch=c000003e syscall=59 success=yes exit=0 a0=55d0 ppid=900 pid=901 auid=1001 uid=1001 euid=1001 tty=pts0 ses=3 comm="demo" exe="/tmp/x/demo" key="k1"\x1dUID="ann" AUID="ann"',
        f'node=h1 type=EXECVE {HEAD}argc=2 a0="/tmp/x/demo" a1=2D2D6E616D6520626F62',
        f'node=h1 type=CWD {HEAD}cwd="/tmp/x"',
        f'node=h1 type=PATH {HEAD}item=0 name="demo" nametype=NORMAL mode=0104755 ouid=0 ogid=0',
        f"node=h1 type=EOE {HEAD}",
        "no audit line",
    )["41"]
    got = (e.cmdline, e.argc, e.path, e.is_setuid, e.category, e.user, e.auid_set, e.interactive, e.is_write, e.host, e.action, e.file_name, e.exe_dir)
    assert got == ("/tmp/x/demo --name bob", 2, "/tmp/x/demo", True, "process", "ann", True, True, False, "h1", "execve", "demo", "/tmp/x")


def test_edges_of_the_tokeniser(spark):
    df = spark.createDataFrame([(f'type=SYSCALL {HEAD}a="x\\"y" b=\'p q\' c="open d= e=1 e=2 exe=2F62 comm=ABC name="123456"', 0, "f")], "value string, pos long, path string")
    f = audit.records(df).first().fields
    assert f["a"] == 'x"y' and f["b"] == "p q" and f["c"].startswith("open d= e=1")
    df = spark.createDataFrame([(f'type=PATH {HEAD}d= e=1 e=2 exe=2F62 comm=ABC name="313233" path=FFFE', 0, "f")], "value string, pos long, path string")
    assert audit.records(df).first().fields == {"d": "", "e": "2", "exe": "/b", "comm": "ABC", "name": "313233", "path": "FFFE"}


def test_primary_path_split_arguments_and_interleaved_serials(spark):
    e = events(
        spark,
        "type=SYSCALL msg=audit(5.1:7): syscall=257 success=no exit=-13 a2=41 uid=4 euid=0 auid=4294967295 tty=(none) key=(null)",
        'type=PATH msg=audit(5.1:8): name="/a/b.TXT" nametype=NORMAL',
        'type=PATH msg=audit(5.1:7): name="/d" nametype=PARENT',
        'type=PATH msg=audit(5.1:7): name="/d/new" nametype=CREATE mode=0100644',
        "type=EXECVE msg=audit(5.1:9): argc=3 a0=6C73 a1_len=4 a1[0]=6162 a1[1]=6364",
        "type=USER_AUTH msg=audit(5.1:10): acct=\"bob\" res=failed addr=10.0.0.9 terminal=ssh",
        "type=SYSCALL msg=audit(5.1:11): syscall=9999 exit=3 saddr=x",
    )
    a = e["7"]
    assert (a.path, a.nametype, a.paths, a.is_write, a.open_flags, a.auid, a.auid_set, a.priv_escalated, a.outcome, a.interactive, a.key) == ("/d/new", "CREATE", ["/d", "/d/new"], True, 0x41, -1, False, True, "failure", False, None)
    assert (e["8"].category, e["8"].file_ext, e["8"].file_dir) == ("file", "txt", "/a")
    assert e["9"].argv == ["ls", "abcd"]
    assert (e["10"].category, e["10"].action, e["10"].auth_user, e["10"].auth_result, e["10"].remote_ip, e["10"].tty) == ("auth", "user_auth", "bob", "failure", "10.0.0.9", "ssh")
    assert (e["11"].action, e["11"].category, e["11"].success, e["11"].is_write) == ("syscall", "other", True, None)


def test_same_serial_of_two_hosts(spark):
    df = spark.createDataFrame([(f"node=h{i} type=SYSCALL msg=audit(5.1:7): syscall=59", i, "f") for i in range(2)], "value string, pos long, path string")
    assert audit.read_events(df).count() == 2


def test_addresses(spark):
    cases = {"0200005014000001": ("20.0.0.1", 80, "inet", None), "0A000050" + "0" * 8 + "20010DB8" + "0" * 22 + "01" + "0" * 8: ("2001:db8::1", 80, "inet6", None), "01002F746D70002E": (None, None, "unix", "/tmp"), "1000": (None, None, "netlink", None), "02": (None,) * 4, "zz": (None,) * 4}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    for r in df.select("h", *[c.alias(n) for n, c in audit.socket_address(F.col("h")).items()]).collect():
        assert (r.remote_ip, r.remote_port, r.addr_family, r.socket_path) == cases[r.h], r.h
    r = random.Random(3)
    fixed = ["0" * 31 + "1", "0" * 32, "f" * 32, "fd00" + "0" * 24 + "000a", "0" * 20 + "ffff" + "0a000102", "0" * 24 + "0a000102", "0001" + "0" * 28, "2001" + "0000" + "0001" + "0000" * 3 + "0002" + "0000", "0001" + "0000" + "0002" * 6, "0000" + "0001" * 7, "00010000000000020000000000030004"]
    given = fixed + ["".join(r.choice(["0000", "0000", "00a0", f"{r.randrange(65536):04X}"]) for _ in range(8)) for _ in range(1500)] + [None, "", "12", "g" * 32]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(given)], "i int, h string").select("i", inet6_text(F.col("h")).alias("t")).collect()
    want = {i: socket.inet_ntop(socket.AF_INET6, bytes.fromhex(h)) if h and len(h) == 32 and "g" not in h else None for i, h in enumerate(given)}
    assert {x.i: x.t for x in got} == want
    assert not re.search("Python|Arrow", audit.read_events(spark.createDataFrame([("x", 0, "f")], "value string, pos long, path string"))._jdf.queryExecution().toString())


def test_keys_of_lines_stay(spark, tmp_path):
    """However files are split, read or copied, and in the order of their lines."""
    for name, n in (("a/x.log", 900), ("b/x.log", 300), ("b/y z.log", 1), ("b/empty.log", 0)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    shutil.copytree(tmp_path / "in", tmp_path / "other" / "place")
    found = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for folder, size, parts in (("in", old, 0), ("in", "2k", 0), ("other/place", "700", 7), ("in", old, 3)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = feeds.numbered_lines(spark, [f"{tmp_path}/{folder}/*/*.log"], "feed")
            found.append({r.value: (r.seq, r.path) for r in (lines.repartition(parts) if parts else lines).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(found[0]) == 1201 and all(f == found[0] for f in found)
    for name, n in (("a/x.log", 900), ("b/x.log", 300)):
        keys = [found[0][f"{name} line {i}"] for i in range(n)]
        assert [k for k, _ in keys] == sorted(k for k, _ in keys) and {p for _, p in keys} == {name}
    assert len({k for k, _ in found[0].values()}) == 1201 and all(len(k) == 32 for k, _ in found[0].values())
    other = feeds.numbered_lines(spark, [f"{tmp_path}/in/*/*.log"], "another feed").select("seq").collect()
    assert not {r.seq for r in other} & {k for k, _ in found[0].values()}
    assert feeds.numbered_lines(spark, [f"{tmp_path}/in/b/x.log"], "feed").count() == 300


def test_events_keep_the_key_of_their_first_line(spark):
    line = lambda kind, serial: f"node=h type={kind} msg=audit(100.500:{serial}): a=1"
    rows = [(line("SYSCALL", 1), 7, "k7"), (line("CWD", 1), 5, "k5"), (line("SYSCALL", 2), 6, "k6"), (line("EOE", 2), 1, "k1")]
    df = spark.createDataFrame(rows, "value string, pos long, seq string").withColumn("path", F.lit("f"))
    events = audit.read_events(df)
    assert {r.serial: r.seq for r in events.collect()} == {"1": "k5", "2": "k6"}
    both = union_feeds([events, journal.read_events(spark.createDataFrame([('{"MESSAGE":"x"}', 5), ('{"MESSAGE":"x"}', 6)], "value string, pos long"))])
    assert len({r.seq for r in both.collect()}) == 4 and not both.where("seq is null").count()


def test_journal(spark):
    entries = [
        {"__REALTIME_TIMESTAMP": "1700000000000001", "_COMM": "sshd", "MESSAGE": "Failed password for invalid user bob from 1.2.3.4 port 22 ssh2", "PRIORITY": "3", "_AUDIT_LOGINUID": "4294967295"},
        {"MESSAGE": [72, 105, 255], "_SYSTEMD_UNIT": "a.b.service"},
        {"_COMM": "sudo", "MESSAGE": "ann : 3 incorrect password attempts ; TTY=x"},
        {"_COMM": "sshd", "MESSAGE": "Invalid user eve from 9.9.9.9"},
        {"SYSLOG_IDENTIFIER": "kernel", "MESSAGE": "x"},
    ]
    lines = [json.dumps(e) for e in entries] + ["[1]", "{bad", "", None]
    r = journal.read_events(spark.createDataFrame(list(enumerate(lines)), "pos long, value string")).orderBy("pos").collect()
    assert len(r) == 5
    assert (r[0].auth_result, r[0].remote_port, r[0].is_error, r[0].auid, r[0].priority_label, r[0].success) == ("invalid_user", 22, True, -1, "error", False)
    assert (r[1].message, r[1].service, r[1].category) == ("Hi�", "a.b", "service")
    assert (r[2].action, r[2].auth_user, r[2].auth_result) == ("sudo", "ann", "failure")
    assert (r[3].auth_user, r[3].remote_ip) == ("eve", "9.9.9.9")
    assert (r[4].category, r[4].comm) == ("kernel", "kernel")


def test_feeds(spark):
    spec = feeds.FeedSpec(name="x", pattern=r"(?P<ts>\S+ +\S+ \S+) (?P<who>\w+)(?: n=(?P<n>\S+))?", types={"n": "int"}, field_map={"who": "auth_user"}, timestamp_field="ts", static={"host": "s"})
    lines = [("Feb  5 10:00:00 ann n=7",), ("Feb  5 10:00:00 bob n=x",), ("nothing",), ("",)]
    r = feeds.read_events(spark.createDataFrame(lines, "value string").withColumn("pos", F.lit(0)), spec, now=1_700_000_000.0).orderBy("auth_user").collect()
    assert [(x.auth_user, x.extra["n"] if "n" in x.extra else None, x.host) for x in r] == [("ann", "7", "s"), ("bob", None, "s")]
    assert r[0].ts.isoformat() == "2023-02-05T10:00:00"
    parsed = spark.createDataFrame([("2024-02-05T10:00:00Z",), ("2024-02-05 10:00:00",), ("1707127200.5",), ("05/Feb/2024:12:00:00 +0200",), ("x",)], "t string")
    assert [x[0] for x in parsed.select(feeds.parse_time(F.col("t"), F.lit(2024))).collect()] == [1707127200.0, 1707127200.0, 1707127200.5, 1707127200.0, None]


def test_long_commands_cost_in_proportion(spark):
    """Five thousand pieces of one argument, then five thousand arguments: what follows a gap does not count."""
    pieces = " ".join(f"a1[{i}]=6162" for i in range(5000))
    many = " ".join(f'a{i}="x{i}"' for i in range(5000))
    start = time.perf_counter()
    e = events(
        spark,
        f'type=EXECVE {HEAD}argc=3 a0="ls" a1_len=20000 {pieces} a2="z" a4="after a gap"',
        f"type=EXECVE msg=audit(1.0:42): argc=5000 {many}",
        "type=EXECVE msg=audit(1.0:43): a0=6C73 a1[0]=6162 a1[2]=6364 a1=whole a2[1]=6162",
        "type=EXECVE msg=audit(1.0:44): a1=00",
        "type=EXECVE msg=audit(1.0:45): a0=6162 a0=6364 a0=6566 a1[0]=6768 a1[0]=696A",
    )
    took = time.perf_counter() - start
    assert e["41"].argv == ["ls", "ab" * 5000, "z"] and e["42"].argv == [f"x{i}" for i in range(5000)]
    assert e["43"].argv == ["ls", "whole"] and e["44"].argv is None and e["45"].argv == ["ef", "ij"]
    assert took < 60


def test_heads_of_lines(spark):
    good = ["type=X msg=audit(1.5:2): a=1", "node=h type=X1_Y   msg=audit(1:2):a=1", "node=h\ttype=X msg=audit(10.179:3): "]
    bad = ["type=x msg=audit(1.5:2): a=1", "node= type=X msg=audit(1.5:2): a", "n type=X msg=audit(1.5:2): a", "type=X msg=audit(1.5): a", "type=X msg=audit(a:2): a", " type=X msg=audit(1:2): a", "type=X node=h msg=audit(1:2): a", "audit(1:2):", "", None]
    df = spark.createDataFrame([(v, i, "f") for i, v in enumerate(good + bad)], "value string, pos long, path string")
    got = [(r.node, r.type, r.sec, r.msec, r.serial, r.fields) for r in audit.records(df).orderBy("pos").collect()]
    assert got == [(None, "X", 1, 5, "2", {"a": "1"}), ("h", "X1_Y", 1, 0, "2", {"a": "1"}), ("h", "X", 10, 179, "3", {})]


def test_very_long_values_and_many_equal_names(spark):
    long = "x" * 200_000 + '\\"' * 50_000
    df = spark.createDataFrame([(f'type=CWD {HEAD}cwd="{long}" ' + "k=1 " * 20_000 + "no-name" * 30_000 + ' k="2"" j=3"\'x', 0, "f")], "value string, pos long, path string")
    f = audit.records(df).first().fields
    assert f["k"] == "2" and f["j"] == "3\"'x" and f["cwd"] == "x" * 200_000 + '"' * 50_000


def test_what_programs_say_of_logins(spark):
    said = {
        ("sshd", "Accepted publickey for ann from 2001:db8::1 port 50022 ssh2: RSA x"): ("success", "ann", "publickey", "2001:db8::1", 50022),
        ("sshd", "Failed password for invalid user bob from 1.2.3.4 port 22 ssh2"): ("invalid_user", "bob", "password", "1.2.3.4", 22),
        ("sshd", "error: Failed none for root from 1.2.3.4 port 9"): ("failure", "root", "none", "1.2.3.4", 9),
        ("sshd", "Failed password for from from 1.2.3.4 port 22"): ("failure", "from", "password", "1.2.3.4", 22),
        ("sshd", "Invalid user  from 1.2.3.4"): (None, None, None, None, None),
        ("sshd", "Failed password for x from nowhere port 22"): (None, None, None, None, None),
        ("sudo", "  ann : TTY=pts/0 ; PWD=/srv ; USER=root ; COMMAND=/bin/sh -c a;b ; COMMAND=x"): ("success", "ann", None, None, None),
        ("sudo", "ann : TTY=unknown ; PWD=/a b ; USER=root ; COMMAND=/bin/ls"): (None, None, None, None, None),
        ("sudo", "bob : user NOT in sudoers ; x"): ("failure", "bob", None, None, None),
        ("sudo", "bob : 1 incorrect password attempt"): ("failure", "bob", None, None, None),
        ("sudo", "pam_unix(sudo:auth): authentication failure"): (None, None, None, None, None),
        ("app", "Accepted password for ann from 1.2.3.4 port 22"): (None, None, None, None, None),
    }
    lines = [(json.dumps({"_COMM": c, "MESSAGE": m}), i) for i, (c, m) in enumerate(said)]
    got = journal.read_events(spark.createDataFrame(lines, "value string, pos long")).orderBy("pos").collect()
    assert [(r.auth_result, r.auth_user, r.auth_method, r.remote_ip, r.remote_port) for r in got] == list(said.values())
    assert got[6].sudo_command == "/bin/sh -c a;b ; COMMAND=x" and got[6].cwd == "/srv" and got[6].tty == "pts/0"


def test_what_user_space_says_is_read_on_request(spark):
    line = f"""type=USER_LOGIN {HEAD}pid=7 uid=0 msg='op=login acct="ann" exe="/usr/sbin/sshd" addr=10.0.0.9 pid=8 res=failed'"""
    df = spark.createDataFrame([(line, 0, "f")], "value string, pos long, path string")
    plain, read = audit.records(df).first().fields, audit.records(df, inner=True).first().fields
    assert set(plain) == {"pid", "uid", "msg"} and (read["acct"], read["res"], read["pid"], read["msg"]) == ("ann", "failed", "7", plain["msg"])
    e = audit.read_events(df, inner=True).first()
    assert (e.auth_user, e.auth_result, e.remote_ip, e.success) == ("ann", "failure", "10.0.0.9", False) and audit.read_events(df).first().auth_user is None


def test_lines_are_read_once_and_only_what_is_asked_for_moves(spark):
    """Entries are not read again for a filter where the lines are made; texts of records are moved only for raw; small tables are dealt out without a sort."""
    from logloom.jobs import adapters
    from logloom.sources import audit, journal

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    entries = journal.read_events(adapters.journal_lines(spark, "/root/testdata/sf0.001")).select("host", "message")
    assert plan(entries).count("_AUDIT_LOGINUID,StringType") == 1
    events = audit.read_events(adapters.audit_lines(spark, "/root/testdata/sf0.001"))
    assert "raw, raw#" not in plan(events.select("host", "cmdline")) and "raw, raw#" in plan(events.select("raw"))
    assert "RoundRobinPartitioning" not in adapters.events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_row_group_of_many_splits_is_dealt_out(spark, tmp_path):
    """Splits without the middle of a row group have no rows: their number does not tell whether all cores have work."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert adapters.table(spark, str(tmp_path), "events").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in adapters.events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 500
