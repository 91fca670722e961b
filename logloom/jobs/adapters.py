"""The driver's tables in the shapes that this library works on: events, raw lines of them, alerts and a journal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import saved, shared_folder

#: The same columns as ``events`` below, in SQL.
EVENTS_SQL = """ev AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS ts_us, 'h' || (user_id % 8) AS host, CASE WHEN event_id % 3 = 0 THEN 'journald' ELSE 'auditd' END AS source,
    CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'process' WHEN 'purchase' THEN 'network' WHEN 'signup' THEN 'auth' ELSE 'kernel' END AS category,
    event_type AS action, event_type <> 'error' AS success, CASE WHEN user_id % 25 = 0 THEN 0 ELSE 1000 + user_id END AS uid, user_id % 25 = 0 AS is_root, 'u' || user_id AS auth_user,
    '/opt/app' || (k % 5) || '/bin/tool' AS exe, CASE WHEN k % 10 = 0 THEN '/tmp/job-' || (1000 + event_id) || '/run.sh' ELSE '/data/' || event_type || '/' || k END AS path,
    'tool --mode ' || (k % 3) || ' id-' || (1000 + event_id) AS cmdline, CASE WHEN k % 4 <> 0 THEN 'sh' || (k % 2) END AS parent_name, '10.0.' || (user_id % 4) || '.' || k AS remote_ip, 1000 + k AS remote_port,
    k % 8 AS priority, CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS interactive, CAST(k AS VARCHAR) AS session_text, value, user_id, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores. Splits of a Parquet file do not tell how many tasks have rows, as one without the middle of a row group is empty; so rows of however many are dealt out, as long as they are narrow."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # By their columns: rows that are dealt out in turn are sorted first, in as few tasks as there are row groups.
    return rows.repartition(max(cores, rows.rdd.getNumPartitions()), *rows.columns)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def with_place(rows: DataFrame) -> DataFrame:
    """rows with place, from 1, as they stand in the whole: the size of each partition is counted, and none is moved."""
    numbered = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    numbered = saved(numbered)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_first", "before")
    return numbered.join(F.broadcast(before), "_part").withColumn("place", F.col("before") + F.col("_id") - F.col("_first") + 1).drop("_part", "_id", "_first", "before")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical columns that the events' own ones give."""
    e = spread(table(spark, sf_dir, "events")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.withColumn("ts_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")).withColumn("ts", F.timestamp_micros("ts_us"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col
    kinds = F.when(c("event_type") == "view", "file").when(c("event_type") == "click", "process").when(c("event_type") == "purchase", "network").when(c("event_type") == "signup", "auth").otherwise("kernel")
    return e.select(
        c("event_id").alias("seq"), "ts", "ts_us", text("h", c("user_id") % 8).alias("host"), F.when(c("event_id") % 3 == 0, "journald").otherwise("auditd").alias("source"),
        kinds.alias("category"), c("event_type").alias("action"), (c("event_type") != "error").alias("success"), F.when(c("user_id") % 25 == 0, 0).otherwise(c("user_id") + 1000).alias("uid"), (c("user_id") % 25 == 0).alias("is_root"), text("u", c("user_id")).alias("auth_user"),
        text("/opt/app", c("k") % 5, "/bin/tool").alias("exe"), F.when(c("k") % 10 == 0, text("/tmp/job-", c("event_id") + 1000, "/run.sh")).otherwise(text("/data/", c("event_type"), "/", c("k"))).alias("path"),
        text("tool --mode ", c("k") % 3, " id-", c("event_id") + 1000).alias("cmdline"), F.when(c("k") % 4 != 0, text("sh", c("k") % 2)).alias("parent_name"), text("10.0.", c("user_id") % 4, ".", c("k")).alias("remote_ip"), (c("k") + 1000).alias("remote_port"),
        (c("k") % 8).alias("priority"), F.when(c("k") % 3 != 0, c("k") % 2 == 0).alias("interactive"), c("k").cast("string").alias("session_text"), "value", "user_id", "k",
    )


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as the audit records of a program start, a file access, a connection or a login, in (value, pos, path).

    Programs are scripts, or have an argument in pieces, or one in hexadecimal digits; files may come with their folder; connections are of either family.
    """
    e = events(spark, sf_dir)
    k, of = F.col("k"), F.col("category")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    stamp = text("msg=audit(", F.floor(F.col("ts_us") / 1_000_000), ".", F.lpad((F.floor(F.col("ts_us") / 1000) % 1000).cast("string"), 3, "0"), ":", F.col("seq"), "): ")
    head = lambda kind: text("node=", F.col("host"), f" type={kind} ", stamp)
    call = F.when(of == "process", "59").when(of == "network", "42").otherwise("257")
    hexed = lambda c: F.hex(F.encode(c, "utf-8"))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    is_script = (of == "process") & (k % 4 == 0)
    exe = F.when(is_script, "/usr/bin/python3.11").otherwise(F.col("exe"))
    sys = text(head("SYSCALL"), "arch=c000003e syscall=", call, " success=", F.when(F.col("success"), "yes").otherwise("no"), " exit=0 a0=3 a1=7f a2=", F.when(k % 2 == 0, "41").otherwise("0"), " ppid=1 pid=", k, " auid=", F.when(F.col("is_root"), "4294967295").otherwise(F.col("uid").cast("string")), " uid=", F.col("uid"), " euid=0 tty=", F.when(F.col("interactive"), "pts0").otherwise("(none)"), ' ses=3 comm="tool" exe="', exe, '" key="k1"\x1dUID="', F.col("auth_user"), '"')
    script = text(head("EXECVE"), 'argc=2 a0="python3.11" a1="/opt/run-', k, '.py"')
    pieces = text(head("EXECVE"), 'argc=3 a0="tool" a1_len=20 a1[0]="pa" a1[1]=', hexed(text("rt-", F.col("seq"))), ' a2="x\\"y"')
    plain = text(head("EXECVE"), 'argc=3 a0="tool" a1=', hexed(text("--id ", F.col("seq"))), ' a2="x\\"y"')
    cwd = text(head("CWD"), 'cwd="/srv/"')
    folder = text(head("PATH"), 'item=0 name="/srv" nametype=PARENT mode=040755 ouid=0 ogid=0')
    path = text(head("PATH"), 'item=1 name="', F.regexp_replace("path", "^/data/", ""), '" nametype=', F.when(k % 5 == 0, "CREATE").otherwise("NORMAL"), " mode=010", F.when(k % 7 == 0, "4755").otherwise("0644"), " ouid=0 ogid=0")
    four = text("0200", F.lpad(F.hex("remote_port"), 4, "0"), two(F.lit(10)), two(F.lit(0)), two(F.col("user_id") % 4), two(k), "0000000000000000")
    six = text("0A00", F.lpad(F.hex("remote_port"), 4, "0"), "00000000", "FD00", "0" * 26, two(k + 1), "00000000")
    sent = text(head("SOCKADDR"), "saddr=", F.when(k % 6 == 0, six).otherwise(four))
    login = text(head("USER_LOGIN"), "pid=", k, " uid=0 auid=", F.col("uid"), ' acct="', F.col("auth_user"), '" exe="/usr/sbin/sshd" hostname=? addr=', F.col("remote_ip"), " terminal=ssh res=", F.when(k % 3 == 0, "failed").otherwise("success"))
    run = F.when(k % 4 == 0, script).when(k % 4 == 1, pieces).otherwise(plain)
    own = F.when(of == "process", F.array(sys, run, cwd)).when(of == "network", F.array(sys, sent)).when(of == "auth", F.array(login)).when(k % 5 == 0, F.array(sys, cwd, folder, path)).otherwise(F.array(sys, cwd, path))
    return e.select("seq", F.posexplode(F.concat(own, F.array(head("EOE")))).alias("n", "value")).select("value", (F.col("seq") * 8 + F.col("n")).alias("pos"), F.lit("events").alias("path"))


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a journald entry of a login, a sudo call or a service, in (value, pos); some messages come as arrays of bytes."""
    e = events(spark, sf_dir)
    k, kind = F.col("k"), F.col("seq") % 3
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    login = text(F.when(F.col("success"), "Accepted").otherwise("Failed"), " password for ", F.when(k % 9 == 0, "invalid user ").otherwise(""), F.col("auth_user"), " from ", F.col("remote_ip"), " port ", F.col("remote_port"), " ssh2")
    unknown = text("Invalid user ", F.col("auth_user"), " from ", F.col("remote_ip"), " port ", F.col("remote_port"))
    sudo = text(F.col("auth_user"), " : TTY=pts/0 ; PWD=/srv ; USER=root ; COMMAND=/bin/ls ", F.col("path"))
    refused = text(F.col("auth_user"), " : 3 incorrect password attempts")
    message = F.when((kind == 0) & (k % 9 == 1), unknown).when(kind == 0, login).when((kind == 1) & (k % 9 == 2), refused).when(kind == 1, sudo).otherwise(text("started ", F.col("action")))
    program = F.when(kind == 0, "sshd").when(kind == 1, "sudo")
    entry = F.struct(
        F.col("ts_us").cast("string").alias("__REALTIME_TIMESTAMP"), F.col("host").alias("_HOSTNAME"), program.alias("_COMM"), F.when(kind == 2, "app").alias("SYSLOG_IDENTIFIER"), F.when(kind == 2, "app.service").alias("_SYSTEMD_UNIT"), F.when(kind == 0, "/usr/sbin/sshd").alias("_EXE"),
        F.when(kind == 2, text("app --seq ", F.col("seq"))).alias("_CMDLINE"), F.col("priority").cast("string").alias("PRIORITY"), F.col("uid").cast("string").alias("_UID"),
    )
    said = F.when(k % 10 == 3, F.to_json(F.transform(F.split(message, ""), lambda c: F.ascii(c)))).otherwise(text('"', message, '"'))
    return e.select(text('{"MESSAGE":', said, ",", F.substring(F.to_json(entry), 2, 1 << 20)).alias("value"), F.col("seq").alias("pos"))


def web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a line of a web server's log, in (value, pos)."""
    p = table(spark, sf_dir, "pages")
    line = F.concat(F.lit("10.1.0."), (F.col("page_id") % 250).cast("string"), F.lit(' - - [05/Feb/2024:10:00:'), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(' +0000] "GET /p/'), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "?q=1").otherwise(""), F.lit(' HTTP/1.1" '), F.when(F.col("page_id") % 10 == 0, "404").otherwise("200"), F.lit(" "), F.when(F.col("page_id") % 7 == 0, "-").otherwise((F.col("page_id") * 3).cast("string")), F.lit(' "-" "agent"'))
    return p.select(line.alias("value"), F.col("page_id").alias("pos"))


ALERTS_SQL = """al AS (
  SELECT 'A' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS alert_id, 'rule_' || source AS rule, CASE n_chars % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
    substr(sha256('s' || (doc_id % 97)), 1, 16) AS signature, 'h' || (doc_id % 8) AS host, '/usr/bin/' || lang AS exe, CASE WHEN doc_id % 2 = 1 THEN '/data/' || (doc_id % 13) END AS path, ['lang_' || lang, source] AS tags, doc_id AS seq FROM documents)"""
JOURNAL_SQL = """jr AS (
  SELECT a.alert_id, CASE n WHEN 0 THEN 'in_progress' WHEN 2 THEN 'open' ELSE CASE WHEN toxic = 1 THEN 'true_positive' WHEN quality = 0 THEN 'duplicate' WHEN doc_id % 3 = 0 THEN 'false_positive' ELSE 'benign_positive' END END AS verdict,
    'n' || n AS note, 'a' || (doc_id % 4) AS analyst, a.rule, a.signature, strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST((doc_id * 7919) % 100003 * 3 + n AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS updated_at, doc_id * 3 + n AS pos
  FROM labels JOIN al a ON a.seq = doc_id, (VALUES (0), (1), (2)) v(n) WHERE n < 2 OR doc_id % 11 = 0),
lt AS (SELECT *, min(pos) OVER (PARTITION BY alert_id) AS first_pos FROM jr QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY pos DESC) = 1),
ix AS (SELECT signature, verdict, alert_id FROM (SELECT * FROM lt QUALIFY row_number() OVER (PARTITION BY signature ORDER BY updated_at DESC, first_pos DESC) = 1) WHERE verdict NOT IN ('open', 'in_progress'))"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an alert."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(s) for s in ("info", "low", "medium", "high", "critical")])
    return d.select(
        F.concat(F.lit("A"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("alert_id"), F.concat(F.lit("rule_"), "source").alias("rule"), F.get(names, (F.col("n_chars") % 5).cast("int")).alias("severity"),
        F.substring(F.sha2(F.concat(F.lit("s"), (F.col("doc_id") % 97).cast("string")), 256), 1, 16).alias("signature"), F.concat(F.lit("h"), (F.col("doc_id") % 8).cast("string")).alias("host"),
        F.concat(F.lit("/usr/bin/"), "lang").alias("exe"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("/data/"), (F.col("doc_id") % 13).cast("string"))).alias("path"), F.array(F.concat(F.lit("lang_"), "lang"), F.col("source")).alias("tags"), F.col("doc_id").alias("seq"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two or three lines of verdicts each."""
    lines = table(spark, sf_dir, "labels").join(alerts(spark, sf_dir), F.col("seq") == F.col("doc_id")).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("n < 2 or doc_id % 11 = 0")
    judged = F.when(F.col("toxic") == 1, "true_positive").when(F.col("quality") == 0, "duplicate").when(F.col("doc_id") % 3 == 0, "false_positive").otherwise("benign_positive")
    at = F.expr("timestampadd(SECOND, cast((doc_id * 7919) % 100003 * 3 + n AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    return lines.select(
        "alert_id", F.when(F.col("n") == 0, "in_progress").when(F.col("n") == 2, "open").otherwise(judged).alias("verdict"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("note"),
        F.concat(F.lit("a"), (F.col("doc_id") % 4).cast("string")).alias("analyst"), "rule", "signature", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), (F.col("doc_id") * 3 + F.col("n")).alias("pos"),
    )
