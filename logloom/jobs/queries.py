"""The registered queries of this library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.checkpoints import stored
from logloom.functions.predicates import Fields, Ref
from logloom.jobs import adapters
from logloom.jobs.adapters import ALERTS_SQL, EVENTS_SQL, JOURNAL_SQL
from logloom.jobs.rules import HELD_SQL, HITS_SQL, HOUR, RAW_HITS_SQL, RAW_RULES, RULES, THRESHOLD_SQL, THROTTLE_SQL
from logloom.operators import alerts as alert_ops
from logloom.operators import enrich, reports, suppress, verdicts
from logloom.operators.detect import Rule, Threshold, active, by_rule, key_of, listed_only, matches, with_listed
from logloom.sources import audit, feeds, journal, store
from logloom.sources.schema import with_aliases
from logloom.streaming import assembly, parents, renewal, signatures, sinks, suppression

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_EV, _HITS = f"WITH {EVENTS_SQL} ", f"WITH {EVENTS_SQL}, {HITS_SQL} "
_FIRED, _KEPT = f"WITH RECURSIVE {EVENTS_SQL}, {HITS_SQL}, {THRESHOLD_SQL} ", f"WITH RECURSIVE {EVENTS_SQL}, {HITS_SQL}, {THRESHOLD_SQL}, {THROTTLE_SQL} "
_AL, _JR = f"WITH {ALERTS_SQL} ", f"WITH {ALERTS_SQL}, {JOURNAL_SQL} "
_EFF = _JR + ", ef AS (SELECT al.*, coalesce(lt.verdict, ix.verdict, 'open') AS effective_verdict, lt.verdict IS NULL AND ix.verdict IS NOT NULL AS inherited FROM al LEFT JOIN lt USING (alert_id) LEFT JOIN ix ON ix.signature = al.signature) "
_CLOSED = "('true_positive', 'benign_positive', 'false_positive', 'duplicate')"


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL of its rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Predicates


def _counts(df: DataFrame, flags: dict) -> DataFrame:
    """(predicate, n): on how many rows each holds, in one pass."""
    one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(flags.values())])
    pairs = ", ".join(f"'{n}', c{i}" for i, n in enumerate(flags))
    return one.select(F.expr(f"stack({len(flags)}, {pairs}) as (predicate, n)"))


def _counts_sql(flags: dict[str, str]) -> str:
    return _EV + " UNION ALL ".join(f"SELECT '{n}' AS predicate, count_if({c}) AS n FROM ev" for n, c in flags.items())


@query(_counts_sql({
    "equal text": "action = 'view'", "equal number": "k = 7", "number in text": "CAST(session_text AS DOUBLE) = 7", "equal flag": "interactive IS TRUE", "flag against text": "false", "not equal": "parent_name IS NOT NULL AND parent_name <> 'sh1'",
    "field against field": "remote_port - 1000 = k AND k = priority", "less": "k < 10", "at most": "k <= 10", "greater": "CAST(session_text AS DOUBLE) > 90", "at least": "k >= 90", "text is no number": "false",
}))
def predicates_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    f = Fields(e.schema)
    return _counts(e, {
        "equal text": f.equal("action", "view"), "equal number": f.equal("k", 7), "number in text": f.equal("session_text", 7), "equal flag": f.equal("interactive", True), "flag against text": f.equal("interactive", "true"), "not equal": f.not_equal("parent_name", "sh1"),
        "field against field": f.equal("k", Ref("priority")), "less": f.less("k", 10), "at most": f.at_most("k", 10), "greater": f.greater("session_text", 90), "at least": f.at_least("k", 90), "text is no number": f.greater("action", 1),
    })


@query(_counts_sql({
    "in": "parent_name IN ('sh0', 'zz')", "not in": "coalesce(parent_name NOT IN ('sh0'), true)", "in numbers": "k IN (1, 2, 3)", "contains": "contains(path, 'job')", "contains any": "contains(path, 'view') OR contains(path, 'error')", "any case": "contains(lower(cmdline), 'mode 1')",
    "starts": "starts_with(path, '/tmp/')", "ends": "ends_with(path, '.sh')", "not contains": "NOT coalesce(contains(parent_name, '1'), false)", "matches": "regexp_matches(cmdline, 'id-[0-9]{4}$')", "matches any case": "regexp_matches(cmdline, '(?i)TOOL --MODE [01]')",
    "missing": "parent_name IS NULL", "present": "parent_name IS NOT NULL", "truthy number": "priority <> 0", "truthy flag": "coalesce(interactive, false)", "unknown field": "false", "and or not": "(k < 5 OR k > 95) AND NOT coalesce(interactive, false)",
}))
def predicates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    f = Fields(e.schema)
    return _counts(e, {
        "in": f.is_in("parent_name", ["sh0", "zz"]), "not in": f.not_in("parent_name", ["sh0"]), "in numbers": f.is_in("k", [1, 2, 3]), "contains": f.contains("path", "job"), "contains any": f.contains("path", ["view", "error"]), "any case": f.contains("cmdline", "MODE 1", ignore_case=True),
        "starts": f.starts_with("path", "/tmp/"), "ends": f.ends_with("path", ".sh"), "not contains": ~f.contains("parent_name", "1"), "matches": f.matches("cmdline", "id-[0-9]{4}$"), "matches any case": f.matches("cmdline", "TOOL --MODE [01]", ignore_case=True),
        "missing": f.missing("parent_name"), "present": f.present("parent_name"), "truthy number": f.truthy("priority"), "truthy flag": f.truthy("interactive"), "unknown field": f.truthy("no_such"), "and or not": (f.less("k", 5) | f.greater("k", 95)) & ~f.truthy("interactive"),
    })


# Detection


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(adapters.events(spark, sf_dir), RULES)


@query(_HITS + "SELECT rule, seq FROM hits")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("rule", "seq")


@query(_HITS + "SELECT rule, count(*) AS n FROM hits WHERE rule IN ('root file in tmp', 'failures of a user', 'signups together', 'burst of errors', 'journal urgent') GROUP BY rule")
def rule_matches_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(adapters.events(spark, sf_dir), RULES, min_severity="high").groupBy("rule").agg(F.count("*").alias("n"))


@query(_FIRED + "SELECT rule, key, seq, match_count FROM fired")
def threshold_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, rules = _hits(spark, sf_dir), [r for r in active(RULES) if r.threshold]
    own = hits.where(F.col("rule").isin([r.name for r in rules])).select("rule", by_rule(rules, lambda r: r.threshold.by, lambda names: key_of(hits, names)).alias("key"), "ts_us", "seq", by_rule(rules, lambda r: r.threshold.count).alias("count"), by_rule(rules, lambda r: int(r.threshold.window_s * 1e6)).cast("long").alias("window_us"))
    return suppress.threshold(own).select("rule", "key", "seq", "match_count")


@query(f"WITH RECURSIVE {EVENTS_SQL}, {HITS_SQL}, sk AS (SELECT auth_user AS key, ts_us, seq, row_number() OVER (PARTITION BY auth_user ORDER BY ts_us, seq) AS rn FROM hits WHERE rule = 'purchases of a user'), sw AS (SELECT key, rn, seq, ts_us AS last, true AS kept FROM sk WHERE rn = 1 UNION ALL SELECT k.key, k.rn, k.seq, CASE WHEN k.ts_us - w.last >= 172800000000 THEN k.ts_us ELSE w.last END, k.ts_us - w.last >= 172800000000 FROM sw w JOIN sk k ON k.key = w.key AND k.rn = w.rn + 1) SELECT key, seq FROM sw WHERE kept")
def throttled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = matches(adapters.events(spark, sf_dir), [r for r in RULES if r.name == "purchases of a user"])
    return suppress.throttle(hits.select("rule", F.col("auth_user").alias("key"), "ts_us", "seq", F.lit(172_800_000_000).alias("window_us"))).select("key", "seq")


@query(_KEPT + "SELECT rule, seq, CAST(match_count AS BIGINT) AS match_count FROM kept")
def threshold_then_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.held_back(_hits(spark, sf_dir), active(RULES)).select("rule", "seq", "match_count")


def _severity_sql(rule: str) -> str:
    return f"CASE {rule} " + " ".join(f"WHEN '{r.name}' THEN '{r.severity}'" for r in RULES) + " END"


@query(_KEPT + f"SELECT {_severity_sql('rule')} AS severity, count(*) AS n FROM kept GROUP BY 1")
def detection_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection job whole: events, rules, thresholds, throttles, alerts, and their number by severity."""
    return reports.by_severity(alert_ops.build(adapters.events(spark, sf_dir), RULES))


@query(_KEPT + f"SELECT 'matches' AS metric, (SELECT count(*) FROM hits) AS n UNION ALL SELECT 'alerts', (SELECT count(*) FROM kept) UNION ALL SELECT 'suppressed', (SELECT count(*) FROM hits) - (SELECT count(*) FROM kept) UNION ALL SELECT 'sev_' || {_severity_sql('rule')}, count(*) FROM kept GROUP BY 1")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run, from what it has stored: events are read and rules evaluated once."""
    made, hits = alert_ops.build_with_hits(adapters.events(spark, sf_dir), RULES)
    return alert_ops.run_counts(hits, made)


_FOLD = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '/proc/\d+/', '/proc/<pid>/', 'g'), '\b[0-9a-fA-F]{{12,}}\b', '<hex>', 'g'),
 '(/tmp/|/var/tmp/|/dev/shm/)[A-Za-z0-9._-]*tmp[A-Za-z0-9._-]*', '\1<tmp>', 'g'), '([A-Za-z_-])\d{{3,}}', '\1<n>', 'g'), '(^|[^\d.])\d{{6,}}($|[^\d.])', '\1<n>\2', 'g')"""


def _signed_sql(rule: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), 'rule=' || {rule}, 'host=' || host, 'category=' || category, 'action=' || action, 'exe=' || " + _FOLD.format("exe") + ", 'cmdline=' || " + _FOLD.format("cmdline") + ", 'parent_name=' || parent_name, 'path=' || " + _FOLD.format("path") + ", 'uid=' || uid, 'remote_ip=' || remote_ip, 'remote_port=' || remote_port, 'auth_user=' || auth_user)), 1, 16)"


@query(_EV + f"SELECT seq, {_signed_sql("'r'")} AS signature FROM ev")
def alert_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    return e.select("seq", alert_ops.signature(F.lit("r"), {c: F.col(c) for c in e.columns}).alias("signature"))


_B32 = "array_to_string(list_transform(range({1}, -1, -1), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((({0}) >> (5 * i)) & 31 AS INTEGER) + 1, 1)), '')"
_ID_SQL = _B32.format("CAST(floor(ts_us / 1000) AS BIGINT)", 9) + " || " + " || ".join(_B32.format(f"CAST('0x' || substr(sha256(rule || '|' || host || '|' || seq), {at}, 10) AS BIGINT)", 7) for at in (1, 11))


@query(_HITS + f"SELECT rule, seq, {_ID_SQL} AS alert_id FROM hits")
def alert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("rule", "seq", alert_ops.alert_id(F.floor(F.col("ts_us") / 1000), F.concat_ws("|", "rule", "host", F.col("seq").cast("string"))).alias("alert_id"))


_AUDIT_SENTENCE = "CASE WHEN category = 'file' THEN 'access ' || path || ' by ' || cmdline || ' (uid=' || uid || ')' WHEN category = 'network' THEN cmdline || ' -> ' || remote_ip || ':' || remote_port || ' (uid=' || uid || ')' ELSE cmdline || ' (uid=' || uid || ')' END"


@query(_EV + f"""SELECT 'auditd' AS source, seq, {_AUDIT_SENTENCE} AS summary FROM ev
  UNION ALL SELECT 'journald', seq, CASE seq % 3 WHEN 0 THEN 'ssh ' || CASE WHEN k % 9 < 2 THEN 'invalid_user' WHEN success THEN 'success' ELSE 'failure' END || ' for ' || chr(39) || auth_user || chr(39) || ' from ' || remote_ip
    WHEN 1 THEN 'sudo ' || auth_user || ' -> root: ' || CASE WHEN k % 9 = 2 THEN '?' ELSE '/bin/ls ' || path END ELSE 'started ' || action END FROM ev""")
def alert_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What alerts would say of all audit events, and of all events as journald entries."""
    own = adapters.events(spark, sf_dir).withColumn("source", F.lit("auditd"))
    journald = journal.read_events(adapters.journal_lines(spark, sf_dir))
    return own.select("source", "seq", alert_ops.sentence(own, F.lit("")).alias("summary")).unionAll(journald.select("source", "pos", alert_ops.sentence(journald, F.lit("")).alias("summary")))


def _of_rule(rule: str, value: Callable[[Rule], str]) -> str:
    return f"CASE {rule} " + " ".join(f"WHEN '{r.name}' THEN '{value(r)}'" for r in RULES) + " END"


@query(_KEPT + f"""SELECT {_ID_SQL} AS alert_id, rule AS name, severity_of AS severity, tags, mitre, event_us, source, host, CASE WHEN source = 'journald' THEN described ELSE {_AUDIT_SENTENCE} END AS summary, exe, uid, n_shown, {_signed_sql("rule")} AS signature, match_count FROM (
  SELECT k.rule, ev.*, ev.ts_us AS event_us, {_of_rule("k.rule", lambda r: r.severity)} AS severity_of, {_of_rule("k.rule", lambda r: ",".join(r.tags))} AS tags, {_of_rule("k.rule", lambda r: ",".join(r.mitre))} AS mitre, {_of_rule("k.rule", lambda r: r.description)} AS described,
    12 + (parent_name IS NOT NULL)::BIGINT + (interactive IS NOT NULL)::BIGINT AS n_shown, CAST(k.match_count AS BIGINT) AS match_count FROM kept k JOIN ev ON ev.seq = k.seq)""")
def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alerts: the rule's fields, the sentence, the event as shown (nulls left out of its JSON) and the signature."""
    a = alert_ops.build(adapters.events(spark, sf_dir), RULES)
    shown = F.size(F.json_object_keys(F.to_json("event"))).cast("long")
    return a.select("alert_id", "rule.name", "severity", F.array_join("rule.tags", ",").alias("tags"), F.array_join("rule.mitre", ",").alias("mitre"), F.unix_micros("event_time").alias("event_us"), "source", "host", "summary", "event.exe", "event.uid", shown.alias("n_shown"), "signature", "match_count")


@query(_KEPT + """SELECT f.rule, f.seq, x.rn - f.rn + f.cnt - 1 AS at, e.ts_us, e.auth_user FROM (SELECT t.* FROM tw t JOIN kept k ON k.rule = t.rule AND k.seq = t.seq WHERE t.fired) f
  JOIN tk x ON x.rule = f.rule AND x.key = f.key AND x.rn BETWEEN f.rn - f.cnt + 1 AND f.rn JOIN ev e ON e.seq = x.seq""")
def correlated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits that made each threshold fire, as its alert lists them."""
    a = alert_ops.build(adapters.events(spark, sf_dir), RULES).where("correlated_events is not null")
    listed = a.select(F.col("rule.name").alias("rule"), "seq", F.posexplode("correlated_events").alias("at", "e"))
    return listed.select("rule", "seq", F.col("at").cast("long").alias("at"), F.unix_micros("e.ts").alias("ts_us"), "e.auth_user")


@query(_KEPT + f"SELECT {_ID_SQL} AS alert_id, rule AS name, {_severity_sql('rule')} AS severity, CAST(match_count AS BIGINT) AS match_count, auth_user FROM (SELECT k.*, ev.host, ev.auth_user FROM kept k JOIN ev ON ev.seq = k.seq)")
def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written as JSON lines to the shared folder, and read back."""
    folder, made = adapters.new_folder(spark, "alerts"), alert_ops.build(adapters.events(spark, sf_dir), RULES)
    store.write_alerts(made, folder)
    return store.read_alerts(spark, folder, made.schema).select("alert_id", "rule.name", "severity", "match_count", "event.auth_user")


@query(_EV + "SELECT category, listed, count(*) AS n FROM (SELECT category, auth_user IN (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal < 0) AS listed FROM ev) GROUP BY ALL")
def watchlist_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users on a list that is a table, as a rule tests it."""
    watched = adapters.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("name"))
    e = with_listed(adapters.events(spark, sf_dir), "listed", "auth_user", watched, "name")
    return e.groupBy("category", Fields(e.schema).truthy("listed").alias("listed")).agg(F.count("*").alias("n"))


@query(_EV + ", w AS (SELECT 'sh' || c_nationkey AS name FROM customer WHERE c_nationkey < 1) SELECT seq, true AS listed FROM ev WHERE parent_name IN (SELECT name FROM w) UNION ALL SELECT seq, false FROM ev WHERE coalesce(parent_name NOT IN (SELECT name FROM w), true)")
def watchlist_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose parent is on a list, and those whose parent is not, or is not known."""
    e, watched = adapters.events(spark, sf_dir), adapters.table(spark, sf_dir, "customer").where("c_nationkey < 1").select(F.concat(F.lit("sh"), F.col("c_nationkey").cast("string")).alias("name"))
    part = lambda negated: listed_only(e, "parent_name", watched, "name", negated).select("seq", F.lit(not negated).alias("listed"))
    return part(False).unionAll(part(True))


@query(_EV + "SELECT seq, exe AS process_path, path AS filepath, cmdline AS command_line, parent_name AS parent_process_name, priority AS log_priority FROM ev")
def aliased_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the short names of their columns."""
    return with_aliases(adapters.events(spark, sf_dir)).select("seq", "process_path", "filepath", "command_line", "parent_process_name", "log_priority")


@query(_EV + "SELECT e.seq, p.exe AS parent_exe, p.cmdline AS parent_name FROM ev e ASOF LEFT JOIN (SELECT user_id, ts, exe, cmdline FROM ev WHERE category = 'process') p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.category <> 'process'")
def parent_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_parents(_calls(spark, sf_dir)).where("action = 'other'").select("seq", "parent_exe", "parent_name")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as those of a host: programs of process 1, and what they have started."""
    e = adapters.events(spark, sf_dir)
    start = F.col("category") == "process"
    return e.select("seq", "ts", F.col("user_id").cast("string").alias("host"), F.when(start, 1).alias("pid"), F.when(~start, 1).alias("ppid"), "exe", F.col("cmdline").alias("comm"), F.when(start, "execve").otherwise("other").alias("action"))


# Sources


_AUDIT_SQL = """au AS (
  SELECT *, CASE WHEN is_file THEN path_of END AS apath FROM (SELECT CAST(seq AS VARCHAR) AS serial, *, category = 'process' AS is_run, category = 'network' AS is_net, category = 'auth' AS is_login, category IN ('file', 'kernel') AS is_file,
    CASE WHEN path LIKE '/tmp/%' THEN path ELSE '/srv/' || substr(path, 7) END AS path_of, CASE WHEN category = 'process' AND k % 4 = 0 THEN '/usr/bin/python3.11' ELSE exe END AS aexe FROM ev))"""
_AUDIT_ROWS = """SELECT serial, host, CASE WHEN is_run THEN 'execve' WHEN is_net THEN 'connect' WHEN is_login THEN 'user_login' ELSE 'openat' END AS action, CASE WHEN is_run THEN 'process' WHEN is_net THEN 'network' WHEN is_login THEN 'auth' ELSE 'file' END AS category,
  CASE WHEN is_login THEN k % 3 <> 0 ELSE success END AS success, CASE WHEN NOT is_login THEN uid END AS uid, CASE WHEN NOT is_login THEN true END AS is_root, CASE WHEN NOT is_login THEN uid <> 0 END AS priv_escalated, CASE WHEN NOT is_login THEN NOT is_root END AS auid_set,
  CASE WHEN NOT is_login THEN coalesce(interactive, false) END AS interactive, CASE WHEN NOT is_login THEN auth_user END AS user, CASE WHEN NOT is_login THEN 'k1' END AS key,
  CASE WHEN is_run THEN CASE k % 4 WHEN 0 THEN 'python3.11 /opt/run-' || k || '.py' WHEN 1 THEN 'tool part-' || seq || ' x"y' ELSE 'tool --id ' || seq || ' x"y' END WHEN NOT is_login THEN exe END AS cmdline, CASE WHEN is_run THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 3 END END AS argc,
  CASE WHEN NOT is_login THEN split_part(aexe, '/', -1) END AS exe_name, CASE WHEN NOT is_login THEN regexp_replace(aexe, '/[^/]*$', '') END AS exe_dir, CASE WHEN is_run AND k % 4 = 0 THEN 'python3.11' END AS interpreter, CASE WHEN is_run AND k % 4 = 0 THEN true END AS is_script,
  apath AS path, CASE WHEN is_file THEN 1 + (k % 5 = 0)::INT END AS n_paths, CASE WHEN is_file THEN CASE WHEN k % 5 = 0 THEN 'CREATE' ELSE 'NORMAL' END END AS nametype, split_part(apath, '/', -1) AS file_name, regexp_replace(apath, '/[^/]*$', '') AS file_dir, CASE WHEN apath LIKE '%.sh' THEN 'sh' END AS file_ext,
  CASE WHEN is_file THEN k % 7 = 0 END AS is_setuid, CASE WHEN is_file THEN k % 2 = 0 WHEN NOT is_login THEN false END AS is_write, CASE WHEN is_net AND k % 6 = 0 THEN 'fd00::' || format('{:x}', k + 1) WHEN is_net OR is_login THEN remote_ip END AS remote_ip,
  CASE WHEN is_net THEN remote_port END AS remote_port, CASE WHEN is_net THEN CASE WHEN k % 6 = 0 THEN 'inet6' ELSE 'inet' END END AS addr_family, CASE WHEN is_login THEN auth_user END AS auth_user, CASE WHEN is_login THEN CASE WHEN k % 3 = 0 THEN 'failure' ELSE 'success' END END AS auth_result,
  CASE WHEN is_login THEN 'ssh' WHEN interactive THEN 'pts0' ELSE '(none)' END AS tty FROM au"""
_AUDIT_COLUMNS = ("serial", "host", "action", "category", "success", "uid", "is_root", "priv_escalated", "auid_set", "interactive", "user", "key", "cmdline", "argc", "exe_name", "exe_dir", "interpreter", "is_script", "path", "nametype", "file_name", "file_dir", "file_ext", "is_setuid", "is_write", "remote_ip", "remote_port", "addr_family", "auth_user", "auth_result", "tty")


@query(f"WITH {EVENTS_SQL}, {_AUDIT_SQL} {_AUDIT_ROWS}")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit text of all events, read back: records, events and canonical columns. The SQL knows only the events."""
    found = audit.read_events(adapters.audit_lines(spark, sf_dir))
    return found.select(*_AUDIT_COLUMNS, F.size("paths").alias("n_paths"))


_JOURNAL_ROWS = """SELECT seq AS pos, host, ts_us, CASE seq % 3 WHEN 2 THEN 'service' ELSE 'auth' END AS category, CASE seq % 3 WHEN 0 THEN 'ssh_login' WHEN 1 THEN 'sudo' ELSE 'log' END AS action, CASE WHEN seq % 3 < 2 THEN auth_user END AS auth_user,
  CASE seq % 3 WHEN 0 THEN CASE WHEN k % 9 < 2 THEN 'invalid_user' WHEN success THEN 'success' ELSE 'failure' END WHEN 1 THEN CASE WHEN k % 9 = 2 THEN 'failure' ELSE 'success' END END AS auth_result,
  CASE seq % 3 WHEN 0 THEN CASE WHEN k % 9 = 1 THEN false ELSE success END WHEN 1 THEN k % 9 <> 2 END AS success, CASE WHEN seq % 3 = 0 AND k % 9 <> 1 THEN 'password' END AS auth_method, CASE WHEN seq % 3 = 0 THEN remote_ip END AS remote_ip, CASE WHEN seq % 3 = 0 AND k % 9 <> 1 THEN remote_port END AS remote_port,
  CASE WHEN seq % 3 = 1 AND k % 9 <> 2 THEN '/bin/ls ' || path END AS sudo_command, CASE WHEN seq % 3 = 1 AND k % 9 <> 2 THEN 'root' END AS sudo_target_user, CASE WHEN seq % 3 = 2 THEN 'app' END AS service, priority, ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'][priority + 1] AS priority_label, priority <= 3 AS is_error, uid,
  CASE seq % 3 WHEN 0 THEN 'sshd' WHEN 1 THEN 'sudo' ELSE 'app' END AS comm, CASE seq % 3 WHEN 0 THEN 'sshd' WHEN 1 THEN 'sudo' ELSE 'app' END AS exe_name, CASE WHEN seq % 3 = 2 THEN 'app --seq ' || seq WHEN seq % 3 = 1 AND k % 9 <> 2 THEN '/bin/ls ' || path END AS cmdline,
  CASE WHEN seq % 3 = 2 THEN 'started ' || action WHEN seq % 3 = 1 THEN CASE WHEN k % 9 = 2 THEN auth_user || ' : 3 incorrect password attempts' ELSE auth_user || ' : TTY=pts/0 ; PWD=/srv ; USER=root ; COMMAND=/bin/ls ' || path END
    WHEN k % 9 = 1 THEN 'Invalid user ' || auth_user || ' from ' || remote_ip || ' port ' || remote_port ELSE CASE WHEN success THEN 'Accepted' ELSE 'Failed' END || ' password for ' || CASE WHEN k % 9 = 0 THEN 'invalid user ' ELSE '' END || auth_user || ' from ' || remote_ip || ' port ' || remote_port || ' ssh2' END AS message FROM ev"""


@query(_EV + _JOURNAL_ROWS)
def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = journal.read_events(adapters.journal_lines(spark, sf_dir))
    return found.select(
        "pos", "host", F.unix_micros("ts").alias("ts_us"), "category", "action", "auth_user", "auth_result", "success", "auth_method", "remote_ip", "remote_port", "sudo_command", "sudo_target_user", "service", "priority", "priority_label", "is_error", "uid", "comm", "exe_name", "cmdline", "message"
    )


def _stored_lines(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Globs of files of audit lines and of journald lines that were written to the shared folder."""
    return _written_lines(spark, "audit", adapters.audit_lines(spark, sf_dir)), _written_lines(spark, "journal", adapters.journal_lines(spark, sf_dir))


def _written_lines(spark: SparkSession, kind: str, lines: DataFrame) -> str:
    """A glob of the files of lines in the shared folder."""
    folder = adapters.new_folder(spark, "lines")
    lines.select("value").write.text(f"{folder}/{kind}/a")
    return f"{folder}/{kind}/*/part-*"


@query(f"WITH {EVENTS_SQL}, {_AUDIT_SQL} SELECT 'auditd' AS source, host, action, category, success, cmdline, path, remote_ip FROM ({_AUDIT_ROWS}) UNION ALL SELECT 'journald', host, action, category, success, cmdline, NULL, remote_ip FROM ({_JOURNAL_ROWS})")
def stored_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered feeds read from text files, in one schema; a third without paths is left out."""
    lines, entries = _stored_lines(spark, sf_dir)
    known = feeds.Feeds()
    known.register("auditd", lambda s, paths: audit.read_events(feeds.text_lines(s, paths)))
    known.register("journald", lambda s, paths: journal.read_events(feeds.text_lines(s, paths)))
    known.register("web", lambda s, paths: feeds.read_events(feeds.text_lines(s, paths), WEB, now=0.0))
    return known.read(spark, {"auditd": [lines], "journald": [entries], "web": []}).select("source", "host", "action", "category", "success", "cmdline", "path", "remote_ip")


def _raw_alerts(spark: SparkSession, lines: str, entries: str) -> DataFrame:
    """From lines of both feeds to alerts. Parsed events are written once, as parents and rules read them more than once."""
    known = feeds.Feeds()
    known.register("auditd", lambda s, paths: audit.read_events(feeds.numbered_lines(s, paths, "auditd")))
    known.register("journald", lambda s, paths: journal.read_events(feeds.numbered_lines(s, paths, "journald")))
    if unknown := known.unknown([f for r in RAW_RULES for f in r.feeds]):
        raise ValueError(f"rules name feeds that are not there: {unknown}")
    events = stored(known.read(spark, {"auditd": [lines], "journald": [entries]}), "events")
    return alert_ops.build(enrich.with_parents(events), RAW_RULES)


@query(f"WITH RECURSIVE {EVENTS_SQL}, {_AUDIT_SQL}, {RAW_HITS_SQL}, {HELD_SQL} SELECT rule, source, host, ts_us AS event_us, CAST(match_count AS BIGINT) AS match_count FROM kept")
def raw_to_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection from text files: lines of two feeds, events, their parents, rules, thresholds, throttles and alerts. The SQL knows only the events."""
    made = _raw_alerts(spark, *_stored_lines(spark, sf_dir))
    return made.select(F.col("rule.name").alias("rule"), "source", "host", F.unix_micros("event_time").alias("event_us"), "match_count")


WEB = feeds.FeedSpec(
    name="web", category="web", action="request", timestamp_field="ts", types={"http_status": "int", "bytes_sent": "int"}, message_field="http_path",
    pattern=r'^(?P<remote_ip>\S+) \S+ (?P<auth_user>\S+) \[(?P<ts>[^\]]+)\] "(?P<http_method>\S+) (?P<http_path>[^ ?]+)(?:\?(?P<http_query>\S*))? HTTP/(?P<http_version>[^"]+)" (?P<http_status>\d+) (?P<bytes_sent>\S+) "(?P<referer>[^"]*)" "(?P<user_agent>[^"]*)"', field_map={"auth_user": ""},
)


@query("SELECT page_id AS pos, '10.1.0.' || (page_id % 250) AS remote_ip, '/p/' || page_id AS http_path, CASE WHEN page_id % 2 = 0 THEN 'q=1' END AS http_query, CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS http_status, CASE WHEN page_id % 7 <> 0 THEN page_id * 3 END AS bytes_sent, 1707127200.0 + page_id % 60 AS epoch, '/p/' || page_id AS message FROM pages")
def web_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.read_events(adapters.web_lines(spark, sf_dir), WEB, now=0.0)
    return found.select("pos", "remote_ip", "http_path", "http_query", "http_status", "bytes_sent", "epoch", "message")


ORDERS = feeds.FeedSpec(
    name="orders", format="json", json_fields=("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_urgent", "o_note"), field_map={"o_orderstatus": "outcome", "o_orderkey": "event_id", "o_totalprice": "request_time", "o_urgent": "is_warning", "o_note": ""},
    types={"request_time": "float", "o_urgent": "bool", "event_id": "str"}, timestamp_field="o_orderdate", static={"host": "shop", "outcome": "none"},
)
_ORDER_LINE = """'{"o_orderkey":' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"o_orderstatus":"' || o_orderstatus || '"' END || ',"o_totalprice":"' || CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_urgent":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END || '","o_note":"' || repeat('x', 350) || '"}'"""


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS outcome, 'shop' AS host, 'log' AS category, CAST(epoch(o_orderdate) AS DOUBLE) AS epoch, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS request_time, o_orderkey % 2 = 0 AS is_warning, substr({_ORDER_LINE}, 1, 400) AS message, substr({_ORDER_LINE}, 1, 200) AS message_snippet FROM orders")
def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines: renamed, typed, dropped and constant fields; without a message field the line, cut short, is the message."""
    o = adapters.table(spark, sf_dir, "orders")
    entry = F.struct(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("o_urgent"), F.lit("x" * 350).alias("o_note"),
    )
    lines = o.select(F.to_json(entry).alias("value"), F.col("o_orderkey").alias("pos"))
    return feeds.read_events(lines, ORDERS, now=0.0).select("event_id", "outcome", "host", "category", "epoch", "request_time", "is_warning", "message", "message_snippet")


@query(_EV + "SELECT source, category, count(*) AS n FROM (SELECT 'auditd' AS source, CASE WHEN category IN ('process', 'network', 'auth') THEN category ELSE 'file' END AS category FROM ev UNION ALL SELECT 'journald', CASE seq % 3 WHEN 2 THEN 'service' ELSE 'auth' END FROM ev UNION ALL SELECT 'web', 'web' FROM pages) GROUP BY ALL")
def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds in one schema; only the columns that are asked for are made."""
    every = feeds.union_feeds([audit.read_events(adapters.audit_lines(spark, sf_dir)), journal.read_events(adapters.journal_lines(spark, sf_dir)), feeds.read_events(adapters.web_lines(spark, sf_dir), WEB, now=0.0)])
    return every.groupBy("source", "category").agg(F.count("*").alias("n"))


# Streams


@query(f"WITH {EVENTS_SQL}, {_AUDIT_SQL} SELECT serial, host, action, category, success, cmdline, path, n_paths, nametype, auth_user FROM ({_AUDIT_ROWS})")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines in files, read and assembled as a stream to its end; what it wrote."""
    folder, lines = adapters.new_folder(spark, "stream"), _written_lines(spark, "audit", adapters.audit_lines(spark, sf_dir))
    found = assembly.event_stream(sinks.line_stream(spark, lines)).select("serial", "host", "action", "category", "success", "cmdline", "path", F.size("paths").alias("n_paths"), "nametype", "auth_user")
    with _state_store(spark):
        sinks.write_alerts(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as those with lists and timers have to."""
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def _steps(spark: SparkSession, steps: list[DataFrame], through: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """What a stream makes of rows that come in steps: it stops after each and goes on from its checkpoint, by the plan of the next step's number. Also what it has dropped as late in each step."""
    folder, late = adapters.new_folder(spark, "stream"), []
    with _state_store(spark):
        for n, more in enumerate(steps):
            more.write.mode("append").parquet(f"{folder}/in")
            made = sinks.write_alerts(through(spark.readStream.schema(more.schema).parquet(f"{folder}/in"), n), f"{folder}/out", f"{folder}/state")
            made.awaitTermination()
            late.append(sinks.late_rows(made))
    return spark.read.parquet(f"{folder}/out"), late


def _in_steps(spark: SparkSession, steps: list[DataFrame], through: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    found, late = _steps(spark, steps, lambda stream, _: through(stream))
    return found.where("rule <> 'the end'"), late


@query(SQL["streamed_events"])
def streamed_quiet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines of which half the events have no end marker, and whose records come interleaved in two steps each, with a stop between: they are out when they have been quiet."""
    lines = adapters.audit_lines(spark, sf_dir)
    ended = F.col("value").contains(" type=EOE ")
    lines = stored(lines.where(~ended | (F.floor(F.col("pos") / 8) % 2 == 0)).withColumns({"later": ended | (F.col("pos") % 2 == 1), "at": F.regexp_extract("value", r"audit\((\d+)", 1).cast("long")}), "lines")
    first, last = lines.agg(F.min("at"), F.max("at")).first()
    half = (first + last) // 2
    part = lambda now, later: lines.where((F.col("at") < half) == F.lit(now)).where(F.col("later") == F.lit(later)).drop("later", "at")
    end = spark.createDataFrame([("node=end type=SYSCALL msg=audit(4070908800.000:0): syscall=1", 0, "events")], lines.drop("later", "at").schema)
    # Lines of one half of the time wait for the rest of their events through the step between.
    delay = f"{last - half + 1} seconds"
    found, _ = _steps(spark, [part(True, False), part(True, True).unionByName(part(False, False)), part(False, True), end], lambda stream, _: assembly.event_stream(stream, delay=delay))
    return found.select("serial", "host", "action", "category", "success", "cmdline", "path", F.size("paths").alias("n_paths"), "nametype", "auth_user")


def _the_end(rows: DataFrame) -> DataFrame:
    """A row of a later year, which makes the last ones ready."""
    return rows.limit(1).withColumns({"rule": F.lit("the end"), "ts": F.lit("2099-01-01").cast("timestamp")})


def _counted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, rules = _hits(spark, sf_dir), [r for r in active(RULES) if r.threshold]
    return hits.where(F.col("rule").isin([r.name for r in rules])).select("rule", by_rule(rules, lambda r: r.threshold.by, lambda names: key_of(hits, names)).cast("string").alias("key"), "ts", "seq", by_rule(rules, lambda r: r.threshold.count).cast("int").alias("count"), by_rule(rules, lambda r: int(r.threshold.window_s * 1e6)).cast("long").alias("window_us"))


@query(_FIRED + "SELECT rule, key, seq, match_count FROM fired")
def streamed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over a stream of hits that stops and goes on from its checkpoint."""
    own = stored(_counted_hits(spark, sf_dir), "hits")
    found, _ = _in_steps(spark, [own, _the_end(own)], lambda stream: suppression.suppress_stream(stream, "threshold"))
    return found.select("rule", "key", "seq", F.col("match_count").cast("int").alias("match_count"))


@query(_KEPT + "SELECT rule, seq, CAST(match_count AS BIGINT) AS match_count FROM kept")
def streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and then throttles in one stream of the hits of all rules, with a restart in the middle of the time."""
    hits, rules = _hits(spark, sf_dir), active(RULES)
    own = stored(hits.select("rule", "ts", "seq", *[c.alias(n) for n, c in alert_ops.keyed(hits, rules).items()]), "hits")
    first, last = own.agg(F.min("ts"), F.max("ts")).first()
    half = first + (last - first) / 2
    return _in_steps(spark, [own.where(F.col("ts") < half), own.where(F.col("ts") >= half), _the_end(own)], suppression.passing_stream)[0].select("rule", "seq", "match_count")


@query(SQL["parent_processes"])
def streamed_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of a stream of events that stops in the middle of the time and goes on from its checkpoint."""
    own = _calls(spark, sf_dir).withColumn("rule", F.lit(""))
    first, last = own.agg(F.min("ts"), F.max("ts")).first()
    half = first + (last - first) / 2
    found, _ = _in_steps(spark, [own.where(F.col("ts") < half), own.where(F.col("ts") >= half), _the_end(own)], parents.parents_stream)
    return found.where("action = 'other'").select("seq", "parent_exe", "parent_name")


@query(_HITS + ", own AS (SELECT * FROM hits WHERE rule IN ('failures of a user', 'signups together', 'burst of errors')) SELECT count(*) AS sent, count_if(ts_us <= ((SELECT max(ts_us) FROM own) // 1000 - 600000) * 1000) AS dropped FROM own WHERE seq % 7 = 0")
def streamed_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that are sent once more after all others: those behind the watermark are dropped, and counted."""
    own = stored(_counted_hits(spark, sf_dir), "hits")
    again = own.where("seq % 7 = 0")
    _, late = _in_steps(spark, [own, again], lambda stream: suppression.suppress_stream(stream, "threshold"))
    dropped = late[-1].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]  # one number
    return again.agg(F.count("*").alias("sent"), F.lit(dropped).alias("dropped"))


# Of the rules below, what changes in the middle of the time: one is gone, one counts otherwise, one waits longer.
_RENEWED = [replace(r, threshold=Threshold(6, 3 * HOUR)) if r.name == "burst of errors" else replace(r, throttle_s=2 * HOUR) if r.name == "journal urgent" else r for r in RULES if r.name != "failures of a user"]
_RENEWED_SQL = """cut AS (SELECT min(ts_us) + (max(ts_us) - min(ts_us)) // 2 AS middle FROM ev),
hits AS (
  SELECT CASE WHEN late AND rule IN ('burst of errors', 'journal urgent') THEN rule || '@' ELSE rule END AS rule, seq, ts_us, source, host,
    CASE rule WHEN 'failures of a user' THEN auth_user WHEN 'signups together' THEN host WHEN 'burst of errors' THEN '*' END AS gkey, CASE rule WHEN 'failures of a user' THEN 3 WHEN 'signups together' THEN 5 WHEN 'burst of errors' THEN CASE WHEN late THEN 6 ELSE 10 END END AS cnt,
    CASE rule WHEN 'failures of a user' THEN 86400000000 WHEN 'signups together' THEN 21600000000 WHEN 'burst of errors' THEN CASE WHEN late THEN 10800000000 ELSE 5400000000 END END AS win,
    CASE rule WHEN 'signups together' THEN host WHEN 'purchases of a user' THEN auth_user WHEN 'journal urgent' THEN host || '|' || action END AS dkey,
    CASE rule WHEN 'signups together' THEN 43200000000 WHEN 'purchases of a user' THEN 172800000000 WHEN 'journal urgent' THEN CASE WHEN late THEN 7200000000 ELSE 3600000000 END END AS wait
  FROM (SELECT *, NULL AS source, ts_us >= middle AS late FROM found, cut) WHERE NOT (late AND rule = 'failures of a user'))"""


@query(f"WITH RECURSIVE {EVENTS_SQL}, {HITS_SQL.replace('hits AS', 'found AS')}, {_RENEWED_SQL}, {HELD_SQL} SELECT rtrim(rule, '@') AS rule, seq, CAST(match_count AS BIGINT) AS match_count FROM kept")
def streamed_renewed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events with all rules that stops in the middle of the time, and goes on from its checkpoint with other rules: those that have not changed go on with what they have counted."""
    own = adapters.events(spark, sf_dir)
    first, last = own.agg(F.min("ts"), F.max("ts")).first()
    half = first + (last - first) // 2
    end = own.limit(1).withColumns({"ts": F.lit("2099-01-01").cast("timestamp"), "seq": F.lit(-1).cast("long")})
    found, _ = _steps(spark, [own.where(F.col("ts") < half), own.where(F.col("ts") >= half), end], lambda stream, n: renewal.rules_stream(stream, RULES if n == 0 else _RENEWED))
    return found.where("seq >= 0").select("rule", "seq", "match_count")


_INDEX_STEPS = """, st AS (SELECT n.n AS step, jr.* FROM jr, (VALUES (0), (1), (2)) n(n) WHERE jr.note <= 'n' || n.n),
last AS (SELECT *, min(pos) OVER (PARTITION BY step, alert_id) AS first_pos FROM st QUALIFY row_number() OVER (PARTITION BY step, alert_id ORDER BY pos DESC) = 1)
SELECT step, signature, verdict, alert_id FROM (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY step, signature ORDER BY updated_at DESC, first_pos DESC) = 1)""" + f" WHERE verdict IN {_CLOSED}"


@query(_JR + _INDEX_STEPS)
def streamed_signature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of signatures after each of three appends to the journal, by a stream that reads the new lines only and goes on from its checkpoint."""
    folder, lines, found = adapters.new_folder(spark, "index"), adapters.journal(spark, sf_dir), []
    with _state_store(spark):
        for step in range(3):
            store.append_journal(lines.where(F.col("note") == f"n{step}").drop("pos"), f"{folder}/journal")
            sinks.write_alerts(signatures.index_changes(signatures.journal_stream(spark, f"{folder}/journal")), f"{folder}/changes", f"{folder}/state").awaitTermination()
            # Written at once: Spark takes later readings of the same folder for the same table.
            found.append(stored(signatures.index_of(spark.read.parquet(f"{folder}/changes")).select(F.lit(step).alias("step"), "signature", "verdict", "alert_id"), "index"))
    return found[0].unionAll(found[1]).unionAll(found[2])


# Verdicts


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.latest(adapters.journal(spark, sf_dir))


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.effective(adapters.alerts(spark, sf_dir), _latest(spark, sf_dir))


@query(_JR + "SELECT alert_id, verdict, note, analyst, rule, signature, updated_at, pos, first_pos FROM lt")
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


@query(_JR + "SELECT alert_id, pos, verdict, updated_at, revision FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY pos) AS revision, lead(pos) OVER (PARTITION BY alert_id ORDER BY pos) AS nx FROM jr) WHERE nx IS NOT NULL")
def verdict_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.history(adapters.journal(spark, sf_dir))


@query(_JR + "SELECT signature, verdict, alert_id FROM ix")
def signature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.signature_index(_latest(spark, sf_dir))


@query(_JR + "SELECT v.verdict, count(lt.alert_id) AS n FROM (VALUES ('open'), ('in_progress'), ('true_positive'), ('benign_positive'), ('false_positive'), ('duplicate')) v(verdict) LEFT JOIN lt USING (verdict) GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdict_counts(_latest(spark, sf_dir))


@query(_JR + "SELECT rule, " + ", ".join(f"count_if(verdict = '{v}') AS {v}" for v in verdicts.VERDICTS) + " FROM lt GROUP BY rule")
def rule_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.rule_tallies(_latest(spark, sf_dir))


_PRECISION = ", t AS (SELECT rule, count_if(verdict = 'true_positive') AS true_positive, count_if(verdict = 'benign_positive') AS benign_positive, count_if(verdict = 'false_positive') AS false_positive FROM lt GROUP BY rule) SELECT t.rule, coalesce(f.fired, 0) AS fired, true_positive, benign_positive, false_positive, (true_positive + benign_positive) / (true_positive + benign_positive + false_positive) AS precision FROM t LEFT JOIN (SELECT rule, count(*) AS fired FROM al GROUP BY rule) f USING (rule) WHERE true_positive + benign_positive + false_positive > 0 ORDER BY precision, rule LIMIT 12"


@query(_JR + _PRECISION)
def rule_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.precision(_latest(spark, sf_dir), adapters.alerts(spark, sf_dir))


@query(_EFF + "SELECT alert_id, effective_verdict, inherited FROM ef")
def effective_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective(spark, sf_dir).select("alert_id", "effective_verdict", "inherited")


@query(_JR + "SELECT al.alert_id, ix.verdict AS prior_verdict FROM al LEFT JOIN ix ON ix.signature = al.signature WHERE ix.verdict IS DISTINCT FROM 'false_positive'")
def known_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.annotate(adapters.alerts(spark, sf_dir), _latest(spark, sf_dir), drop_false_positives=True).select("alert_id", "prior_verdict")


def _scope_sql(scope: str, chosen: str) -> str:
    return _JR + f"SELECT DISTINCT al.alert_id, al.{scope} FROM al LEFT JOIN lt USING (alert_id) WHERE {chosen} OR al.{scope} IN (SELECT {scope} FROM al WHERE {chosen}) AND coalesce(lt.verdict NOT IN {_CLOSED}, true)"


@query(_scope_sql("signature", "al.severity = 'critical' AND al.rule = 'rule_src1'"))
def bulk_verdict_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verdict on all critical alerts of a rule covers by their signatures."""
    a = adapters.alerts(spark, sf_dir)
    return verdicts.in_scope(a, _latest(spark, sf_dir), a.where("severity = 'critical' and rule = 'rule_src1'").select("alert_id"), "signature").select("alert_id", "signature")


@query(_scope_sql("rule", "al.severity = 'critical' AND al.rule IN ('rule_src1', 'rule_src2')"))
def rule_verdict_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verdict on the critical alerts of two rules covers by their rules."""
    a = adapters.alerts(spark, sf_dir)
    return verdicts.in_scope(a, _latest(spark, sf_dir), a.where("severity = 'critical' and rule in ('rule_src1', 'rule_src2')").select("alert_id"), "rule").select("alert_id", "rule")


@query(_JR + "SELECT signature, verdict, alert_id FROM ix WHERE verdict IN ('true_positive', 'benign_positive')")
def chosen_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.known_signatures(_latest(spark, sf_dir), ("true_positive", "benign_positive"))


@query(_JR + "SELECT alert_id, verdict, updated_at, row_number() OVER (ORDER BY updated_at DESC, alert_id) AS place FROM lt")
def newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, the newest first; place is where a record is in that order."""
    listed = verdicts.newest_first(_latest(spark, sf_dir)).select("alert_id", "verdict", "updated_at")
    return adapters.with_place(listed)


@query(_AL + "SELECT alert_id, CASE WHEN seq % 5 = 0 THEN substr(sha256(concat_ws(chr(31), 'rule=' || rule, 'host=' || host, 'exe=' || exe, 'path=' || path)), 1, 16) ELSE signature END AS signature FROM al")
def recomputed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of which a fifth has no signature, or an empty one: those get it anew."""
    old = F.when(F.col("seq") % 10 == 0, "").when(F.col("seq") % 5 != 0, F.col("signature"))
    return alert_ops.signed(adapters.alerts(spark, sf_dir).withColumn("signature", old)).select("alert_id", "signature")


@query(_JR + "SELECT alert_id, verdict, note, analyst, updated_at FROM lt")
def stored_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's lines appended to files in three steps, and read back: the last line of each alert."""
    folder, lines = adapters.new_folder(spark, "journal"), adapters.journal(spark, sf_dir)
    for step in range(3):
        store.append_journal(lines.where(F.col("note") == f"n{step}").drop("pos"), folder)
    return verdicts.latest(store.load_journal(spark, folder)).select("alert_id", "verdict", "note", "analyst", "updated_at")


@query(_EFF + "SELECT 'alerts' AS metric, count_if(p IS DISTINCT FROM 'false_positive') AS n FROM (SELECT al.*, ix.verdict AS p FROM al LEFT JOIN ix ON ix.signature = al.signature) UNION ALL SELECT 'matches', count(*) FROM al UNION ALL SELECT 'suppressed', 0"
       " UNION ALL SELECT 'known', count(*) FROM al JOIN ix ON ix.signature = al.signature UNION ALL SELECT 'known_dropped', count(*) FROM al JOIN ix ON ix.signature = al.signature WHERE ix.verdict = 'false_positive' UNION ALL SELECT 'known_' || ix.verdict, count(*) FROM al JOIN ix ON ix.signature = al.signature GROUP BY 1"
       " UNION ALL SELECT 'sev_' || al.severity, count(*) FROM al LEFT JOIN ix ON ix.signature = al.signature WHERE ix.verdict IS DISTINCT FROM 'false_positive' GROUP BY 1")
def known_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run that drops repeats of false positives."""
    a = adapters.alerts(spark, sf_dir)
    return alert_ops.run_counts(a, verdicts.annotate(a, _latest(spark, sf_dir)), drop_false_positives=True)


@query(_JR + "SELECT al.alert_id, 'duplicate' AS verdict, coalesce(lt.rule, '') AS rule, coalesce(lt.signature, '') AS signature, '2024-06-01T00:00:00' AS updated_at FROM al LEFT JOIN lt USING (alert_id) WHERE al.severity = 'high'")
def journal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = adapters.alerts(spark, sf_dir).where("severity = 'high'").select("alert_id", F.lit("Dup").alias("verdict"), F.lit("n").alias("note"), F.lit("a").alias("analyst"), F.lit("").alias("rule"), F.lit("").alias("signature"))
    return verdicts.records(new, _latest(spark, sf_dir), F.lit("2024-06-01T00:00:00")).select("alert_id", "verdict", "rule", "signature", "updated_at")


@query(_JR + "SELECT rule, field, value, count(*) AS n FROM (SELECT al.rule, unnest(CASE WHEN lt.verdict = 'false_positive' THEN ['exe', 'path'] ELSE ['exe'] END) AS field, unnest(CASE WHEN lt.verdict = 'false_positive' THEN [exe, path] ELSE [exe] END) AS value FROM al JOIN lt USING (alert_id) WHERE lt.verdict IN ('false_positive', 'benign_positive')) WHERE value IS NOT NULL GROUP BY ALL")
def exclusion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.exclusions(adapters.alerts(spark, sf_dir), _latest(spark, sf_dir))


@query(_JR + "SELECT al.alert_id, lt.verdict AS triage_verdict, lt.updated_at AS triage_time FROM al LEFT JOIN lt USING (alert_id)")
def alert_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.export(adapters.alerts(spark, sf_dir), _latest(spark, sf_dir)).select("alert_id", F.col("triage.verdict").alias("triage_verdict"), F.col("triage.updated_at").alias("triage_time"))


# Reports


@query(_AL + "SELECT severity, count(*) AS n FROM al GROUP BY severity")
def alerts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_severity(adapters.alerts(spark, sf_dir))


@query(_AL + "SELECT rule, count(*) AS n FROM al GROUP BY rule ORDER BY n DESC, rule LIMIT 10")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_rules(adapters.alerts(spark, sf_dir))


@query(_AL + "SELECT alert_id, severity FROM al ORDER BY alert_id DESC LIMIT 25")
def newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(adapters.alerts(spark, sf_dir), 25).select("alert_id", "severity")


@query(_EFF + f"SELECT alert_id, severity, effective_verdict FROM ef WHERE effective_verdict NOT IN {_CLOSED} AND severity IN ('high', 'critical') ORDER BY alert_id DESC LIMIT 50")
def open_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_queue(_effective(spark, sf_dir), "high", 50).select("alert_id", "severity", "effective_verdict")


@query(_EFF + "SELECT alert_id FROM ef WHERE inherited")
def inherited_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_status(_effective(spark, sf_dir), "inherited").select("alert_id")


@query(_AL + "SELECT alert_id FROM al WHERE list_contains(tags, 'src1')")
def alerts_with_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_tag(adapters.alerts(spark, sf_dir), "src1").select("alert_id")


@query(_AL + "SELECT alert_id FROM al WHERE host = 'h3'")
def alerts_of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.of_host(adapters.alerts(spark, sf_dir), "h3").select("alert_id")


@query(_AL + "SELECT alert_id FROM al WHERE path LIKE '/data/7%' AND contains(rule, 'src1')")
def grep_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grep(reports.rule_contains(adapters.alerts(spark, sf_dir), "SRC1"), '"/DATA/7').select("alert_id")


@query(_AL + "SELECT alert_id FROM al WHERE ends_with(alert_id, '000017') ORDER BY alert_id LIMIT 2")
def find_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.find(adapters.alerts(spark, sf_dir), "000017").select("alert_id")


@query(_JR + f"SELECT count(*) AS alerts, count_if(coalesce(verdict NOT IN {_CLOSED}, true)) AS open, count_if(coalesce(verdict NOT IN {_CLOSED}, true) AND severity IN ('high', 'critical')) AS open_urgent, count_if(verdict IS NULL) AS untriaged FROM (SELECT al.severity, lt.verdict FROM al LEFT JOIN lt USING (alert_id))")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(adapters.alerts(spark, sf_dir), _latest(spark, sf_dir))
