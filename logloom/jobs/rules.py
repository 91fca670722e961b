"""Rules for the adapted events: one at least for each kind of predicate and of directive."""

from __future__ import annotations

from logloom.operators.detect import Rule, Threshold

HOUR = 3600.0
QUIET = ["u3", "u7", "u11"]

RULES = [
    Rule("root file in tmp", "high", lambda f: [f.equal("category", "file"), f.equal("is_root", True), f.starts_with("path", "/tmp/")], "root touched a temporary script", tags=("files",)),
    Rule("odd port", "medium", lambda f: [f.equal("category", "network"), f.at_least("remote_port", 1090), f.not_in("auth_user", QUIET)], "a connection to a high port", tags=("network",), mitre=("T1571",)),
    Rule("parent is not a shell", "low", lambda f: [f.equal("category", "process"), f.not_equal("parent_name", "sh1")], "a program of an unusual parent"),
    Rule("parent unknown", "info", lambda f: [f.equal("category", "process"), f.missing("parent_name")], "a program without a known parent"),
    Rule("mode two", "low", lambda f: [f.matches("cmdline", r"--mode 2\b"), ~f.contains("path", ["view", "click"]), f.truthy("interactive")], "mode two by hand"),
    Rule("failures of a user", "critical", lambda f: [f.equal("success", False)], "three failures in a day", feeds=("auditd",), threshold=Threshold(3, 24 * HOUR, ("auth_user",))),
    Rule("signups together", "high", lambda f: [f.equal("action", "signup")], "five signups of a host in six hours", threshold=Threshold(5, 6 * HOUR, ("host",)), throttle_s=12 * HOUR, dedup_by=("host",)),
    Rule("burst of errors", "critical", lambda f: [f.equal("action", "error"), f.less("priority", 4)], "forty urgent errors in an hour and a half anywhere", threshold=Threshold(10, 1.5 * HOUR)),
    Rule("purchases of a user", "medium", lambda f: [f.is_in("action", ["purchase", "refund"])], "at most one alert of a user in two days", throttle_s=48 * HOUR, dedup_by=("auth_user",)),
    Rule("journal urgent", "high", lambda f: [f.at_most("priority", 1), f.present("interactive")], "an urgent entry", feeds=("journald",), throttle_s=HOUR, dedup_by=("host", "action")),
    Rule("not used", "critical", lambda f: [f.present("action")], "switched off", enabled=False),
]

#: What the rules match, in SQL over ev (see adapters).
HITS_SQL = """hits AS (
  SELECT seq, ts_us, rule, host, auth_user, action, category, path, cmdline, exe, uid, remote_ip, parent_name, remote_port FROM (
    SELECT *, unnest([
      CASE WHEN category = 'file' AND is_root AND path LIKE '/tmp/%' THEN 'root file in tmp' END,
      CASE WHEN category = 'network' AND remote_port >= 1090 AND coalesce(auth_user NOT IN ('u3', 'u7', 'u11'), true) THEN 'odd port' END,
      CASE WHEN category = 'process' AND parent_name <> 'sh1' THEN 'parent is not a shell' END,
      CASE WHEN category = 'process' AND parent_name IS NULL THEN 'parent unknown' END,
      CASE WHEN regexp_matches(cmdline, '--mode 2\\b') AND NOT (contains(path, 'view') OR contains(path, 'click')) AND coalesce(interactive, false) THEN 'mode two' END,
      CASE WHEN NOT success AND source = 'auditd' THEN 'failures of a user' END,
      CASE WHEN action = 'signup' THEN 'signups together' END,
      CASE WHEN action = 'error' AND priority < 4 THEN 'burst of errors' END,
      CASE WHEN action IN ('purchase', 'refund') THEN 'purchases of a user' END,
      CASE WHEN priority <= 1 AND interactive IS NOT NULL AND source = 'journald' THEN 'journal urgent' END]) AS rule FROM ev) WHERE rule IS NOT NULL)"""

THRESHOLD_SQL = """tk AS (
  SELECT *, row_number() OVER (PARTITION BY rule, key ORDER BY ts_us, seq) AS rn FROM (
    SELECT rule, seq, ts_us, CASE rule WHEN 'failures of a user' THEN auth_user WHEN 'signups together' THEN host ELSE '*' END AS key,
      CASE rule WHEN 'failures of a user' THEN 3 WHEN 'signups together' THEN 5 ELSE 10 END AS cnt,
      CASE rule WHEN 'failures of a user' THEN 86400000000 WHEN 'signups together' THEN 21600000000 ELSE 5400000000 END AS win
    FROM hits WHERE rule IN ('failures of a user', 'signups together', 'burst of errors'))),
tw AS (
  SELECT rule, key, rn, seq, ts_us, cnt, win, [ts_us] AS live, false AS fired FROM tk WHERE rn = 1
  UNION ALL
  SELECT rule, key, rn, seq, ts_us, cnt, win, CASE WHEN len(now) >= cnt THEN CAST([] AS BIGINT[]) ELSE now END, len(now) >= cnt FROM (
    SELECT k.rule, k.key, k.rn, k.seq, k.ts_us, k.cnt, k.win, list_append(list_filter(w.live, lambda x: x >= k.ts_us - k.win), k.ts_us) AS now
    FROM tw w JOIN tk k ON k.rule = w.rule AND k.key = w.key AND k.rn = w.rn + 1)),
fired AS (SELECT rule, key, seq, ts_us, cnt AS match_count FROM tw WHERE fired)"""

THROTTLE_SQL = """passed AS (
  SELECT rule, seq, ts_us, match_count FROM fired
  UNION ALL SELECT rule, seq, ts_us, 1 FROM hits WHERE rule NOT IN ('failures of a user', 'signups together', 'burst of errors')),
sk AS (
  SELECT *, row_number() OVER (PARTITION BY rule, key ORDER BY ts_us, seq) AS rn FROM (
    SELECT p.rule, p.seq, p.ts_us, CASE p.rule WHEN 'signups together' THEN h.host WHEN 'purchases of a user' THEN h.auth_user ELSE h.host || '|' || h.action END AS key,
      CASE p.rule WHEN 'signups together' THEN 43200000000 WHEN 'purchases of a user' THEN 172800000000 ELSE 3600000000 END AS win
    FROM passed p JOIN hits h ON h.rule = p.rule AND h.seq = p.seq WHERE p.rule IN ('signups together', 'purchases of a user', 'journal urgent'))),
sw AS (
  SELECT rule, key, rn, seq, ts_us, win, ts_us AS last, true AS kept FROM sk WHERE rn = 1
  UNION ALL
  SELECT k.rule, k.key, k.rn, k.seq, k.ts_us, k.win, CASE WHEN k.ts_us - w.last >= k.win THEN k.ts_us ELSE w.last END, k.ts_us - w.last >= k.win
  FROM sw w JOIN sk k ON k.rule = w.rule AND k.key = w.key AND k.rn = w.rn + 1),
kept AS (
  SELECT rule, seq, ts_us, match_count FROM passed WHERE rule NOT IN ('signups together', 'purchases of a user', 'journal urgent')
  UNION ALL SELECT p.* FROM passed p JOIN sw s ON s.rule = p.rule AND s.seq = p.seq WHERE s.kept)"""

#: Rules for events that are read from lines of either feed (see adapters): plain, with a threshold, with both, and with a throttle on what a parent adds.
RAW_RULES = [
    Rule("setuid file", "high", lambda f: [f.equal("category", "file"), f.equal("is_setuid", True)], "a file that runs as its owner", feeds=("auditd",)),
    Rule("sudo refused", "low", lambda f: [f.equal("action", "sudo"), f.equal("auth_result", "failure")], "a refused call", feeds=("journald",)),
    Rule("failed logins of a host", "critical", lambda f: [f.equal("category", "auth"), f.equal("auth_result", "failure")], "three in half a day", feeds=("auditd",), threshold=Threshold(3, 12 * HOUR, ("host",))),
    Rule("guesses from an address", "high", lambda f: [f.equal("action", "ssh_login"), f.is_in("auth_result", ["failure", "invalid_user"])], "two in two days", feeds=("journald",), threshold=Threshold(2, 48 * HOUR, ("remote_ip",)), throttle_s=24 * HOUR, dedup_by=("host",)),
    Rule("connection below a program", "medium", lambda f: [f.equal("action", "connect"), f.equal("parent_name", "tool")], "one in six hours", throttle_s=6 * HOUR, dedup_by=("host",)),
]

#: What they match, in SQL over au (the audit events of ev, see queries) and ev; journald entries are of all events too. id names an event of either feed.
RAW_HITS_SQL = """raw AS (
  SELECT 2 * seq AS id, 'auditd' AS source, ts_us // 1000 * 1000 AS ts_us, host, CASE WHEN is_net AND k % 6 = 0 THEN 'fd00::' || format('{:x}', k + 1) ELSE remote_ip END AS remote_ip, k, is_run, is_net, is_login, is_file, success, CAST(NULL AS BIGINT) AS kind FROM au
  UNION ALL SELECT 2 * seq + 1, 'journald', ts_us, host, remote_ip, k, false, false, false, false, success, seq % 3 FROM ev),
parents AS (SELECT r.id FROM raw r ASOF JOIN (SELECT host, ts_us FROM raw WHERE is_run AND k = 1) p ON r.host = p.host AND r.ts_us > p.ts_us WHERE r.is_net),
hits AS (
  SELECT rule, id AS seq, ts_us, source, host, CASE rule WHEN 'failed logins of a host' THEN host WHEN 'guesses from an address' THEN remote_ip END AS gkey, CASE rule WHEN 'failed logins of a host' THEN 3 WHEN 'guesses from an address' THEN 2 END AS cnt,
    CASE rule WHEN 'failed logins of a host' THEN 43200000000 WHEN 'guesses from an address' THEN 172800000000 END AS win, CASE WHEN rule IN ('guesses from an address', 'connection below a program') THEN host END AS dkey,
    CASE rule WHEN 'guesses from an address' THEN 86400000000 WHEN 'connection below a program' THEN 21600000000 END AS wait
  FROM (SELECT *, CASE WHEN is_file AND k % 7 = 0 THEN 'setuid file' WHEN kind = 1 AND k % 9 = 2 THEN 'sudo refused' WHEN is_login AND k % 3 = 0 THEN 'failed logins of a host'
    WHEN kind = 0 AND (k % 9 < 2 OR NOT success) THEN 'guesses from an address' WHEN is_net AND id IN (SELECT id FROM parents) THEN 'connection below a program' END AS rule FROM raw) WHERE rule IS NOT NULL)"""

#: Thresholds, then throttles, over hits (rule, seq, ts_us and, where a rule has them, gkey, cnt, win and dkey, wait).
HELD_SQL = """tk AS (SELECT rule, gkey AS key, seq, ts_us, cnt, win, row_number() OVER (PARTITION BY rule, gkey ORDER BY ts_us, seq) AS rn FROM hits WHERE cnt IS NOT NULL),
tw AS (
  SELECT rule, key, rn, seq, ts_us, cnt, win, CASE WHEN cnt = 1 THEN CAST([] AS BIGINT[]) ELSE [ts_us] END AS live, cnt = 1 AS fired FROM tk WHERE rn = 1
  UNION ALL
  SELECT rule, key, rn, seq, ts_us, cnt, win, CASE WHEN len(now) >= cnt THEN CAST([] AS BIGINT[]) ELSE now END, len(now) >= cnt FROM (
    SELECT k.rule, k.key, k.rn, k.seq, k.ts_us, k.cnt, k.win, list_append(list_filter(w.live, lambda x: x >= k.ts_us - k.win), k.ts_us) AS now
    FROM tw w JOIN tk k ON k.rule = w.rule AND k.key = w.key AND k.rn = w.rn + 1)),
passed AS (SELECT rule, seq, ts_us, cnt AS match_count FROM tw WHERE fired UNION ALL SELECT rule, seq, ts_us, 1 FROM hits WHERE cnt IS NULL),
sk AS (
  SELECT p.rule, h.dkey AS key, p.seq, p.ts_us, h.wait, row_number() OVER (PARTITION BY p.rule, h.dkey ORDER BY p.ts_us, p.seq) AS rn
  FROM passed p JOIN hits h ON h.rule = p.rule AND h.seq = p.seq WHERE h.wait IS NOT NULL),
sw AS (
  SELECT rule, key, rn, seq, ts_us, wait, ts_us AS last, true AS kept FROM sk WHERE rn = 1
  UNION ALL
  SELECT k.rule, k.key, k.rn, k.seq, k.ts_us, k.wait, CASE WHEN k.ts_us - w.last >= k.wait THEN k.ts_us ELSE w.last END, k.ts_us - w.last >= k.wait
  FROM sw w JOIN sk k ON k.rule = w.rule AND k.key = w.key AND k.rn = w.rn + 1),
kept AS (
  SELECT p.*, h.source, h.host FROM passed p JOIN hits h ON h.rule = p.rule AND h.seq = p.seq WHERE h.wait IS NULL
  UNION ALL SELECT p.*, h.source, h.host FROM passed p JOIN sw s ON s.rule = p.rule AND s.seq = p.seq AND s.kept JOIN hits h ON h.rule = p.rule AND h.seq = p.seq)"""
