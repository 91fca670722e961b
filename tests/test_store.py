import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from logloom.operators import alerts, verdicts
from logloom.operators.detect import Rule
from logloom.sources import store


def test_alerts_and_verdicts_are_kept(spark, tmp_path):
    rules = [Rule("r", "high", lambda f: [f.present("host")])]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "host string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    made = alerts.build(df, rules)
    store.write_alerts(made, str(tmp_path / "alerts"))
    back = store.read_alerts(spark, str(tmp_path / "alerts"), made.schema)
    assert {(r.alert_id, r.event.host, r.rule["name"]) for r in back.collect()} == {(r.alert_id, r.event.host, r.rule["name"]) for r in made.collect()}
    assert sorted(p.name for p in (tmp_path / "alerts").glob("day=*/*")) == ["level=high"]
    nothing = spark.createDataFrame([], "alert_id string, verdict string, rule string, signature string")
    for verdict in ("wip", "tp", "no such"):
        new = spark.createDataFrame([("x", verdict, "n", "me", "r", "s")], "alert_id string, verdict string, note string, analyst string, rule string, signature string")
        store.append_journal(verdicts.records(new, nothing, F.lit(f"2024 {verdict}")), str(tmp_path / "journal"))
        time.sleep(0.05)
    latest = verdicts.latest(store.load_journal(spark, str(tmp_path / "journal")))
    assert [(r.alert_id, r.verdict) for r in latest.collect()] == [("x", "true_positive")]
    known = verdicts.annotate(made.withColumn("signature", F.lit("s")), latest)
    assert {r.metric: r.n for r in alerts.run_counts(made, known).collect()}["known_true_positive"] == 2


def test_several_append_at_once(spark, tmp_path):
    """Nothing is lost, whoever else writes, and what comes later counts."""
    folder = str(tmp_path / "journal")
    line = lambda a, v, n: spark.createDataFrame([(f"{a}-{i}", v, n, "me", "r", "s", "2024") for i in range(5)], "alert_id string, verdict string, note string, analyst string, rule string, signature string, updated_at string")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: store.append_journal(line(f"a{k}", "open", "first"), folder), range(12)))
    assert store.load_journal(spark, folder).count() == 60
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: store.append_journal(line(f"a{k}", "duplicate", "second"), folder), range(3)))
    latest = {r.alert_id: r.verdict for r in verdicts.latest(store.load_journal(spark, folder)).collect()}
    assert len(latest) == 60 and {a for a, v in latest.items() if v == "duplicate"} == {f"a{k}-{i}" for k in range(3) for i in range(5)}
