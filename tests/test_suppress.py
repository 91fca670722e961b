import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import suppress


def sequential_threshold(t, count, window):
    live, out = [], []
    for i, x in enumerate(t):
        live = [y for y in live if y >= x - window] + [x]
        if len(live) >= count:
            out.append(i)
            live = []
    return out


def sequential_throttle(t, window):
    last, out = None, []
    for i, x in enumerate(t):
        if last is None or x - last >= window:
            out.append(i)
            last = x
    return out


def test_jumps_are_the_sequential_walk():
    r = random.Random(4)
    for _ in range(3000):
        t = sorted(r.randrange(60) for _ in range(r.randrange(1, 30)))
        count, window = r.randrange(1, 6), r.randrange(1, 20)
        assert suppress.firings(np.array(t), count, window)[0] == sequential_threshold(t, count, window)
        assert suppress.emissions(np.array(t), window, None) == sequential_throttle(t, window)


def test_edges():
    assert suppress.firings(np.array([0, 5, 10]), 3, 10)[0] == [2]
    assert suppress.firings(np.array([0, 5, 11]), 3, 10)[0] == []
    assert suppress.emissions(np.array([0, 9, 10]), 10, None) == [0, 2]


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("rows_per_batch", ["3", "1000"])
def test_parts_and_batches_do_not_matter(spark, parts, rows_per_batch):
    r = random.Random(parts)
    rows = [("r", f"k{r.randrange(3)}", r.randrange(0, 4000), i, 3, 40) for i in range(400)]
    df = spark.createDataFrame(rows, "rule string, key string, ts_us long, seq long, count int, window_us long").repartition(parts)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        fired = {(x.key, x.seq) for x in suppress.threshold(df).collect()}
        passed = {(x.key, x.seq) for x in suppress.throttle(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want_fired, want_passed = set(), set()
    for k in ("k0", "k1", "k2"):
        own = sorted((x[2], x[3]) for x in rows if x[1] == k)
        t = [x[0] for x in own]
        want_fired |= {(k, own[i][1]) for i in sequential_threshold(t, 3, 40)}
        want_passed |= {(k, own[i][1]) for i in sequential_throttle(t, 40)}
    assert fired == want_fired and passed == want_passed


def test_empty(spark):
    df = spark.createDataFrame([], "rule string, key string, ts_us long, seq long, count int, window_us long")
    assert suppress.threshold(df).count() == suppress.throttle(df).count() == 0


def test_sparse_times_of_a_busy_key_are_parts_of_their_own(spark):
    """Two hits in each stretch never fill a threshold of five; only the burst stays together."""
    rows = [("r", "*", 10 * i + 5 * j, 2 * i + j, 5, 10) for i in range(200) for j in range(2)] + [("r", "*", 500 + j, 1000 + j, 5, 10) for j in range(7)]
    df = spark.createDataFrame(rows, "rule string, key string, ts_us long, seq long, count int, window_us long")
    parts = suppress.parts_of(df, 100, "count").groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert 7 <= sum(p["n"] for p in parts) < 20  # parts too small to fire are left out before any row is moved
    every = suppress.parts_of(df.withColumn("key", F.lit("k")), 100).groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert [p["n"] for p in every] == [407]
    own = sorted((x[2], x[3]) for x in rows)
    assert {x.seq for x in suppress.threshold(df).collect()} == {own[i][1] for i in sequential_threshold([t for t, _ in own], 5, 10)}


@pytest.mark.parametrize(("seed", "window", "count", "most"), [(1, 40, 3, 90), (2, 400, 7, 80), (3, 5000, 2, 100), (4, 30, 1, 70), (5, 900, 40, 30)])
def test_large_parts_are_walked_in_ranges(spark, seed, window, count, most):
    """Keys cut into many ranges, some shorter than a threshold's count or a throttle's window, and hits at equal distances: as the sequential walk."""
    r = random.Random(seed)
    rows = [("r", "hot", r.randrange(2000), i, count, window) for i in range(500)] + [("r", f"k{r.randrange(3)}", r.randrange(4000), 1000 + i, count, window) for i in range(150)]
    rows += [("r", "even", 10 * i, 2000 + i, count, window) for i in range(200)] + [("q", "hot", 7, 3000 + i, count, window) for i in range(100)]
    df = spark.createDataFrame(rows, "rule string, key string, ts_us long, seq long, count int, window_us long").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fired = {(x.rule, x.key, x.seq): x.members for x in suppress.threshold(df, most).collect()}
        passed = {(x.rule, x.key, x.seq) for x in suppress.throttle(df, most).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want_fired, want_passed = {}, set()
    for name in {x[:2] for x in rows}:
        own = sorted((x[2], x[3]) for x in rows if x[:2] == name)
        t = [x[0] for x in own]
        want_fired |= {(*name, own[i][1]): [s for _, s in own[max(i - count + 1, i - 24) : i + 1]] for i in sequential_threshold(t, count, window)}
        want_passed |= {(*name, own[i][1]) for i in sequential_throttle(t, window)}
    assert fired == want_fired and passed == want_passed


def jobs_of(spark, run):
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_the_number_of_jobs_does_not_depend_on_the_ranges(spark):
    """A dense key without a quiet time, whose throttle goes on from range to range: 8 and 200 ranges."""
    rows = [("r", "hot", 10 * i + i % 3, i, 4, 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "rule string, key string, ts_us long, seq long, count int, window_us long").repartition(3).cache()
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it starts a job for each stage
    try:
        for walk in (suppress.threshold, suppress.throttle):
            found = {}
            used = [jobs_of(spark, lambda most=most: found.update({most: sorted(x.seq for x in walk(df, most).collect())})) for most in (250, 10)]
            assert used[0] == used[1] < 25 and found[250] == found[10]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert found[10] == [i for i in sequential_throttle([r[2] for r in rows], 1000)]


def test_landings_are_the_walks_from_each_time():
    r = random.Random(9)
    for k in range(800):
        n, wide = r.randrange(1, 60), r.choice([20, 200, 5000])
        t = np.array(sorted(r.randrange(wide) for _ in range(n)) if k % 4 else range(0, 7 * n, 7), np.int64)
        window = r.randrange(1, 80)
        upto, end = suppress.landings(t, window)
        for x in range(int(t[0]) - 2, int(t[0]) + window + 1):  # from when on it may let through again
            at = np.searchsorted(upto, x, "left")
            walked = suppress.emissions(t, window, x - window)
            assert (int(end[at]) if at < len(upto) else None) == (int(t[walked[-1]]) if walked else None)


@pytest.mark.parametrize("most", [1000, 25])
def test_events_named_by_texts(spark, most):
    r = random.Random(2)
    rows = [("r", f"k{r.randrange(2)}", r.randrange(0, 3000), i, 3, 40) for i in range(300)]
    df = spark.createDataFrame(rows, "rule string, key string, ts_us long, seq long, count int, window_us long")
    text = df.withColumn("seq", F.lpad(F.col("seq").cast("string"), 6, "0"))
    for walk in (suppress.threshold, suppress.throttle):
        a, b = walk(df, most), walk(text, most)
        members = lambda x: [int(m) for m in x["members"]] if "members" in x else []
        assert sorted((x.key, x.seq, members(x.asDict())) for x in a.collect()) == sorted((x.key, int(x.seq), members(x.asDict())) for x in b.collect())
