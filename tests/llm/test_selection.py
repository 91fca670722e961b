"""Importance resampling, minimum-bin-slack packing and ranked search against plain loops."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, SCHEMA, SF, docs, empty, library, odd, texts, want_ids  # noqa: F401

from logloom.llm import bin_slack, importance, lexical_search, queries

ITEMS = "item_id long, text string"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def draws(rows, goals, percent=25, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, drawn) by plain loops."""

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))
        return len(w), [zlib.crc32(g.encode()) % buckets for g in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    own, goal = [grams(t) for _, t in rows], collections.Counter(g for t in goals for g in grams(t)[1])
    count = collections.Counter(g for _, x in own for g in x)
    s, t = sum(count.values()), sum(goal.values())
    gain = lambda g: math.floor(1000 * math.log((goal[g] + 1) * (s + buckets) / ((count[g] + 1) * (t + buckets))))
    out = []
    for (i, _), (n, x) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x)) // len(x) if x else 0
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return collections.Counter((*r[:4], drawn.get(id(r))) for r in out)


def found(df):
    return collections.Counter(map(tuple, df.collect()))


def test_draws_by_plain_loops(spark, docs, odd, empty):  # noqa: F811
    goals = spark.read.parquet(f"{SF}/benchmark.parquet")
    goal_texts = [r.text for r in goals.collect()]
    assert found(importance.resample(docs, goals)) == draws(texts(docs), goal_texts)
    assert found(importance.resample(docs.repartition(7), goals)) == draws(texts(docs), goal_texts)
    named = odd.withColumns({c: F.lit(0) for c in ("row", "words", "grams", "bucket", "gain", "place", "able", "at")})
    assert found(importance.resample(named, goals, percent=60, least_words=5)) == draws(texts(odd), goal_texts, 60, 5)
    assert importance.resample(empty, goals).count() == 0
    assert found(importance.resample(docs, spark.createDataFrame([(1, None)], ITEMS))) == draws(texts(docs), [])


def test_plan_of_the_draw_is_built_in(spark):
    def plans(df):
        return df._jdf.queryExecution().toString()

    rows = spark.range(3).select("id", F.lit("a b c").alias("text"))
    own = importance.hashed(rows, 2, 100, "id", "text")
    made = importance.with_scores(own, importance.gain_table(own, own, 100), 7)
    assert not re.search("Python|Arrow|Pandas|Scala", plans(own) + plans(made)) and "BroadcastHashJoin" in plans(made)


def test_bigrams_and_buckets(spark):
    r = spark.range(1).select(importance.grams_of(importance.words_of(F.lit("Ab-c  Éx\x000_9\x7f")), 3).alias("g")).first()
    assert r.g == ["ab", "c", "Éx", "0", "9", "ab c", "c Éx", "Éx 0", "0 9", "ab c Éx", "c Éx 0", "Éx 0 9"]


def test_the_fullest_combination():
    r = random.Random(5)
    for _ in range(300):
        room = r.randrange(1, 40)
        counts = {r.randrange(1, 30): r.randrange(0, 4) for _ in range(r.randrange(0, 6))}
        taken = bin_slack.fullest(counts, room)
        pieces = [x for x, n in counts.items() for _ in range(n)]
        sums = {sum(c) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k)}
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[x] for x, n in taken.items())


def test_a_plan_places_each_piece_once():
    r = random.Random(6)
    for _ in range(60):
        capacity = r.choice([1, 7, 64, 1024])
        counts = {r.randrange(1, capacity + 1): r.choice([1, 2, 9, 1000]) for _ in range(r.randrange(1, 30))}
        plan = bin_slack.planned(counts, capacity)
        length = np.repeat(list(counts), list(counts.values()))
        rank = np.concatenate([np.arange(n) for n in counts.values()])
        window, offset = plan.place(length, rank)
        order = np.lexsort((offset, window))
        w, o, n = window[order], offset[order], length[order]
        first = np.append(True, w[1:] != w[:-1])
        assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all() and (o + n).max() <= capacity
        assert set(w.tolist()) == set(range(plan.n_windows))


def test_work_depends_on_the_different_lengths():
    counts = {x: 10**9 // x for x in range(1, 1025)}
    plan = bin_slack.planned(counts, 1024)
    total = sum(x * n for x, n in counts.items())
    assert total / 1024 <= plan.n_windows < 1.001 * total / 1024


def check_windows(rows, library, df):  # noqa: F811
    """Each id in one piece, cut as said; returns the number of windows and the least there could be."""
    want = collections.Counter()
    for i, t in texts(df):
        ids = np.array([*want_ids(library, t), 2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for x in windows.values():
        x.sort()
        assert [o for o, _ in x] == [0, *itertools.accumulate(n for _, n in x)][:-1] and sum(n for _, n in x) <= 1024
    return len(windows), -(-sum(r.length for r in rows) // 1024)


def test_minimum_bin_slack_keeps_every_id_in_few_windows(spark, docs, odd, empty, library):  # noqa: F811
    odd = odd.withColumns({c: F.lit(0) for c in ("length", "task", "local", "before", "rank", "n")})
    for df in (odd, docs):
        got = {check_windows(bin_slack.pack_digests(part).collect(), library, df)[0] for part in (df, df.repartition(5))}
        assert len(got) == 1  # however the rows are dealt
    n, least = check_windows(bin_slack.pack_digests(many := docs.unionAll(docs).unionAll(docs)).collect(), library, many)
    assert n <= least + 6
    a, b = bin_slack.pack(docs).collect(), bin_slack.pack_digests(docs).collect()
    assert sorted((r.doc_id, r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in a) == sorted((r.doc_id, r.start, r.ids_crc32) for r in b)
    assert bin_slack.pack_digests(empty).count() == 0


def ranking(rows, items, keep=10):
    """(item_id, rank, doc_id, score) by plain loops."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small(t))
    own = [(i, collections.Counter(w), len(w)) for i, t in rows if (w := cut(t))]
    total, df = sum(n for _, _, n in own), collections.Counter(t for _, c, _ in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(own) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = collections.Counter()
    for item, text in items:
        asked, scores = collections.Counter(cut(text)), []
        for i, c, n in own:
            m = 25 + 75 * n * len(own) // total
            score = sum(k * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            scores += [(-score, i is None, i)] if score > 0 else []
        out.update((item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:keep]))
    return out


def test_search_by_plain_loops(spark, docs, odd, empty):  # noqa: F811
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(None, "of the of"), (900, None), (901, ""), (902, "nowhere-zzz"), (3, items[0][1]), (3, items[0][1]), (904, " ".join(t for _, t in items)), (905, "日本語 word ONE two")]
    asked = spark.createDataFrame(items, ITEMS).withColumns({"row": F.lit(0), "rank": F.lit(0)}).repartition(3)
    named = odd.withColumns({c: F.lit(0) for c in ("n", "terms", "tfs", "item", "row", "rank")})
    for df in (docs, named, docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))):
        want = ranking(texts(df), items)
        assert found(lexical_search.search(df, asked)) == want
        assert found(lexical_search.search(df.repartition(5), asked, block_docs=3, group_blocks=2, most_chars=900)) == want
    assert lexical_search.search(empty, asked).count() == lexical_search.search(docs, asked.where("false")).count() == 0


def test_blocks_that_cannot_hold_a_result_are_passed_by(spark):
    r = random.Random(8)
    word = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(r.choices(word[(i // 40) % 10 * 40 :][:40], k=30))) for i in range(4000)]  # neighbours are about the same
    items = [(k, " ".join(r.choices(word[k % 10 * 40 :][:40], k=6) + r.choices(word, k=2))) for k in range(30)]
    asked = lexical_search.Queries.of([t for _, t in items])
    index = lexical_search.forward_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), asked, "doc_id", "text")
    known = lexical_search.statistics(index, len(asked.vocabulary))
    batches = index.toArrow().to_batches()
    best, scored = {}, {}
    for prune in (False, True):
        task = lexical_search.Search(asked, known.weights(), 10, np.zeros(len(asked), np.int64))
        for blocks in lexical_search.groups_of_blocks(iter(batches), known, 75, 40, 50):
            if prune:
                task.over(blocks)
            else:
                for item, row in enumerate(task.bounds(blocks)):
                    for k, block in enumerate(blocks):
                        dense = np.zeros(len(asked.vocabulary), np.int64)
                        dense[asked.terms[asked.first[item] : asked.first[item + 1]]] = task.value[asked.first[item] : asked.first[item + 1]]
                        assert block.scores(dense).max() <= row[k]
                    task.visit(item, blocks, np.full(len(blocks), 1 << 60))
        best[prune], scored[prune] = [list(zip(*map(np.ndarray.tolist, b), strict=True)) for b in task.best], task.scored
    assert best[True] == best[False] and scored[True] < 0.35 * scored[False]
    assert found(lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))) == ranking(rows, items)


def test_terms_across_a_cut():
    for text in ("aB c-dé " * 50, "x" * 300, "", "é" * 99 + " " + "ÀB" * 40):
        want = collections.Counter(t.encode() for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small(text)))
        assert all(lexical_search.term_counts(text, most) == want for most in (1, 2, 7, 10**6))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.SQL[name]})").fetchall()
    assert found(got) == collections.Counter(want)
