"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with odd rows among the input."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
from logloom.llm import bagminhash, bpe, bpe_codec, common, components, jpeg, license_scans, media_columns, multi_index, near_duplicates, online_packing, packed_matrices, queries, samples, textvec, token_counts, toxicity, weak_quality

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  \n ", "a", "a  b", "it's  we'll 'tis 're 'really ''s !'s I'M x's's\t'd  'll", "a<|endoftext|>b", " <|endoftext|>  <|endoftext|>", "<|endoftext|", "<<|endoftext|>>'s", "x" * 9000, "ab" * 3000 + " " * 700 + "z", "日本語 テキスト 123٣ ½ é́",
    "　x​   y", "🎉🎉 👍🏽", "a'", "don't.\x1c\x1dx \x85y", "word " * 40_000, "One two three four five six.", "One two three four five six.", "one TWO three  four five six.", "\r\n\r\n x",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash with what operators make."""
    rows = [(i, t, None, "s", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], None, "s", 1), (None, "null id text here", "x", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit("x"), "score": F.lit(1.5), "key": F.lit(2), "node": F.lit(3), "label": F.lit("l"), "total": F.lit(0), "bands": F.lit("b")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def want_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


# 4 and 2


def test_bpe_is_the_library(odd, docs, empty, library):
    for df in (odd, docs):
        got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.round_trip_digests(df).collect())
        want = collections.Counter()
        for i, t in texts(df):
            ids = want_ids(library, t)
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert got == want
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(docs)).collect()}
    assert back == dict(texts(docs))
    assert bpe_codec.round_trip_digests(empty).count() == bpe_codec.encode(empty).count() == 0


def test_pair_table_and_backtracking_follow_the_merges():
    v = bpe.Vocabulary.load(P.path("byte_bpe_50k.json"))
    b, r = bpe.Backtracker(v), random.Random(1)
    for _ in range(4000):
        w = v.tokens[r.randrange(50_000)]
        k = r.randrange(1, len(w)) if len(w) > 1 and r.random() < 0.5 else 0
        pair = (v.ids[w[:k]], v.ids[w[k:]]) if k and w[:k] in v.ids and w[k:] in v.ids else (r.randrange(50_000), r.randrange(50_000))
        assert b.compatible(*pair) == (bpe.merged(v.tokens[pair[0]] + v.tokens[pair[1]], v.ranks) == [v.tokens[p] for p in pair])
    for _ in range(500):
        data = bytes(r.choice(b"abe tion0\xc3\xa9") for _ in range(r.randrange(1, 40)))
        assert [v.tokens[i] for i in b.encode(data)] == bpe.merged(data, v.ranks)
    long = b"ab" * 9000
    assert b"".join(v.tokens[i] for i in b.encode(long)) == long


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="a normalizer, another pre-tokenizer, end_of_word_suffix"):
        bpe.Vocabulary.load(P.path("word_bpe_49k.json"))


def test_counts_by_chunks_are_counts_of_the_whole(odd, docs, empty, library):
    for df in (odd, docs):
        want = collections.Counter((i, len(t.encode()), len(want_ids(library, t))) for i, t in texts(df))
        for chunk, overlap in ((32_768, 256), (64, 8), (16, 4)):
            got = token_counts.count_tokens(df, chunk=chunk, overlap=overlap).collect()
            assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
            assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(empty).count() == 0
    r = {x.doc_id: x.n_chunks for x in token_counts.count_tokens(docs).collect()}
    assert all((r[i] > 1) == (len(t) > 2048) for i, t in texts(docs)) and sum(n > 1 for n in r.values()) > 20


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_regular_long_words_are_told_apart(spark, library):
    """Polynomial hashes modulo a power of two are equal for these pairs of words."""
    flip = str.maketrans("ab", "ba")
    made = [t for n in (1024, 2048) for w in [thue_morse(n)] for t in (w, w.translate(flip), f"x {w} <|endoftext|> y", f"x {w.translate(flip)} <|endoftext|> y")]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    ids = [want_ids(library, t) for t in made]
    assert [r.ids for r in bpe_codec.encode(df).orderBy("doc_id").collect()] == ids
    assert [r.n_tokens for r in token_counts.count_tokens(df).orderBy("doc_id").collect()] == list(map(len, ids))
    assert {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df)).collect()} == dict(enumerate(made))
    assert sorted(i for r in online_packing.pack(df).collect() for i in r.ids) == sorted(i for x in ids for i in [*x, 0])
    found = packed_matrices.pack_matrices(df, capacity=256, matrix_rows=8).collect()
    assert sum(r.n_tokens for r in found) == sum(len(x) + 1 for x in ids)
    assert {r.class_id for r in near_duplicates.near_duplicate_classes(df).collect()} == set(range(8))


def test_equal_hashes_of_different_pieces_do_no_harm(library):
    class Few(bpe.BatchEncoder):
        @staticmethod
        def hashes(batch, start, end):
            return bpe.BatchEncoder.hashes(batch, start, end) % np.uint64(5) + np.uint64(1)

    base = bpe.library_encoder(P.path("byte_bpe_50k.json"))
    encoder = Few(base.vocabulary, base.encode)
    for _ in range(2):
        texts = [t for t in ODD if t and len(t) < 9000]
        assert [x.tolist() for x in encoder(texts)] == [want_ids(library, t) for t in texts]


# 3 and 1


def test_online_packing_keeps_every_id_with_little_padding(odd, docs, empty, library):
    for df in (odd, docs):
        ids = collections.defaultdict(list)
        for i, t in texts(df):
            ids[i].append([*want_ids(library, t), 0])
        pieces = online_packing.pack(df).collect()
        digests = online_packing.pack_digests(df).collect()
        assert collections.Counter((r.doc_id, r.start, r.length, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in pieces) == collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in digests)
        covered = collections.Counter()
        for r in pieces:
            assert r.length == len(r.ids) > 0 and any(x[r.start : r.start + r.length] == r.ids and len(x) == r.doc_tokens for x in ids[r.doc_id])
            covered[r.doc_id] += r.length
        assert covered == {i: sum(map(len, x)) for i, x in ids.items()}
        by = collections.defaultdict(list)
        for r in pieces:
            by[r.sequence_id].append(r)
        padding = 0
        for rows in by.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024
            padding += 0 if at & (at - 1) == 0 else 1024 - at
        assert padding == 0
    assert online_packing.pack(empty).count() == 0


def test_a_piece_goes_where_the_sum_of_squares_is_least():
    r = random.Random(2)
    packer = online_packing.SumOfSquares(20)
    for n in range(400):
        size = r.randrange(1, 20)
        before = packer.levels.copy()
        list(packer.place((n, 0, np.zeros(size, np.uint32), size)))

        def after(level):
            x = before.copy()
            x[level] -= level > 0
            x[level + size] += level + size < 20
            return int((x[1:20] ** 2).sum())

        choices = [h for h in range(20 - size + 1) if h == 0 or before[h]]
        assert int((packer.levels[1:20] ** 2).sum()) == min(map(after, choices))


def test_the_last_documents_fill_all_windows():
    r = random.Random(4)
    for capacity, n_docs, longest in ((64, 700, 64), (64, 700, 300), (64, 3, 20), (64, 1, 1), (1, 5, 4), (64, 0, 1), (1024, 400, 900)):
        packer, placed, size_of = online_packing.SumOfSquares(capacity, 7), [], {}
        for n in range(n_docs):
            size_of[n] = size = r.randrange(1, longest + 1)
            placed += packer.add((n, 0, np.arange(size, dtype=np.uint32), size))
            assert packer.lacking == sum((capacity - h) * k for h, k in enumerate(packer.levels.tolist())) <= packer.held
        before = len(placed)
        placed += packer.finish()
        assert not packer.levels.any() and not packer.waiting and packer.lacking == 0
        windows, got = collections.defaultdict(list), collections.defaultdict(list)
        for n, start, ids, _, window, at, tail in placed:
            windows[window].append((at, len(ids), tail))
            assert ids.tolist() == list(range(start, start + len(ids)))
            got[n] += ids.tolist()
        assert {n: sorted(x) for n, x in got.items()} == {n: list(range(size)) for n, size in size_of.items()}
        for x in windows.values():
            x.sort()
            at = 0
            for begin, size, _ in x:
                assert begin == at
                at += size
            assert at & (at - 1) == 0 if x[0][2] else at == capacity
        assert sum(len(p[2]) for p in placed if p[6]) < capacity
        if n_docs == 700:
            assert before > 0.8 * len(placed)


def test_few_pieces_are_cut_to_powers_of_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for parts in (1, 64):
        n, settled, ids, settled_ids = online_packing.pack_digests(docs.repartition(parts)).agg(F.count("*"), F.count_if("settled"), F.sum("length"), F.sum(F.when(F.col("settled"), F.col("length")))).first()
        assert settled <= 12 * parts and settled_ids < 1024 * parts and (parts > 1 or settled < 0.05 * n), (parts, n, settled, ids, settled_ids)



def test_matrices_hold_every_id(odd, docs, empty, library):
    for df in (odd, docs):
        ids = collections.defaultdict(list)
        for i, t in texts(df):
            ids[i].append([*want_ids(library, t), 50256])
        found = packed_matrices.pack_matrices(df, capacity=256, matrix_rows=8, batch_tokens=20_000).collect()
        assert len({r.matrix_id for r in found}) == len(found)
        total = collections.Counter()
        for r in found:
            m = np.frombuffer(r.ids, "<u2").reshape(r.n_rows, 256)
            positions, ends = np.frombuffer(r.position_ids, "<u2"), np.array(r.cu_seqlens)
            assert r.id_bytes == 2 and ends[0] == 0 and ends[-1] == m.size and (np.diff(ends) > 0).all()
            assert positions.tolist() == [k for n in np.diff(ends) for k in range(n)]
            for p in r.pieces:
                got = m[p.row, p.offset : p.offset + p.length].tolist()
                assert any(x[p.start : p.start + p.length] == got for x in ids[p.doc_id])
                assert p.row * 256 + p.offset in set(ends.tolist())
                total[p.doc_id] += p.length
            assert r.n_tokens == sum(p.length for p in r.pieces)
        assert total == {i: sum(map(len, x)) for i, x in ids.items()}
    assert packed_matrices.pack_matrices(empty).count() == 0


def test_best_fit_takes_the_fullest_bin_with_room():
    r = random.Random(3)
    for _ in range(300):
        sizes = np.array([r.randrange(1, 51) for _ in range(r.randrange(0, 40))], np.int64)
        free, want = [], []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [f for f in free if f >= sizes[i]]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - sizes[i])
            else:
                free.append(50 - sizes[i])
        want = sorted(f for f in free)
        assert sorted(50 - sizes[b].sum() for b in packed_matrices.best_fit_decreasing(sizes, 50)) == want


# 5 and 10


def test_toxicity_on_held_out_rows(spark, docs, odd, empty):
    sf = "/root/testdata/sf0.1"
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.trained(big, labels, most_each=800)
    got = toxicity.score(big, model).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert ((out.predicted == out.toxic).mean()) > 0.93
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.97
    assert model.scores(["the moroon and scuumm of idiiot stupiid it is"])[0] > model.scores(["the house and garden of the lake it is"])[0]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.drop_toxic(odd, model)
    assert kept.schema == odd.schema and kept.count() == sum(1 - r.predicted for r in rows)
    assert toxicity.score(empty, model).count() == 0
    for y in ([], [0, 0], [1, 1]):
        flat = toxicity.fit(["a b"] * len(y), y)
        assert flat.scores(["x", ""]).round(3).tolist() == [float(bool(sum(y)))] * 2
    assert toxicity.trained(docs, labels.where("false")).scores(["x"])[0] < 0.5


def test_quality_keeps_good_texts(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    big = spark.read.parquet(f"{sf}/documents.parquet")
    model = weak_quality.trained(big)
    got = weak_quality.score(big, model).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got[got.quality == 1].predicted == 1).mean() > 0.99
    assert (got[got.quality == 0].predicted == 0).mean() > 0.9
    rows = weak_quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    kept = weak_quality.drop_bad(odd, model)
    assert kept.schema == odd.schema and kept.count() == sum(r.predicted for r in rows)
    assert weak_quality.score(empty, weak_quality.trained(empty)).count() == 0

def test_toxicity_by_plain_loops(spark, docs, odd):
    """The registered query, of all rows and whole texts, is what loops over words and their n-grams give under the same model."""
    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    text = dict(texts(docs))
    got = queries.queries()["op5_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    for r in got:
        want = brute.toxic_score(model, text[r.doc_id])
        assert abs(r.score - want) < 1e-5 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert np.allclose(model.scores([t or "" for t in ODD]), [brute.toxic_score(model, t or "") for t in ODD], atol=1e-5)


def test_what_toxicity_is_fitted_to(spark, docs, monkeypatch):
    """Labels of rows that are not held out, without ids that have both labels, and of texts of any length."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda x, y, **more: seen.append((sorted(zip(x, y, strict=True)), more["share_of_1"])))
    rows = [(i, f"text {i}" + " long" * (20_000 if i == 7 else 0)) for i in range(60)] + [(7, "a text of the same id"), (None, "none"), (3, None)]
    marks = [(i, i % 2) for i in range(0, 60, 3)] + [(7, 1), (9, 0), (7, 1), (12, None), (None, 1), (15, 5), (999, 1)]
    toxicity.trained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    own = collections.defaultdict(set)
    for i, y in marks:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            own[i].add(y)
    own = {i: y.pop() for i, y in own.items() if len(y) == 1}
    text = {i: min(t or "" for j, t in rows if j == i) for i in own if i < 60}
    assert seen == [(sorted((t, own[i]) for i, t in text.items()), sum(own.values()) / len(own))] and 7 in text and 9 not in own


def test_one_text_over_the_bound_leaves_out_itself_only(spark, docs, monkeypatch):
    """Wherever in the order of the sample it comes, for both operators that fit one."""
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    for where in range(6):
        long = spark.createDataFrame([(-1 - where, f"{where} " + "so long a text " * 40_000)], "doc_id long, text string")
        every, marked = docs.select("doc_id", "text").unionAll(long), marks.select("doc_id", "toxic").unionAll(spark.createDataFrame([(-1 - where, 1)], "doc_id long, toxic int"))
        seen = {}
        monkeypatch.setattr(toxicity, "fit", lambda x, y, **more: seen.update(toxic=list(zip(x, y, strict=True))))
        monkeypatch.setattr(weak_quality, "fit_scorer", lambda x, y: seen.update(quality=x))
        for most in (500_000, 5_000_000):
            toxicity.trained(every, marked, most_chars=most)
            weak_quality.trained(every, most_chars=most)
            n = docs.join(marks.where("toxic in (0, 1)").select("doc_id").distinct(), "doc_id").where(~toxicity.held_out(F.col("doc_id"))).count()
            extra = int(most > 600_000 and zlib.crc32(str(-1 - where).encode()) % 5 > 0)
            assert len(seen["toxic"]) == n + extra and {y for _, y in seen["toxic"]} == {0, 1}
            assert sum(len(t) > 500_000 for t in seen["quality"]) == int(most > 600_000) and len(seen["quality"]) == docs.count() + int(most > 600_000)


def test_a_sample_of_long_texts_only(spark):
    rows = spark.createDataFrame([(0, "a" * 50, 0), (1, "b" * 40, 0), (2, "c" * 60, 1)], "doc_id long, text string, label int")
    assert sorted(samples.collected(rows, 20, "label").text) == ["b" * 40, "c" * 60]
    assert len(samples.collected(rows.where("false"), 20, "label")) == 0


def test_quality_by_plain_loops(spark, docs):
    """The registered query is what loops over characters and words give: votes, accuracies over all texts, and the scorer's sums."""
    _, scorer = weak_quality.trained(docs)
    text = dict(texts(docs))
    given = {i: brute.votes(t, weak_quality.LABELLERS) for i, t in text.items()}
    chance = brute.posterior(given.values())
    got = queries.queries()["op10_weak_quality"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    for r in got:
        assert abs(r.posterior - chance(given[r.doc_id])) < 1e-4 and abs(r.score - brute.quality_score(scorer, text[r.doc_id])) < 1e-6 and r.predicted == (r.score >= 0.5)
    odd_votes = weak_quality.votes_of(weak_quality.patterns(weak_quality.measures(textvec.Batch.of([t or "" for t in ODD]), len(ODD))))
    assert odd_votes.tolist() == [list(brute.votes(t or "", weak_quality.LABELLERS)) for t in ODD]


def test_a_hot_text_fills_no_sample_and_layout_does_not_matter(spark):
    """Half of the rows are one text: of the bounded sample it has its share, and the same rows are drawn however the table is cut."""
    rows = [(i, "the same text again" if i % 2 else f"text of number {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = [sorted((r.doc_id, r.text) for r in samples.sampled(df.repartition(n), ["doc_id", "text"], 3000, 400, 13).collect()) for n in (1, 7)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 400
    assert 140 < sum(t == "the same text again" for _, t in drawn[0]) < 260
    models = [weak_quality.trained(df.repartition(n), most=400) for n in (1, 7)]
    assert np.array_equal(models[0][1].weight, models[1][1].weight)


def test_expectation_maximisation_finds_the_accuracies():
    r = np.random.default_rng(5)
    n, right = 40_000, np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9, 0.85, 0.8, 0.75])[: len(weak_quality.LABELLERS)]
    bad = r.random(n) < 0.3
    hit = r.random((n, len(right))) < right
    votes = np.where(hit, np.where(bad[:, None], 2, 0), np.where(bad[:, None], 0, 2))
    pattern, count = np.unique(votes @ 3 ** np.arange(len(right)), return_counts=True)
    found = weak_quality.expectation_maximisation(pattern, count.astype(float))
    assert abs(found.share - 0.7) < 0.02
    assert np.abs(found.table[0, :, 0] - right).max() < 0.03 and np.abs(found.table[1, :, 2] - right).max() < 0.03


# 6


def test_statements_are_found_to_the_least_containment(spark, docs, odd, empty):
    given = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    statements = {"long": given, "short": "alpha beta gamma delta epsilon", "tiny": "just two"}
    words = given.split()
    cases = ["filler " * 300 + given.upper() + " end " * 200, " ".join([*words[:10], "changed", *words[11:]]), " ".join(words[:19]), "x alpha beta gamma delta epsilon y alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", "just two", None, "", "q " * 20 + " ".join(words[:17])]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {(r.doc_id, r.license): r for r in license_scans.license_scans(df, statements).collect()}

    def runs(t):
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(i, n) for i, t in enumerate(cases) for n, s in statements.items() if len(runs(t or "") & runs(s)) / len(runs(s)) >= 0.8}
    assert set(got) == want
    assert got[0, "long"].containment == 1.0 and got[0, "long"].first_word == 300 and got[3, "short"].places == 2
    every = {(r.doc_id, r.license) for r in license_scans.license_scans(docs).collect()}
    assert every == {(i, n) for i, t in texts(docs) for n, s in license_scans.STATEMENTS.items() if len(runs(t) & runs(s)) / len(runs(s)) >= 0.8}
    assert license_scans.license_scans(empty).count() == license_scans.license_scans(odd).count() == license_scans.license_scans(docs, {}).count() == 0


def test_short_statements_are_found_inside_long_texts(spark):
    statements = {"tag": "SPDX-License-Identifier: MIT", "notice": "All rights reserved.", "four": "no rights are reserved", "one": "proprietary"}
    cases = ["filler " * 400 + "\n// spdx-license-identifier: mit\n" + "filler " * 90 + "All Rights Reserved. x ALL rights\nreserved.", "all rights are reserved. rights reserved.", "No rights are reserved", "x proprietary", "all rights", "all rights reserved. " * 2, "", None]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.containment, r.first_word, r.places) for r in license_scans.license_scans(df, statements).collect()}
    assert got == {(0, "tag"): (1.0, 400, 1), (0, "notice"): (1.0, 494, 2), (2, "four"): (1.0, 0, 1), (3, "one"): (1.0, 1, 1), (5, "notice"): (1.0, 0, 2)}


def test_wrapped_notices_behind_comment_signs(spark):
    notice = license_scans.STATEMENTS["gpl-notice"]
    words = notice.split()
    wrapped = "\n".join("# " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7)).replace(",", " ,").replace(":", "")
    df = spark.createDataFrame([(0, "x = 1\n" + wrapped + "\ny = 2"), (1, "x = 1")], "doc_id long, text string")
    table = spark.createDataFrame([("g", notice), ("nothing", None)], "name string, text string")
    assert [(r.doc_id, r.license, r.containment) for r in license_scans.license_scans(df, table).collect()] == [(0, "g", 1.0)]
    with pytest.raises(ValueError):
        license_scans.license_scans(df, table, most_statements=1)


def test_every_licence_line_of_the_tables_is_found(spark):
    lines = {"all-rights-reserved": "all rights reserved.", "apache-2.0": "apache license, version 2.0", "cc-by-nc-4.0": "cc by-nc 4.0", "gpl-3.0": "gnu general public license, version 3", "mit": "the mit license"}
    sf = SF.replace("0.001", "0.01")
    got = {(r.doc_id, r.license) for r in queries.op6_license_scans(spark, sf).collect()}
    want = {(i, n) for i, t in texts(spark.read.parquet(f"{sf}/documents.parquet")) for n, s in lines.items() if s in t.lower()}
    assert got == want and {n for _, n in want} == set(lines)


# 7


def test_neighbours_against_all_pairs(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 16))
    x[200:700] = x[0]
    x[700] = 0
    x[701, 3] = np.nan
    rows = [(i, [float(v) for v in x[i]], 0.0) for i in range(1500)] + [(1500, None, 0.0), (1501, [1.0, None] + [0.0] * 14, 0.0), (1502, [1.0], 0.0), (1503, [], 0.0), (None, [1.0] * 16, 0.0), (1504, [float("inf")] * 16, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(3)
    got = multi_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0).toPandas()
    ok = np.array([i for i in range(1500) if i not in (700, 701)])
    z = x[ok] / np.linalg.norm(x[ok], axis=1)[:, None]
    hits = total = 0
    for q in [i for i in ok if i % 50 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        s = z @ z[np.searchsorted(ok, q)]
        want = [int(ok[k]) for k in np.lexsort((ok, -s.round(12))) if ok[k] != q][:5]
        hits += len(set(want) & set(own.vec_id))
        total += 5
        for v, c in zip(own.vec_id, own.score, strict=True):
            assert abs(c - float(z[np.searchsorted(ok, v)] @ z[np.searchsorted(ok, q)])) < 1e-12
        assert all(q % 50 == 0 and v < 1500 for v in own.vec_id)
        if q == 0 or 200 <= q < 700:
            assert own.vec_id.tolist() == want  # copies: by id
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [tuple(x)[:3] for x in multi_index.nearest_neighbours(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert multi_index.nearest_neighbours(few.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("larger_first", [True, False])
def test_ties_go_by_id_and_lengths_stay_apart(spark, larger_first):
    r = np.random.default_rng(13)
    base, turned = r.normal(size=8), r.normal(size=8)
    rows = [(i, [float(c) for c in r.normal(size=8)]) for i in range(300)]
    rows += [(300 + k, [float(c * 2.0 ** (-k if larger_first else k)) for c in base]) for k in range(40)]
    rows += [(400 + k, [float(c * 2.0**k) for c in turned[:3]]) for k in range(12)] + [(500 + k, [(-1.0) ** (k // 2) * (k + 1)]) for k in range(12)]
    rows += [(600, [1e200] * 5), (601, [1e-200] * 5), (602, [1e200, 1e200, 1e200, 1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for x in sorted(multi_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect(), key=lambda x: x["rank"]):
        got[x.query_id].append((x.vec_id, round(x.score, 12)))
    assert got[300] == [(i, 1.0) for i in (301, 302, 303, 304, 305)]
    assert got[400] == [(i, 1.0) for i in (401, 402, 403, 404, 405)]
    assert got[500] == [(i, 1.0) for i in (501, 504, 505, 508, 509)]
    assert got[600] == [(601, 1.0), (602, 0.6)]


def test_traversal_is_in_the_order_of_sums():
    r = np.random.default_rng(7)
    a, b = r.random(9), r.random(7)
    sums = [a[i] + b[j] for i, j in multi_index.traversal(a, b)]
    assert len(sums) == 63 and sums == sorted(sums)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, name, monkeypatch):
    built, index = [], multi_index.in_index
    monkeypatch.setattr(multi_index, "in_index", lambda *a: built.append(a[1]) or index(*a))
    df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    got = multi_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0).toPandas()
    all_rows = df.toPandas()
    ids, z = all_rows.vec_id.to_numpy(), multi_index.unit(np.stack(all_rows.embedding).astype(np.float64))
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = np.where(ids == q, -2, z @ z[ids == q][0])
        own = set(got[got.query_id == q].vec_id)
        fifth = np.sort(s)[-5]
        hits += sum(s[ids == v][0] >= fifth - 1e-12 for v in own)
        total += 5
    assert hits / total >= 0.9 and len(built) == 1


# 8


def bag(text, n=5):
    w = text.lower().split()
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else collections.Counter()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - common
            if not total or common / total >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((-(1 << 63) if i is None else i) for i in v) for k, v in members.items()}
    named = {k: None if v == -(1 << 63) else v for k, v in least.items()}
    return collections.Counter((rows[i][0], named[find(i)]) for i in range(len(rows))), sorted(-1 if v is None else v for v in named.values())


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(8)
    for _ in range(8):
        n = int(r.integers(3, 300))
        e = r.integers(1, 1 << 63, n, dtype=np.uint64)
        a = r.integers(0, r.choice([2, 5, 90]), n)
        b = np.where(r.random(n) < 0.8, a, r.integers(0, 6, n))
        a[0] = b[0] = 1
        s = bagminhash.signatures(np.concatenate([e[a > 0], e[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([a[a > 0], b[b > 0]]), 3, 3000)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
        assert (s[2] == 0).all() and (s[:2] != 0).all()


def test_near_duplicates_against_all_pairs(spark, odd, docs, empty):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    made = []
    shared = " ".join(r.choices(words, k=60))
    for _ in range(12):
        base = r.choices(words, k=120)
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = r.choice(words)
            made.append(" ".join(w))
        made.append(shared + " " + " ".join(r.choices(words, k=50)))
    made += ["spam and eggs again " * 30] * 5 + ["spam and eggs again " * n for n in (25, 31, 60)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    for d in (df, docs, odd):
        rows = texts(d)
        got = near_duplicates.near_duplicate_classes(d)
        classes, stay = brute_classes(rows)
        assert collections.Counter((x.doc_id, x.class_id) for x in got.collect()) == classes
        kept = near_duplicates.keep_one(d)
        assert kept.schema == d.schema
        assert sorted((-1 if x.doc_id is None else x.doc_id) for x in kept.collect()) == stay
    assert near_duplicates.near_duplicate_classes(empty).count() == near_duplicates.keep_one(empty).count() == 0


@pytest.mark.parametrize(("bands", "per_band", "tile"), [(20, 1, {"tile_nodes": 9}), (1, 1, {}), (1, 1, {"tile_shingles": 700}), (32, 6, {"tile_nodes": 4})])
def test_no_link_is_lost_where_many_texts_are_alike_but_not_enough(spark, bands, per_band, tile):
    """Texts that share half their words meet in large buckets; with a single band no pair has a second one. Small tiles force blocks and both passes."""
    r = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    shared = r.choices(words, k=60)
    made = []
    for _ in range(25):
        own = r.choices(words, k=40)
        made += [" ".join(shared + own), " ".join(shared + own[:-1] + ["x"])]
    if bands == 1:
        made = [t for t in made for h in [near_duplicates.band_hashes([" ".join(shared), t], 5, 1, 1)[0]] if h[0] == h[1]]
    common = r.choices(words, k=150)  # and one large class of its own
    for k in range(30):
        w = list(common)
        w[5 * k] = "y"
        made.append(" ".join(w))
    classes, least = brute_classes(list(enumerate(made)))
    assert len(least) > 10
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = near_duplicates.near_duplicate_classes(df, bands=bands, per_band=per_band, **tile).collect()
    if bands == 1:  # one band shows few links of the large class; those of the first texts are all in one bucket
        assert {x.doc_id: x.class_id for x in got if x.doc_id < len(made) - 30} == {i: c for i, c in classes if i < len(made) - 30}
    else:
        assert collections.Counter((x.doc_id, x.class_id) for x in got) == classes


def test_rows_equal_in_id_and_text_but_not_elsewhere(spark):
    made = [(1, "a b c d e f", k % 7) for k in range(40)]
    kept = [near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(p)).collect() for rows, p in ((made, 1), (made[::-1], 5))]
    assert kept[0] == kept[1] and len(kept[0]) == 1


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_runs_stay_whole(batch):
    keys = [1, 1, 1, 1, 1, 2, 3, 3, 3, 3, 4]
    table = pa.table({"k": keys, "v": range(11)})
    got = []
    for part, starts in common.whole_runs(table.to_batches(max_chunksize=batch), 1):
        ends = [*starts[1:].tolist(), part.num_rows]
        got += [(part["k"][a].as_py(), part["v"][a:b].to_pylist()) for a, b in zip(starts.tolist(), ends, strict=True)]
    assert got == [(1, [0, 1, 2, 3, 4]), (2, [5]), (3, [6, 7, 8, 9]), (4, [10])]


def test_components(spark):
    r = random.Random(11)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


# 9


def test_media_round_trip(docs, odd, empty):
    for df in (docs, odd):
        got = collections.defaultdict(list)
        for r in media_columns.text_media_digests(df).collect():
            got[r.doc_id].append(r)
        for i, t in texts(df):
            data = t.encode()
            payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
            assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) for r in got[i])
    stored = media_columns.stored_texts(docs)
    columns = {r.doc_id: r for r in media_columns.media_columns(stored).collect()}
    for i, t in texts(docs):
        n = max(1, -(-len(t.encode()) // 576))
        assert (columns[i].width, columns[i].height, columns[i].problem, len(columns[i].thumbnail)) == (24, 24 * n, None, 9 * n)
    assert media_columns.text_media_digests(empty).count() == 0


def test_every_byte_and_many_images():
    r = np.random.default_rng(12)
    payloads = [bytes(range(256)) * 9, r.integers(0, 256, 576 * 3000, dtype=np.uint8).tobytes(), b"\xff" * 576, b"\x00" * 1152]
    streams = jpeg.store(payloads)
    assert [jpeg.restore(*x) for x in media_columns.decoded(streams)] == payloads
    assert len(list(jpeg.parse(streams[1]))) == 2


def test_colour_images_runs_and_damage(spark):
    """A stream written by hand: two components of different sampling, runs of zeros, ends of blocks, no restart markers."""
    ac = jpeg.Huffman(bytes([0, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]), bytes([0x00, 0x01, 0xF0, 0x21]))
    dc = {s: (c, n) for s, c, n in jpeg.OWN_DC.codes()}
    acs = {s: (c, n) for s, c, n in ac.codes()}
    bits = []

    def put(code, n):
        bits.extend(int(b) for b in f"{code:0{n}b}") if n else None

    def number(table, symbol, v):
        put(*table[symbol])
        size = symbol & 15
        put(v if v > 0 else v + (1 << size) - 1, size)

    for difference in (5, -3, 0, 7, 2, 1):  # four blocks of luminance, one of each colour
        number(dc, abs(difference).bit_length(), difference)
        number(acs, 0xF0, 0)
        number(acs, 0x21, 1)
        number(acs, 0x01, -1)
        put(*acs[0x00])
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    segment = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(jpeg.DQT, b"\x00" + bytes([8] * 64)) + segment(jpeg.SOF0, b"\x08\x00\x10\x00\x0c\x03" + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    tables = segment(jpeg.DHT, b"\x00" + jpeg.OWN_DC.counts + jpeg.OWN_DC.symbols) + segment(jpeg.DHT, b"\x10" + ac.counts + ac.symbols)
    stream = head + tables + segment(jpeg.SOS, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    (image,) = jpeg.parse(stream)
    (blocks,) = jpeg.coefficients([image])
    assert blocks[:, 0].tolist() == [5, 2, 2, 9, 2, 1] and blocks[0].nonzero()[0].tolist() == [0, 19, 20] and blocks[0, 19:21].tolist() == [1, -1]
    assert jpeg.thumbnail(image, blocks).tolist() == [[133, 130], [130, 137]]
    broken = [None, b"", b"abc", stream[:40], stream[:-12] + b"\xff\xd9", stream.replace(bytes([0xFF, jpeg.SOF0]), b"\xff\xc2"), stream, stream + b"tail", stream + stream]
    size = stream.index(b"\x08\x00\x10\x00\x0c\x03")
    broken += [stream[: size + 7] + bytes([x]) + stream[size + 8 :] for x in (0x00, 0x02, 0x20, 0x51)] + [stream[: size + 1] + b"\xff\xff\xff\xff" + stream[size + 5 :]]
    df = spark.createDataFrame(list(enumerate(broken)), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("media", T.BinaryType())]))
    found = {r.doc_id: r for r in media_columns.media_columns(df).collect()}
    assert all(found[i].problem and found[i].width is None for i in (*range(6), *range(9, 14))) and len(found) == 14
    assert found[13].problem == "a scan too short for its frame"
    assert (found[6].problem, found[6].width, found[6].height) == (None, 12, 16)
    assert all((found[i].problem, found[i].thumbnail) == (None, found[6].thumbnail) for i in (7, 8))


def plain_jpeg(stream):
    """A reader of grey baseline images by its own loops, bit by bit: sides and the quantised coefficients of each image."""
    at, out = 0, []
    while at < len(stream):
        marker = stream[at + 1]
        at += 2
        if marker == 0xD8:
            tables, side, every = {}, None, 0
            continue
        if marker == 0xD9:
            continue
        size = int.from_bytes(stream[at : at + 2], "big")
        body = stream[at + 2 : at + size]
        at += size
        if marker == 0xC0:
            side = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
        elif marker == 0xDD:
            every = int.from_bytes(body, "big")
        elif marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = table
        elif marker == 0xDA:
            data, stretches = bytearray(), []
            while stream[at] != 0xFF or stream[at + 1] == 0 or 0xD0 <= stream[at + 1] <= 0xD7:
                if stream[at] == 0xFF and stream[at + 1]:
                    stretches.append(bytes(data))
                    data.clear()
                    at += 2
                    continue
                data.append(stream[at])
                at += 1 + (stream[at] == 0xFF)
            stretches.append(bytes(data))
            blocks = []
            for part in stretches:
                bits, place, last = "".join(f"{b:08b}" for b in part), 0, 0

                def symbol(table):
                    nonlocal place
                    for length in range(1, 17):
                        if (length, int(bits[place : place + length], 2)) in table:
                            place += length
                            return table[length, int(bits[place - length : place], 2)]
                    raise AssertionError("no code")

                def number(n):
                    nonlocal place
                    v = int(bits[place : place + n] or "0", 2)
                    place += n
                    return v if not n or v >> (n - 1) else v - (1 << n) + 1

                for _ in range(every):
                    last += number(symbol(tables[0x00]))
                    block = [last]
                    while len(block) < 64:
                        s = symbol(tables[0x10])
                        block += [0] * (s >> 4) + [number(s & 15)]
                    blocks.append(block)
            out.append((side, blocks))
    return out


def test_media_against_another_reader(docs):
    got = {r.doc_id: r for r in media_columns.text_media_digests(docs).collect()}
    media = {r.doc_id: bytes(r.media) for r in media_columns.stored_texts(docs).collect()}
    short = sorted((len(t), i, t) for i, t in texts(docs))[:90]
    for _, i, t in short:
        assert (len(media[i]), hashlib.sha256(media[i]).hexdigest()) == (got[i].media_bytes, got[i].media_sha256)
        ((side, blocks),) = plain_jpeg(media[i])
        back = bytes(v + 128 if v < 0 else v + 127 for b in blocks for v in b)
        assert hashlib.sha256(back).hexdigest() == got[i].payload_sha256 and back.startswith(t.encode())
        wide, high = side[0] // 8, side[1] // 8
        grey = [[min(255, max(0, round(b[0] / 8) + 128)) for b in blocks[y * wide : (y + 1) * wide]] for y in range(high)]
        small = [grey[y * high // 8][x * wide // 8] for y in range(8) for x in range(8)]
        bits = "".join(str(int(64 * v >= sum(small))) for v in small)
        assert got[i].feature == f"{side[0]}x{side[1]}/1:{int(bits, 2):016x}"


def test_a_component_in_a_scan_of_its_own(spark):
    """Grey is read from the first component's scan, wherever the others are."""
    (grey,) = jpeg.store([bytes(range(64, 128)) * 9])
    sof = grey.index(bytes([0xFF, jpeg.SOF0]))
    sos = grey.index(bytes([0xFF, jpeg.SOS]))
    frame = grey[sof : sof + 9] + b"\x02\x01\x11\x00\x02\x11\x00"
    two = grey[:sof] + frame[:2] + (14).to_bytes(2, "big") + frame[4:] + grey[sof + 13 : sos]
    scan, other = grey[sos:-2], grey[sos:-2].replace(b"\xff\xda\x00\x08\x01\x01", b"\xff\xda\x00\x08\x01\x02")
    df = spark.createDataFrame([(0, bytearray(grey)), (1, bytearray(two + scan + other + b"\xff\xd9")), (2, bytearray(two + other + scan + b"\xff\xd9"))], "doc_id long, media binary")
    found = [(r.width, r.height, bytes(r.thumbnail), r.problem) for r in media_columns.media_columns(df).orderBy("doc_id").collect()]
    assert found[0] == found[1] == found[2] and found[0][:2] == (24, 24) and found[0][3] is None


# Shared


def test_words_and_shingles():
    t = ["A b  c\nd e f", "", "x", " a b c d e "]
    shingle, doc, first = textvec.shingle_hashes(t)
    assert doc.tolist() == [0, 0, 2, 3] and first.tolist() == [0, 1, 0, 0]
    assert shingle[0] == shingle[3] and len(set(shingle.tolist())) == 3
    assert pd.Series([len(x) for x in textvec.slices(["aa"] * 10, 4)]).eq(2).all()


def test_rows_of_tiles_grow_with_the_members(spark):
    """Texts that are all alike share nearly all bands: what is dealt for tiles of 128 at twice the texts is about twice as much; and none is apart after the first step."""
    made = {}
    for n in (600, 1200, 2400):
        words = [f"w{k}" for k in range(400)]
        df = spark.createDataFrame([(i, " ".join(words[:200] + [f"own{i}"] + words[200:])) for i in range(n)], "doc_id long, text string")
        counted = []
        real = near_duplicates.in_tiles
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near_duplicates, "in_tiles", lambda tiles, *a: counted.append(tiles.count()) or real(tiles, *a))
            got = near_duplicates.near_duplicate_classes(df, tile_nodes=128).collect()
        assert {r.class_id for r in got} == {0} and len(got) == n
        made[n] = counted[0]
        assert len(counted) == 2  # candidates and whole multisets, and no second step of either
    assert made[1200] <= 2.2 * made[600] and made[2400] <= 2.2 * made[1200], made


def test_one_stays_whatever_columns_are_named(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(2, text, 1), (1, text, 2), (1, text, 3), (5, "another text", 4), (None, "a third", 5)], "doc_id long, text string, n int")
    named = df.withColumns({c: F.col("n") for c in ("_rid", "_key", "_other", "_place", "rid", "key", "other", "place", "row", "class_id", "keeper", "stands", "least")})
    kept = near_duplicates.keep_one(named)
    assert kept.columns == named.columns and sorted((r.doc_id or 0, r.text, r._key == r.n == r.row) for r in kept.collect()) == [(0, "a third", True), (1, text, True), (5, "another text", True)]
