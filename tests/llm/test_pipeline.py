"""Stages of the pipeline and the registered queries."""

import collections
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom.llm import online_packing, toxicity, weak_quality

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"


def test_every_stage_by_plain_loops(spark):
    """Each stage on what the one before has left: scores by loops, classes by all pairs, and windows that hold the library's ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1))
    rows = lambda df: [(r.doc_id, r.text or "") for r in df.collect()]
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.schema == docs.schema
    _, scorer = weak_quality.trained(docs)
    assert sorted(rows(good)) == sorted(x for x in rows(docs) if brute.quality_score(scorer, x[1]) >= 0.5) and 0 < good.count() < docs.count()
    clean = corpus_pipeline.toxic(spark, good, SF)
    model = toxicity.trained(good, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(rows(clean)) == sorted(x for x in rows(good) if brute.toxic_score(model, x[1]) < 0.5)
    one = corpus_pipeline.deduplicated(spark, clean, SF)
    class_of = brute.classes(rows(clean))
    assert sorted(rows(one)) == sorted(x for x in rows(clean) if class_of[x[0]] == x[0]) and one.schema == docs.schema and one.count() < clean.count()
    assert_packed(corpus_pipeline.packed(spark, one, SF).collect(), rows(one))
    assert_packed(corpus_pipeline.run(spark, SF).collect(), rows(one))


def assert_packed(pieces, left):
    """Each document's ids lie in exactly one piece each, and windows are gapless and full but for powers of two."""
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    of, windows = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    assert set(of) == {d for d, _ in left}
    for d, text in left:
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(of[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    assert online_packing.SumOfSquares(8).capacity == 8
