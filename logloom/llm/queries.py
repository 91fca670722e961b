"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bin_slack, bpe_codec, importance, lexical_search, license_scans, media_columns, multi_index, near_duplicates, online_packing, packed_matrices, token_counts, toxicity, weak_quality
from logloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices.pack_matrices(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op3_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_digests(read(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.license_scans(read(spark, sf_dir, "documents"), license_scans.STATEMENTS | license_scans.NOTICES)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.text_media_digests(read(spark, sf_dir, "documents"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return weak_quality.score(docs, weak_quality.trained(docs))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack_digests(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The CRC of a text's bytes, for engines without such a function: eight shifts for each byte.
SQL = {
    "op11_importance_resampling": r"""
WITH shift AS (SELECT list(crc ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) AS r(b))),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
gram AS (SELECT r, unnest(w) AS g FROM doc UNION ALL SELECT r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM doc WHERE len(w) > 1),
goal_gram AS (SELECT unnest(w) AS g FROM goal UNION ALL SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM goal WHERE len(w) > 1),
name AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM gram UNION SELECT g FROM goal_gram)),
byte AS (SELECT g, list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM name),
bucket AS (SELECT g, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM byte, shift),
s AS (SELECT k, count(*) AS s FROM gram JOIN bucket USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM goal_gram JOIN bucket USING (g) GROUP BY k),
total AS (SELECT (SELECT count(*) FROM gram) AS s, (SELECT count(*) FROM goal_gram) AS t),
gain AS (SELECT s.k, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k), total),
summed AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM gram JOIN bucket USING (g) JOIN gain USING (k) GROUP BY r),
weighed AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, floor(coalesce(total, 0) / greatest(coalesce(n, 0), 1))::BIGINT AS weight, ('0x' || sha256('7:' || doc_id)[:8])::BIGINT AS h FROM doc LEFT JOIN summed USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM placed
""",
    "op13_lexical_search": r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM doc WHERE len(w) > 0),
held AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM doc) GROUP BY r, term),
asked AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, term),
weight AS (SELECT term, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, total GROUP BY term, total.n),
scored AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * held.n * total.n) // total.l))))::BIGINT AS score FROM asked JOIN weight USING (term) JOIN held USING (term), total GROUP BY i, item_id, r, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
