"""Operator 10: quality by weak labellers, expectation-maximisation and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Texts, kept_rows, over_texts, rows, text_slices, whole_texts
from logloom.llm.samples import collected, sampled
from logloom.llm.textvec import LETTER, OTHER, SPACE, Batch, mix, shingles_of, slices
from logloom.llm.toxicity import sigmoid

GOOD, NONE, BAD = 0, 1, 2
_SHAPE_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Each labeller: a measure, and below or above which values it votes; between them it does not vote.
LABELLERS: dict[str, tuple[float, float]] = {
    "upper_share": (0.25, 0.5),
    "odd_share": (0.02, 0.05),
    "shout_rate": (0.05, 0.2),
    "bar_rate": (0.02, 0.15),
    "trailing_marks": (0.02, 0.15),
    "repeat_share": (0.1, 0.3),
    "stutter": (0.05, 0.25),
    "word_length": (9.0, 14.0),
    "sentence_words": (40.0, 150.0),
    "brevity": (0.1, 0.5),
}


def repeats(run: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which runs of words their text has had before."""
    order = np.argsort(mix(run + owner.astype(np.uint64) * _SHAPE_STEP))
    again = np.zeros(len(run), bool)
    again[order[1:]] = (run[order][1:] == run[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return again


def measures(batch: Batch, n_docs: int) -> np.ndarray:
    """A row for each text with what LABELLERS looks at."""
    kind, chars = batch.classes(), batch.chars
    total = lambda flag: (c := np.append(0, np.cumsum(flag, dtype=np.int64)))[batch.starts[1:]] - c[batch.starts[:-1]]
    start, end, doc = batch.words()
    words = np.bincount(doc, minlength=n_docs)
    per_word = np.maximum(words, 1)
    letters = total(kind == LETTER)
    upper = total((chars >= ord("A")) & (chars <= ord("Z")))
    plain = np.isin(chars, np.array([ord(c) for c in ".,;:'\"?!()-"], np.uint32))
    solid = np.maximum(total(kind != SPACE), 1)
    last = chars[end - 1] if len(end) else chars[:0]
    odd_end = (kind[end - 1] == OTHER) & ~np.isin(last, np.array([ord(c) for c in ".,;:'\"?)"], np.uint32)) & (end - start > 1) if len(end) else np.zeros(0, bool)
    stops = total(np.isin(chars, np.array([ord(c) for c in ".!?"], np.uint32)))
    hashes = batch.span_hashes(start, end)
    stutter = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))[: len(doc)]
    shingle, owner, _ = shingles_of(hashes, doc, n_docs, 3)
    every = np.maximum(np.bincount(owner, minlength=n_docs), 1)
    columns = {
        "upper_share": upper / np.maximum(letters, 1),
        "odd_share": total((kind == OTHER) & ~plain) / solid,
        "shout_rate": total(chars == ord("!")) / per_word,
        "bar_rate": total(chars == ord("|")) / per_word,
        "trailing_marks": np.bincount(doc, odd_end, n_docs) / per_word,
        "repeat_share": np.bincount(owner, repeats(shingle, owner), n_docs) / every,
        "stutter": np.bincount(doc, stutter, n_docs) / per_word,
        "word_length": solid / per_word,
        "sentence_words": words / np.maximum(stops, 1),
        "brevity": 1 / np.maximum(words, 1),
    }
    return np.stack([columns[k] for k in LABELLERS], 1)


def patterns(measured: np.ndarray) -> np.ndarray:
    """The votes of all labellers as digits of a number to base 3."""
    low, high = np.array(list(LABELLERS.values())).T
    votes = np.where(measured <= low, GOOD, np.where(measured >= high, BAD, NONE))
    return votes @ 3 ** np.arange(len(low))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class Posterior:
    """What expectation-maximisation found: the share of good texts, and how each labeller votes on good and on bad ones."""

    share: float
    table: np.ndarray  # [good or bad, labeller, vote]

    def __call__(self, pattern: np.ndarray) -> np.ndarray:
        """The probability that texts of such votes are good."""
        votes = votes_of(pattern)
        log = np.log(self.table[:, np.arange(votes.shape[1]), votes]).sum(2)
        prior = np.log([self.share, 1 - self.share])
        return sigmoid(log[0] + prior[0] - log[1] - prior[1])


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> Posterior:
    """Accuracies of the labellers from how often each pattern of votes occurs.

    It starts from the opinion that a text on which any labeller votes bad is likely bad. A labeller's votes are smoothed
    towards being right, so that one that never votes says little.
    """
    votes = votes_of(pattern)
    good = np.where((votes == BAD).any(1), 0.15, 0.95)
    prior = np.array([[[8, 1.5, 0.5]], [[3, 1.5, 5.5]]])
    found = Posterior(0.5, np.full((2, votes.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        table = np.empty_like(found.table)
        for k, weight in enumerate((count * good, count * (1 - good))):
            for v in (GOOD, NONE, BAD):
                table[k, :, v] = (weight[:, None] * (votes == v)).sum(0)
        table += prior
        table /= table.sum(2, keepdims=True)
        share = float(((count * good).sum() + 9) / (count.sum() + 10))
        found = Posterior(min(share, 0.999), table)
        new = found(pattern)
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return found


BITS = 14


def features(batch: Batch, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of hashed features: shapes of words and of neighbouring words, and whether words repeat earlier ones.

    A word's shape has a sign for upper-case, lower-case and other letters and digits, other characters as they are, and no sign twice in a row.
    """
    start, end, doc = batch.words()
    if not len(start):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    kind, chars = batch.classes(), batch.chars
    sign = np.where(kind == LETTER, np.where((chars >= 65) & (chars <= 90), 1, 2), np.where(kind == OTHER, chars, kind)).astype(np.uint32)
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[start] = True
    place = np.append(0, np.cumsum(keep))
    shape = Batch(sign[keep], np.array([0, int(keep.sum())])).span_hashes(place[start], place[end])
    next_to = np.append(shape[1:], np.uint64(0))
    inside = np.append(doc[1:] == doc[:-1], False)
    run, owner, _ = shingles_of(batch.span_hashes(start, end), doc, n_docs, 3)
    again = repeats(run, owner)
    hashes = np.concatenate([shape, mix(shape * _SHAPE_STEP + next_to)[inside], again.astype(np.uint64) + np.uint64(7)])
    of = np.concatenate([doc, doc[inside], owner])
    share = 1 / np.maximum(np.bincount(doc, minlength=n_docs), 1)
    return of, (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64), share[of]


@dataclass
class Scorer:
    """A linear score over hashed features; its logit is over 0 for good texts."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in slices(texts):
            of, bucket, share = features(Batch.of(texts[a:b]), b - a)
            out.append(sigmoid(np.bincount(of, self.weight[bucket] * share, b - a) + self.bias))
        return np.concatenate(out)


def fit_scorer(texts: list[str], good: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on the posterior labels, by AdaGrad over all texts at once."""
    if not len(texts):
        return Scorer(np.zeros(1 << BITS), 3.0)
    pairs, values = [], []
    for a, b in slices(texts, 250_000):
        of, bucket, share = features(Batch.of(texts[a:b]), b - a)
        pair, at = np.unique((of + a) << BITS | bucket, return_inverse=True)
        pairs.append(pair)
        values.append(np.bincount(at, share))
    pair, value = np.concatenate(pairs), np.concatenate(values)
    of, bucket = pair >> BITS, pair & (1 << BITS) - 1
    weight, bias, seen, seen_bias = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    balance = np.where(good >= 0.5, 0.5 / max((good >= 0.5).mean(), 1e-2), 0.5 / max((good < 0.5).mean(), 1e-2))
    balance /= balance.mean()
    for _ in range(rounds):
        error = balance * (sigmoid(np.bincount(of, weight[bucket] * value, len(texts)) + bias) - good) / len(texts)
        g = np.bincount(bucket, error[of] * value, 1 << BITS) + decay * weight / len(texts)
        seen += g**2
        weight -= rate * g / np.sqrt(seen) * 0.3
        b = error.sum()
        seen_bias += b**2
        bias -= rate * b / np.sqrt(seen_bias) * 0.3
    return Scorer(weight, float(bias))


def pattern_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """How many texts of the whole table have each pattern of votes; there are at most 3 to the number of labellers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for _, texts in text_slices(batches):
            for a, b in slices(texts):
                for p, n in zip(*np.unique(patterns(measures(Batch.of(texts[a:b]), b - a)), return_counts=True), strict=True):
                    found[int(p)] = found.get(int(p), 0) + int(n)
        yield rows(pa.schema([("pattern", pa.int64()), ("n", pa.int64())]), list(found), list(found.values()))

    texts = docs.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    return counted.pattern.to_numpy(np.int64), counted.n.to_numpy(np.float64)


def trained(docs: DataFrame, most: int = 4000, most_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[Posterior, Scorer]:
    """The labellers' accuracies from the votes on all texts, and a scorer fitted to their posterior labels of at most most rows, of most_chars characters in all.

    Rows are sampled by id and text, so copies of a text count as often as they are.
    """
    pattern, count = pattern_counts(docs, text_col)
    posterior = expectation_maximisation(pattern, count)
    some = sorted(collected(sampled(whole_texts(docs, id_col, text_col), ["doc_id", "text"], int(count.sum()), most, 13), most_chars).text)
    measured = [measures(Batch.of(some[a:b]), b - a) for a, b in slices(some, 250_000)]
    good = posterior(patterns(np.concatenate(measured))) if measured else np.zeros(0)
    return posterior, fit_scorer(some, good)


def score(docs: DataFrame, model: tuple[Posterior, Scorer], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, posterior, score, predicted) of each whole text, null counting as empty: 1 is good, as the scorer finds it. Equal texts have equal scores, rows that repeat are scored each, an empty table gives no rows."""
    posterior, scorer = model
    schema = pa.schema([("doc_id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        for doc_ids, part in texts:
            measured = [measures(Batch.of(part[a:b]), b - a) for a, b in slices(part)]
            s = scorer.scores(part)
            yield rows(schema, doc_ids, posterior(patterns(np.concatenate(measured))), s, (s >= 0.5).astype(np.int32))

    return over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, posterior double, score double, predicted int")


def drop_bad(docs: DataFrame, model: tuple[Posterior, Scorer], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text, null counting as empty, the scorer takes as good; of rows that repeat all stay or none."""
    _, scorer = model
    return kept_rows(docs, text_col, lambda texts: scorer.scores(texts) >= 0.5)
