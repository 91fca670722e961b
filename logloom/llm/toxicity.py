"""Operator 5: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Texts, kept_rows, over_texts, rows, whole_texts
from logloom.llm.samples import collected, sampled
from logloom.llm.textvec import Batch, ragged, slices

BUCKETS, DIM, WINDOW, STRIDE = 1 << 17, 8, 8, 4
GRAMS = (3, 4, 5)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word between brackets, and of the whole, word by word; how many each has."""
    buckets, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(0, len(words), 5_000):
        batch = Batch.of([f"<{w}>" for w in words[a : a + 5_000]])
        first, size = batch.starts[:-1], np.diff(batch.starts)
        starts, ends, owner = [first], [first + size], [np.arange(len(size))]
        for n in GRAMS:
            item, part = ragged(np.maximum(size - n + 1, 0) * (size > n))
            starts.append(first[item] + part)
            ends.append(starts[-1] + n)
            owner.append(item)
        owner = np.concatenate(owner)
        hashes = batch.span_hashes(np.concatenate(starts), np.concatenate(ends))
        buckets.append((hashes >> np.uint64(64 - 17)).astype(np.int32)[np.argsort(owner, kind="stable")])
        counts.append(np.bincount(owner, minlength=len(size)).astype(np.int32))
    return np.concatenate(buckets), np.concatenate(counts)


def word_means(gain: np.ndarray, bucket: np.ndarray, n_sub: np.ndarray) -> np.ndarray:
    """The mean gain of each word's subwords."""
    out = np.zeros(len(n_sub))
    first = np.cumsum(n_sub, dtype=np.int64) - n_sub
    for a in range(0, len(n_sub), 10_000):
        n = n_sub[a : a + 10_000]
        part = gain[bucket[first[a] : first[a] + int(n.sum())]]
        out[a : a + len(n)] = np.add.reduceat(part, first[a : a + len(n)] - first[a]) / n
    return out


@dataclass
class Words:
    """The different words of a batch of texts, and where they stand."""

    words: list[str]
    at: np.ndarray
    doc: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        hashes, docs, firsts, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for a, b in slices(texts, 250_000):
            batch = Batch.of([t.lower() for t in texts[a:b]])
            start, end, doc = batch.words()
            hashes.append(batch.span_hashes(start, end))
            docs.append(doc + a)
            new, first = np.unique(hashes[-1], return_index=True)
            firsts.append(new)
            chars = batch.chars
            words += [chars[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        different, at = np.unique(np.concatenate(firsts), return_index=True)
        return cls([words[i] for i in at.tolist()], np.searchsorted(different, np.concatenate(hashes)), np.concatenate(docs), len(texts))

    def windows(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, end, mean of value) of overlapping windows over each text; short texts have one, empty ones none."""
        per = np.bincount(self.doc, minlength=self.n_docs)
        n = np.where(per > 0, np.maximum(-(-(per - WINDOW) // STRIDE), 0) + 1, 0)
        doc, k = ragged(n)
        base = (np.cumsum(per) - per)[doc]
        begin = base + np.minimum(k * STRIDE, np.maximum(per[doc] - WINDOW, 0))
        end = np.minimum(begin + WINDOW, base + per[doc])
        total = np.append(0.0, np.cumsum(value[self.at]))
        return doc, begin, end, (total[end] - total[begin]) / np.maximum(end - begin, 1)

    def largest(self, value: np.ndarray) -> np.ndarray:
        """The largest window mean of each text, 0 for an empty one."""
        doc, _, _, mean = self.windows(value)
        out = np.full(self.n_docs, -np.inf)
        np.maximum.at(out, doc, mean)
        return np.where(np.isfinite(out), out, 0.0)


@dataclass
class Model:
    """gain: what each bucket adds to the logit of label 1; scale and shift turn a text's largest window into its logit."""

    gain: np.ndarray
    scale: float
    shift: float

    def largest(self, words: Words) -> np.ndarray:
        return words.largest(word_means(self.gain, *subwords(words.words)))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in slices(texts):
            out.append(sigmoid(self.scale * self.largest(Words.of(texts[a:b])) + self.shift))
        return np.concatenate(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(bucket: np.ndarray, n_sub: np.ndarray, words: Words, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """For each bucket, by how many standard errors the share of texts with it is larger for label 1; at least 0."""
    first = np.cumsum(n_sub, dtype=np.int64) - n_sub
    ends = np.append(0, np.cumsum(np.bincount(words.doc, minlength=len(y))))
    seen = np.zeros((2, BUCKETS))
    for d in np.flatnonzero(use).tolist():
        own = np.unique(words.at[ends[d] : ends[d + 1]])
        item, part = ragged(n_sub[own].astype(np.int64))
        seen[y[d], np.unique(bucket[first[own][item] + part])] += 1
    n1, n0 = max(int(y[use].sum()), 1), max(int((1 - y[use]).sum()), 1)
    share = (seen.sum(0) + 1) / (n1 + n0 + 2)
    return np.maximum((seen[1] / n1 - seen[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)), 0)


def fit(texts: list[str], labels: list[int], rounds: int = 12, rate: float = 1.0, decay: float = 1e-3, seed: int = 5, share_of_1: float | None = None) -> Model:
    """Embeddings and softmax together, by gradient steps on minibatches of windows.

    A text is scored by its window of most toxic score, so it is trained by that window: at first the one of most telling subwords,
    then the one that the model so far finds. Clean texts give a further window at random. A fifth of the texts is kept apart to
    fit scale and shift, as if label 1 had the share it has in all labels. With one label only, or no texts, every score is the share of label 1.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 0.0, float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -30, 30)))
    random = np.random.default_rng(seed)
    words = Words.of(texts)
    bucket, n_sub = subwords(words.words)
    first = np.cumsum(n_sub, dtype=np.int64) - n_sub
    apart = np.zeros(len(y), bool)
    for k in (0, 1):
        own = random.permutation(np.flatnonzero(y == k))
        apart[own[: len(own) // 5]] = True
    embed, soft, bias = np.zeros((BUCKETS, DIM)), random.normal(0, 0.3, (DIM, 2)), np.zeros(2)

    def step(begin: np.ndarray, end: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal soft, bias
        span, part = ragged(end - begin)
        used, at = np.unique(words.at[begin[span] + part], return_inverse=True)
        item, sub = ragged(n_sub[used].astype(np.int64))
        where = bucket[first[used][item] + sub]
        vector = np.add.reduceat(embed[where], np.cumsum(n_sub[used]) - n_sub[used]) / n_sub[used][:, None]
        size = (end - begin)[:, None]
        hidden = np.add.reduceat(vector[at], np.cumsum(size) - size[:, 0]) / size
        logits = hidden @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        p *= weight[:, None]
        back = p @ soft.T
        times = np.bincount(where, np.bincount(at, minlength=len(used))[item], BUCKETS)
        for d in range(DIM):
            of_word = np.bincount(at, back[span, d], len(used))
            embed[:, d] -= rate * (np.bincount(where, of_word[item], BUCKETS) / (times + 4) + decay * embed[:, d] * (times > 0))
        soft = soft - rate * (hidden.T @ p / len(label))
        bias = bias - rate * p.mean(0)

    gain = telling(bucket, n_sub, words, y, ~apart)
    for r in range(rounds):
        doc, begin, end, mean = words.windows(word_means(gain, bucket, n_sub))
        ranked = np.lexsort((-mean, doc))
        top = ranked[np.append(True, doc[ranked][1:] != doc[ranked][:-1])] if len(doc) else ranked
        other = random.permutation(np.flatnonzero(y[doc] == 0))[: len(top)]
        use = np.concatenate([top, other])
        use = random.permutation(use[~apart[doc[use]]])
        share = max(y[doc[use]].mean(), 1e-3)
        weight = np.where(y[doc[use]] == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3))
        for a in range(0, len(use), 128):
            part = use[a : a + 128]
            step(begin[part], end[part], y[doc[part]], weight[a : a + 128], rate * (1 - r / rounds))
        gain = embed @ (soft[:, 1] - soft[:, 0])
    model = Model(gain.astype(np.float32), 1.0, float(bias[1] - bias[0]))
    x = words.largest(word_means(model.gain, bucket, n_sub))
    held = apart if len(set(y[apart].tolist())) == 2 else ~apart
    now = y[held].mean()
    there = now if share_of_1 is None else share_of_1
    model.scale, model.shift = calibrated(x[held], y[held], np.where(y[held] == 1, there / now, (1 - there) / (1 - now)))
    return model


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through weighted (x, y), with a little weight against steepness, by Newton's method."""
    spread = max(float(x.std()), 1e-6)
    z = np.stack([(x - x.mean()) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    ridge = np.array([2e-3, 1e-5])
    for _ in range(50):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) / len(y) + ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge)
        w = w - np.clip(np.linalg.solve(curve + 1e-9 * np.eye(2), gradient), -2, 2)
    scale = max(float(w[0]), 1e-3) / spread
    return scale, float(w[1]) - scale * float(x.mean())


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, most_each: int = 2000, most_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most most_each labelled texts of either label, of most_chars characters in all, half for either, none of them held out.

    Rows without a label or id are not used, nor are ids whose labels contradict each other. Of several texts with one id the first in the order of code points counts.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    n = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    one, zero = (sampled(chosen.where(F.col("label") == k), "doc_id", n.get(k, 0), most_each, 11 + k) for k in (1, 0))
    some = one.unionAll(zero)
    found = collected(whole_texts(docs, id_col, text_col).join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), most_chars, "label").sort_values("doc_id")
    return fit(found.text.tolist(), found.label.tolist(), share_of_1=n.get(1, 0) / max(sum(n.values()), 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text, null counting as empty; held_out is null where the id is. Equal texts have equal scores, rows that repeat are scored each, an empty table gives no rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(texts: Texts) -> Iterator[pa.RecordBatch]:
        for doc_ids, part in texts:
            s = model.scores(part)
            yield rows(schema, doc_ids, s, (s >= 0.5).astype(np.int32))

    out = over_texts(whole_texts(docs, id_col, text_col), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text the model does not predict toxic."""
    return kept_rows(docs, text_col, lambda texts: model.scores(texts) < 0.5)
