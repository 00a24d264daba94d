"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's score is logistic in the words, and word beginnings, it holds; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents have labels: the likelihood of the bags trains the sentence weights, which then
point at the offending sentences. The model is fitted on a bounded sample of labelled rows: of each label, those
with the least hashes of their id, at most `per_label` documents and `max_chars` characters. Everything else
covers every whole text.

Defined cases: a null or wordless text has no sentence and scores 0; texts of any length are scored whole; of sentences that score alike the
first is the worst, and documents of one hash are sampled by id; repeated rows score alike; with labels
of one kind or none every score is 0; an empty table gives an empty result; a null id is not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_batches

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]")
_STOPS = frozenset(".!?\n")
_END = 1e9
#: Words whose weight a task remembers; beyond that they are worked out each time.
MEMO = 400_000


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int) -> list[tuple[str, int]]:
    """The training texts with their labels: a bounded number, whole texts all."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda y: one.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    chosen = F.broadcast(first(1).unionByName(first(0)))  # at most 2 * per_label rows
    sizes = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, ids = {0: max_chars // 2, 1: max_chars // 2}, {}
    for doc, y, n in sizes:
        if (n or 0) <= left[y]:
            left[y] -= n or 0
            ids[doc] = y
    if len(set(ids.values())) < 2:
        return []
    spark = docs.sparkSession
    keep = F.broadcast(spark.createDataFrame(list(ids.items()), "doc_id bigint, toxic int"))
    rows = docs.join(keep, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy("doc_id").collect()
    return [(r["text"] or "", r["toxic"]) for r in rows]


def features(word: str) -> list[str]:
    """The word itself and its beginnings of four to seven letters, which inflected forms share."""
    return [word] + ["^" + word[:k] for k in range(4, min(8, len(word)))]


def telling(tokens: list[list[str]], y: np.ndarray, least_docs: int, least_z: float) -> dict[str, int]:
    """Numbers of the features held by so many more toxic documents than chance would have it; the others get no weight."""
    df = [Counter(f for own, of in zip(tokens, y, strict=True) if of == k for f in {f for w in set(own) - _STOPS for f in features(w)}) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    keep = []
    for w, own in df[1].items():
        p = (own + df[0][w]) / sum(n)
        if own >= least_docs and own / n[1] - df[0][w] / n[0] >= least_z * np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1])):
            keep.append(w)
    return {w: i for i, w in enumerate(sorted(keep))}


def train(texts: list[tuple[str, int]], least_docs: int = 5, least_z: float = 5.0, steps: int = 500, rate: float = 0.1, l2: float = 1e-5) -> tuple[dict[str, float], float]:
    """Word weights and the intercept, by gradient steps on the noisy-or likelihood; both labels weigh the same in all."""
    if len({y for _, y in texts}) < 2:
        return {}, -np.inf
    tokens = [_TOKEN.findall(t.lower()) for t, _ in texts]
    vocabulary = telling(tokens, np.array([y for _, y in texts]), least_docs, least_z)
    word, sentence, bag, s, held = [], [], [], -1, {}
    for d, own in enumerate(tokens):
        fresh = True
        for t in own:
            if t in _STOPS:
                fresh = True
                continue
            if fresh:
                s, fresh = s + 1, False
                bag.append(d)
            if t not in held:
                held[t] = [vocabulary[f] for f in features(t) if f in vocabulary]
            for i in held[t]:
                word.append(i)
                sentence.append(s)
    word, sentence, bag = (np.array(x, np.int64) for x in (word, sentence, bag))
    y = np.array([y for _, y in texts], float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(len(vocabulary)), -np.log(max(2.0, len(bag) / len(texts)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, weights=w[word], minlength=len(bag))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        a = np.maximum(np.bincount(bag, weights=np.logaddexp(0, z), minlength=len(y)), 1e-12)  # -log(1 - P)
        slope = weight * np.where(y == 1, -1 / np.expm1(np.minimum(a, 30)), 1.0)
        dz = slope[bag] * p
        g = np.append(np.bincount(word, weights=dz[sentence], minlength=len(w)) + l2 * w, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {t: float(w[i]) for t, i in vocabulary.items() if w[i]}, float(b)


class _Weights(dict):
    """A word's weight, the sum of its features'; sentence ends have their own mark."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(dict.fromkeys(_STOPS, _END))
        self.weights = weights

    def __missing__(self, word: str) -> float:
        x = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) < MEMO:
            self[word] = x
        return x


SCORES = "score double, n_sentences int, n_offending int, worst_start int, worst_end int"


def score(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """(doc_id, text) to doc_id and SCORES: how many sentences reach 0.5, and where the worst of those lies (code points)."""
    set_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Weights(weights).__getitem__
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                tokens = _TOKEN.findall((text or "").lower())
                x = np.fromiter(map(get, tokens), float, len(tokens))
                words = x != _END
                if not words.any() or not np.isfinite(intercept):
                    out.append((0.0, 0, 0, None, None))
                    continue
                of = np.cumsum(~words)[words]
                _, of = np.unique(of, return_inverse=True)
                z = intercept + np.bincount(of, weights=x[words])
                total, worst = 1 - np.exp(-np.logaddexp(0, z).sum()), int(z.argmax())
                bad = int((z >= 0).sum())
                span = (None, None)
                if bad:
                    span = [(m.start(), m.end()) for m in _SENTENCE.finditer(text) if _WORD.search(m[0].lower())][worst]
                out.append((float(total), len(z), bad, *span))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), *[pa.int32()] * 4), strict=True))], ["doc_id", *(c.split()[0] for c in SCORES.split(", "))])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, "doc_id bigint, " + SCORES)


def detect(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, SCORES and predicted for every document."""
    docs = docs.select("doc_id", "text")
    set_batches(docs.sparkSession)
    weights, intercept = train(sample(docs, labels.select("doc_id", "toxic"), per_label, max_chars))
    scored = score(docs, weights, intercept)
    return scored.select("doc_id", held_out().alias("held_out"), *(c.split()[0] for c in SCORES.split(", ")), (F.col("score") >= 0.5).cast("int").alias("predicted"))
