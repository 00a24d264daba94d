"""Quality rules: a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted: one over every
document, one over the trusted ones (all their labels say quality 1; half of them, by checksum of the id).
A document's score is the mean over its n-grams of log(target / raw), in whole millionths, so that it depends
on no order of addition. The threshold does best on the labelled documents of the
other half, where wrongly rejecting a good one costs more; it is the same for every document.

Defined cases: a null or wordless text has no n-grams and fails the base rule; texts of any length are counted and scored whole;
documents that score alike are judged alike, and of thresholds that do equally well the lowest is taken; repeated rows are judged alike
and all count; with no trusted or no bad labelled document nothing is rejected beyond the base rule; an
empty table gives an empty result; rows with a null id are judged like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alone, remembered, set_batches, shielded, small, without, written

BUCKETS = 1 << 16
UNIT = 1_000_000
SPACES = " \t\n\x0b\x0c\r"
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TOP = np.uint64(48)

_hashes = remembered(WordHashes())


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each word's text number. Bytes split at exactly the six white-space characters."""
    own = [t.encode().split() for t in texts]
    counts = np.array([len(w) for w in own], np.int64)
    flat = np.fromiter(map(alone(_hashes).__getitem__, chain.from_iterable(own)), np.uint64, int(counts.sum()))
    return flat, np.repeat(np.arange(len(texts)), counts)


def grams(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and adjacent pairs, and their texts."""
    pair = doc[1:] == doc[:-1]
    pairs = (h[:-1][pair] * _B + h[1:][pair]) * _A
    return np.concatenate([h >> _TOP, pairs >> _TOP]).astype(np.int64), np.concatenate([doc, doc[1:][pair]])


def repeated(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a window of three found twice or more in it."""
    if len(h) < 3:
        return np.zeros(n, np.int64)
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    key = ((h[whole] * _A + h[whole + 1]) * _B + h[whole + 2]) * _C + doc[whole].astype(np.uint64) * _B
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[whole[twice] + k] = True
    return np.bincount(doc[inside], minlength=n)


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def trusted_half(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted documents that make the target, and (id, quality) of the labelled ones that set the threshold."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    return one.filter((F.col("quality") == 1) & (half == 0)).select("doc_id"), one.filter(half == 1)


def count_grams(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """[bucket, (target, raw)] over every whole text. A task sends one row for each bucket it met."""
    flagged = docs.join(trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_t")), F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_t", F.lit(False)).alias("t"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            h, doc = words([t or "" for t in b.column(0).to_pylist()])
            bucket, of = grams(h, doc)
            target = np.array(b.column(1).to_pylist(), bool)
            total[1] += np.bincount(bucket, minlength=BUCKETS)
            total[0] += np.bincount(bucket[target[of]], minlength=BUCKETS)
        met = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[0, met]), pa.array(total[1, met])], ["bucket", "target", "raw"])

    out = np.zeros((BUCKETS, 2), np.int64)
    for r in flagged.mapInArrow(kernel, "bucket int, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect():
        out[r[0]] = r[1], r[2]
    return out


def ratios(counts: np.ndarray, prior: int = BUCKETS // 8) -> np.ndarray:
    """Log ratio of each bucket, in whole millionths; all 0 without a target.

    The raw multinomial is smoothed by one count a bucket, the target by `prior` counts dealt as in the raw one, so
    that a bucket which the target had no chance to hold weighs little.
    """
    target, raw = counts[:, 0].astype(float), counts[:, 1].astype(float)
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    p = (raw + 1) / (raw.sum() + BUCKETS)
    return np.rint(UNIT * np.log((target + prior * p) / ((target.sum() + prior) * p))).astype(np.int64)


METRICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, score double"


def measure(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """`docs` (with text) and METRICS of each whole text; score is the mean log ratio, 0 without words."""
    set_batches(docs.sparkSession)
    at = docs.columns.index("text")
    names = [x.split()[0] for x in METRICS.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            n = len(texts)
            h, doc = words(texts)
            bucket, of = grams(h, doc)
            sums = np.bincount(of, weights=ratio[bucket].astype(float), minlength=n)  # whole numbers: exact
            made = [
                np.bincount(doc, minlength=n),
                np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
                np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
                np.array([dup_lines(t) for t in texts], np.int64),
                repeated(h, doc, n),
                sums / UNIT / np.maximum(1, np.bincount(of, minlength=n)),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], names=[*b.schema.names, *names])

    return docs.mapInArrow(kernel, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [METRICS]))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def threshold(scored: DataFrame, cost_of_good: float = 20.0) -> float:
    """The score bound, in hundredths, that errs least on (score, quality): the middle of the first stretch of equals; -inf if either kind lacks."""
    bins: dict[int, list[int]] = {}
    for b, q, n in scored.groupBy(F.floor(F.col("score") * 100).cast("int"), "quality").count().collect():
        bins.setdefault(b, [0, 0])[1 if q == 1 else 0] += n
    bad, good = (sum(x[k] for x in bins.values()) for k in (0, 1))
    if not bad or not good:
        return float("-inf")
    best, stretch, rejected, met = 1.0, None, [0, 0], sorted(bins)
    for b, after in zip(met, [*met[1:], met[-1] + 1], strict=True):
        rejected = [rejected[k] + bins[b][k] for k in (0, 1)]
        loss = (bad - rejected[0]) / bad + cost_of_good * rejected[1] / good
        if loss < best:  # any bound from above this bin to the next one errs alike
            best, stretch = loss, (b + 1, after)
    return float("-inf") if stretch is None else (stretch[0] + stretch[1]) / 200


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The bucket ratios and the threshold. docs: doc_id, text; labels: doc_id, quality."""
    set_batches(docs.sparkSession)
    trusted, held_out = (small(written(x, "labels"), 16) for x in trusted_half(labels))
    ratio = ratios(count_grams(docs, trusted))
    if not ratio.any():
        return ratio, float("-inf")
    scored = measure(docs.join(held_out, "doc_id").select("text", "quality"), ratio).filter(~base_failed())
    return ratio, threshold(scored)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of `docs`, METRICS, base_failed and kept; a column of `docs` with such a name gives way."""
    names = [*(x.split()[0] for x in METRICS.split(", ")), "base_failed", "kept"]
    safe, restored = shielded(without(docs, names))
    ratio, least = fit(safe.select("doc_id", "text"), labels.select("doc_id", "quality"))
    made = measure(safe, ratio).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
    return restored(made, *names)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, whatever these are called."""
    safe, restored = shielded(docs)
    return restored(judge(safe, labels).filter("kept"))
