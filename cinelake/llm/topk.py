"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt by their length (norm) to stripes of bounded size, the longest first. Within a stripe they are ordered by
length and cut into buckets of similar length. A query walks the buckets from the longest. Its k-th
best score so far gives each bucket a local cosine threshold, score / (|q| * longest length in it): above 1
the walk ends; where it is high, coordinate pruning takes the vectors whose values in the query's
strongest coordinates can still reach it, from sorted lists; else length pruning takes those long enough. Only the
survivors' inner products are computed. All queries are answered in the longest stripe first; then each goes, with its k-th best score,
only to the stripes whose longest vector can still reach that, streamed through them in batches, and the
results are merged. Queries are a stated set; a stripe's index is all that a task holds.

Defined cases: components are floored after scaling and scores are exact long integers; vectors that are null or hold a
null, NaN or infinity, and rows with a null id, take no part; vectors of different dimension are not compared;
of rows with one id the least vector counts; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: A bucket's shortest vector has at least this share of its longest one's length.
SPREAD = 0.9
#: Rows in a bucket at most; a longer run of similar lengths makes several.
BUCKET = 1024
#: From this local threshold on coordinates prune better than lengths.
COORDINATE_FROM = 0.5
FOCUS = 3
_SLACK = 1e-9


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int, is_query: F.Column) -> DataFrame:
    """vec_id, v (floored whole numbers as doubles), dim, norm, asked."""
    ok = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"), is_query.alias("asked"))
    whole = rows.filter(F.col("vec_id").isNotNull()).filter(ok).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"), F.size("x").alias("dim"), "asked")
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray):
        self.ids, self.x, self.norms, self.longest = ids, x, norms, float(norms[0])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The order and values of coordinate f of the unit vectors, sorted; made when first asked for."""
        if f not in self.lists:
            unit = self.x[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = order, unit[order]
        return self.lists[f]

    def by_coordinate(self, unit: np.ndarray, focus: np.ndarray, t: float) -> np.ndarray:
        """Rows whose cosine with `unit` can reach t, judged by the focus coordinates one by one."""
        hits = np.zeros(len(self.ids), np.int8)
        for f in focus:
            c = unit[f]
            reach = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c)))
            low = -1.0 if c <= -t else c * t - reach
            high = 1.0 if c >= t else c * t + reach
            order, values = self.list_of(int(f))
            hits[order[np.searchsorted(values, low - _SLACK) : np.searchsorted(values, high + _SLACK, "right")]] += 1
        return np.flatnonzero(hits == len(focus))

    def by_length(self, least: float) -> slice:
        """Rows at least so long: a prefix."""
        return slice(0, int(np.searchsorted(-self.norms, -least * (1 - _SLACK), "right")))


class Index:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort([*x.T[::-1], ids])
        ids, x = ids[order], x[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
        ids, x = ids[first], x[first]
        norms = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort([ids, -norms])
        ids, x, norms = ids[order], x[order], norms[order]
        self.largest = float(np.abs(x).max(initial=0))
        self.buckets, start = [], 0
        while start < len(ids):
            stop = min(start + BUCKET, int(np.searchsorted(-norms, -norms[start] * SPREAD, "right")))
            self.buckets.append(Bucket(ids[start:stop], x[start:stop], norms[start:stop]))
            start = stop

    def search(self, query_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first; of those below `least` none need be among them."""
        length = float(np.sqrt(q @ q))
        unit = q / max(length, 1e-300)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2.0**53
        best: list[tuple[int, int]] = []
        for b in self.buckets:
            rows: np.ndarray | slice = slice(None)
            floor = max(least, best[-1][0]) if len(best) == k else least
            if floor > -np.inf:
                reach = length * b.longest
                if floor > reach * (1 + _SLACK):
                    break
                t = floor / reach if reach else 0.0
                if t >= COORDINATE_FROM:
                    rows = b.by_coordinate(unit, focus, min(t * (1 - _SLACK), 1.0))
                elif floor > 0 and length:
                    rows = b.by_length(floor / length)
            x, ids = b.x[rows], b.ids[rows]
            if not len(ids):
                continue
            scores = x @ q if exact else np.array([sum(int(a) * int(c) for a, c in zip(v, q, strict=True)) for v in x], object)
            keep = ids != query_id
            if floor > -np.inf:
                keep &= np.asarray(scores >= floor, bool)
            if keep.any():
                scores, ids = scores[keep], ids[keep]
                if exact and len(ids) > 4 * k:
                    bar = np.partition(scores, -k)[-k]
                    scores, ids = scores[scores >= bar], ids[scores >= bar]
                    top = np.lexsort([ids, -scores])[:k]
                    scores, ids = scores[top], ids[top]
                best = sorted([*best, *((int(s), int(i)) for s, i in zip(scores, ids, strict=True))], key=lambda r: (-r[0], r[1]))[:k]
        return best


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, stripe_rows: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row where `is_query` (over vec_id) holds."""
    rows = written(scaled(vectors, vec_id, vector, scale, is_query), "scaled")
    stripes = max(1, -(-rows.count() // stripe_rows))
    # lengths from which on a stripe starts, falling; a length that a third of all rows share has several stripes, by the id
    cuts = sorted(set(rows.approxQuantile("norm", [i / stripes for i in range(1, stripes)], 0.1 / stripes)), reverse=True) if stripes > 1 else []
    level = F.lit(0)
    for c in cuts:
        level = level + (F.col("norm") < c).cast("int")
    held = rows.withColumn("level", level)
    sizes = {r["level"]: (r["n"], r["longest"]) for r in held.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    order, starts, longest = sorted(sizes), {}, []
    for l in order:
        starts[l] = len(longest)
        longest += [sizes[l][1]] * max(1, -(-sizes[l][0] // stripe_rows))
    if not longest:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score"))
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for l in order for x in (l, values[l])]), F.col("level"))
    many = {l: max(1, -(-sizes[l][0] // stripe_rows)) for l in order}
    stripe = (pick(starts) + F.pmod(F.xxhash64("vec_id"), pick(many))).cast("int")
    candidates = held.select("vec_id", "v", "dim", stripe.alias("stripe"), F.lit(None).cast("double").alias("least"))
    # of rows with one id the least vector counts, in whichever stripe the others are: only that one is a candidate too
    twice = candidates.groupBy("vec_id").agg(F.count("*").alias("n"), F.min(F.struct("v", "dim", "stripe")).alias("s")).filter("n > 1")
    single = candidates.join(small(written(twice.select("vec_id"), "twice"), 16), "vec_id", "left_anti")
    candidates = single.unionByName(twice.select("vec_id", "s.v", "s.dim", "s.stripe", F.lit(None).cast("double").alias("least")))
    asked = rows.filter("asked").groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("s")).select("vec_id", "s.v", "s.dim", "s.norm")

    def found(queries: DataFrame, own: DataFrame) -> DataFrame:
        dealt = own.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True))).repartition(len(longest), "stripe").sortWithinPartitions("stripe", "dim", "query")
        return dealt.select("vec_id", "v", "dim", "stripe", "query", "least").mapInArrow(kernel, "query_id bigint, vec_id bigint, score bigint")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, held = None, None, []
        for b in batches:
            ids, dims, least = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(5).to_numpy(zero_copy_only=False)
            stripe, query = b.column(3).to_numpy(), np.array(b.column(4).to_pylist(), bool)
            cuts = np.flatnonzero((stripe[1:] != stripe[:-1]) | (dims[1:] != dims[:-1]) | (query[1:] != query[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                own, dim = (int(stripe[lo]), int(dims[lo])), int(dims[lo])
                if own != key:
                    key, index, held = own, None, []
                x = b.column(1).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, dim).astype(float)
                if not query[lo]:
                    held.append((ids[lo:hi], x))
                    continue
                if index is None:
                    index = Index(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])) if held else Index(np.zeros(0, np.int64), np.zeros((0, dim)))
                    held = []
                for i, q, bar in zip(ids[lo:hi].tolist(), x, least[lo:hi].tolist(), strict=True):
                    out += [(i, c, s) for s, c in index.search(i, q, k, -np.inf if bar is None or bar != bar else bar)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found(asked.select("vec_id", "v", "dim", F.lit(0).alias("stripe"), F.lit(None).cast("double").alias("least")), candidates.filter("stripe = 0"))
    if len(longest) > 1:
        best = written(best, "longest")
        bars = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bar")).select("vec_id", F.when(F.col("n") >= k, F.col("bar")).alias("least"))
        # lengths fall from stripe to stripe: those that a query can still use are the first so many
        bound = F.try_divide("least", "norm") * (1 - 1e-9)
        reach = F.size(F.filter(F.array(*[F.lit(x) for x in longest]), lambda x: F.coalesce(x >= bound, F.lit(True))))
        sent = asked.join(bars, "vec_id", "left").withColumn("stripe", F.explode(F.when(reach > 1, F.sequence(F.lit(1), reach - 1)).otherwise(F.array().cast("array<int>"))))
        best = best.unionByName(found(sent.select("vec_id", "v", "dim", "stripe", "least"), candidates.filter("stripe > 0")))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
