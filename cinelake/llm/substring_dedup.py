"""Substring dedup by sliding sentence spans.

A text is cut, without loss, into sentences. Every run of several consecutive sentences is hashed; of the places where
a run occurs anywhere in the corpus, the first by (doc_id, position) stays and the sentences of all others go.

A run has at least `width` sentences and `least` words: from each sentence on, and up to each sentence, the shortest
such run, so that a repeated passage is covered from its first whole sentence to its last. One or
two sentences of `long` words in all are a run too. Letter case and white space do not tell runs apart.

A passage that starts or ends inside a sentence, or has no sentences, may hold no whole run. So of what is left, every
stretch of `long` words that occurs again is found by its words: a hash of 26 of them is chosen from each stretch by its
content alone, and where that repeats the whole stretch is hashed. But for the first place, just its words go.

Counting first combines before its shuffle; only runs that repeat are joined with their places, so that no task
gathers a run's places, however common it is. Texts move once to meet their lost runs; marks of stretches, which are few, are
broadcast if their counted size is small, else texts move to them too.

Defined cases: a null text has no sentence and stays null; texts without a word stay as they are; texts of any length are hashed whole; of
rows that share an id, places are told apart by position alone, so that repeated rows keep what their first copy keeps, and a row whose
text has other words at a place loses nothing there; null ids come first; ties are broken by (doc_id, position); an empty
table gives an empty result; columns other than doc_id and text are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordHashes, alone, remembered, set_batches, shielded, without, written

WIDTH, LEAST, LONG = 3, 10, 50

_PIECE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


_WORD = re.compile(r"\S+")
#: Words of the part that is chosen from a stretch.
PART = 26

_hashes = remembered(WordHashes())


def cut(text: str) -> tuple[list[int], list[list[str]]]:
    """Starts of the sentences (the first is 0) and their words; a piece without words belongs to the sentence before."""
    starts, words = [], []
    for m in _PIECE.finditer(text):
        own = m[0].lower().split()
        if any(c.isalnum() for w in own for c in w):
            starts.append(m.start())
            words.append(own)
    if starts:
        starts[0] = 0
    return starts, words


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def runs(docs: list[list[list[str]]], width: int, least: int, long: int) -> tuple[np.ndarray, ...]:
    """(text number, first sentence, sentences) of all runs, and two hashes of each, of 64 and 32 bits."""
    n = np.array([len(d) for d in docs], np.int64)
    doc, total = np.repeat(np.arange(len(docs)), n), int(n.sum())
    first = np.repeat(np.cumsum(n) - n, n)  # of the sentence's text
    stop = first + np.repeat(n, n)
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(s)) for d in docs for s in d), np.uint64, total)
    size = np.fromiter((len(s) for d in docs for s in d), np.int64, total)
    words = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(total)
    # from each sentence on: the least end with enough sentences and words; up to each: the greatest start
    end = np.maximum(at + width, np.searchsorted(words, words[:-1] + least, "left"))
    start = np.minimum(at + 1 - width, np.searchsorted(words, words[1:] - least, "right") - 1)
    begins, ends = [at[end <= stop]], [end[end <= stop]]
    back = start >= first
    begins.append(start[back])
    ends.append(at[back] + 1)
    for k in range(1, width):
        own = at[at + k <= stop]
        own = own[words[own + k] - words[own] >= long]
        begins.append(own)
        ends.append(own + k)
    key = np.unique(np.concatenate(begins) * (total + 1) + np.concatenate(ends))
    b, e = np.divmod(key, total + 1)
    # a run's hash: a polynomial in its sentences' hashes, which are random already
    length = e - b
    h1, h2 = length.astype(np.uint64), length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(length.max(initial=0))):
            on = k < length
            x = h[b[on] + k]
            h1[on] = h1[on] * _A + _mix(x)
            h2[on] = h2[on] * _C + _mix(x * _A)
        h1, h2 = _mix(h1), _mix(h2)
    return doc[b] if total else b, b - first[b] if total else b, length, h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's begin, with the end."""
    own = [t.lower().split() for t in texts]
    ends = np.cumsum([0, *map(len, own)])
    return np.fromiter(map(alone(_hashes).__getitem__, chain.from_iterable(own)), np.uint64, int(ends[-1])), ends


def _sums(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of every `size` words in a row, of the words' hashes."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    back = np.uint64(pow(int(factor), -1, 1 << 64))
    powers = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(h), x))])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(factor)[:-1], dtype=np.uint64)])
    return _mix((total[size:] - total[:-size]) * powers(back)[: len(h) - size + 1])


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Place of the first least value of every `size` in a row, by windows that double."""
    at, k = np.arange(len(x)), 1
    while k < size:
        step = min(k, size - k)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        k += step
    return at


def chosen(h: np.ndarray, ends: np.ndarray, long: int) -> tuple[np.ndarray, ...]:
    """Of every `long` words in a row of the texts of `_words`: text number, first word, and hash and place of the part chosen from them."""
    part = min(PART, long)
    if len(h) < long:
        return (np.zeros(0, np.int64),) * 4
    parts = _sums(h, part, _A)
    place = _least(parts, long - part + 1)
    at = np.arange(len(place))
    doc = np.searchsorted(ends, at, "right") - 1
    on = at + long <= ends[doc + 1]
    at, doc, place = at[on], doc[on], place[on]
    return doc, at, parts[place].view(np.int64), place


PLACES = "h1 bigint, h2 int, doc_id bigint, pos int, n int"


def places(docs: DataFrame, width: int, least: int, long: int) -> DataFrame:
    """PLACES of all runs of (doc_id, text)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, pos, n, h1, h2 = runs([cut(t or "")[1] for t in b.column(1).to_pylist()], width, least, long)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), b.column(0).take(pa.array(doc)), pa.array(pos, pa.int32()), pa.array(n, pa.int32())], ["h1", "h2", "doc_id", "pos", "n"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, PLACES)


def _later(found: DataFrame, name: str) -> DataFrame:
    """Rows of `found` whose hashes have an earlier place, with the first: (doc_id, pos)."""
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("places")).filter(F.col("places") > 1).select("h1", "h2", "first")
    # a table of its own, so that a run with very many places can be split in the join; and a merge join at every
    # size: one that turned into a broadcast on small inputs would hide what large ones move
    return found.join(written(first, name).hint("merge"), ["h1", "h2"]).filter(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))


def removals(docs: DataFrame, width: int = WIDTH, least: int = LEAST, long: int = LONG) -> DataFrame:
    """doc_id, gone: for each document that loses any, its lost runs as (pos, n, h1)."""
    set_batches(docs.sparkSession)
    found = written(places(docs, width, least, long), "places")
    return _later(found, "repeated").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n", "h1")).alias("gone"))


def _held(marks: DataFrame, own: str, name: str) -> DataFrame:
    """A written table of (_id, marks), for broadcast where its counted marks fit."""
    marks = written(marks.select(F.col("doc_id").alias("_id"), F.col(own).alias("_own")), name)
    size = marks.agg(F.sum(32 + 40 * F.size("_own"))).first()[0] or 0
    return F.broadcast(marks) if size <= BROADCAST_BYTES else marks.hint("merge")


def repeated(cleaned: DataFrame, long: int = LONG) -> DataFrame:
    """doc_id, again: for each document that holds any, its stretches of `long` words that occur earlier, as (pos, start, h1): those
    that overlap their first place go from `start` on, where it ends. cleaned: doc_id, text, parts."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, own = [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            h, ends = _words(texts)
            doc, at, part, _ = chosen(h, ends, long)
            on = np.zeros(len(doc), bool)
            for i, parts in enumerate(own):
                s, e = np.searchsorted(doc, [i, i + 1])
                on[s:e] = np.isin(part[s:e], np.array(parts, np.int64))
            doc, at = doc[on], at[on]
            if len(doc):
                h1, h2 = (_sums(h, long, k)[at].view(np.int64) for k in (_B, _C))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), b.column(0).take(pa.array(doc)), pa.array((at - ends[doc]).astype(np.int32))], ["h1", "h2", "doc_id", "pos"])

    found = cleaned.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode("parts").alias("part"))
    common = found.groupBy("part").agg(F.count("*").alias("places")).filter(F.col("places") > 1).select("part")
    own = found.join(written(common, "parts").hint("merge"), "part").groupBy("doc_id").agg(F.collect_set("part").alias("own"))
    texts = cleaned.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(_held(own, "own", "holders"), F.col("doc_id").eqNullSafe(F.col("_id")))
    places = written(texts.select("doc_id", "text", "_own").mapInArrow(whole, "h1 bigint, h2 bigint, doc_id bigint, pos int"), "stretches")
    start = F.when(F.col("doc_id").eqNullSafe(F.col("first.doc_id")), F.greatest("pos", F.col("first.pos") + long)).otherwise(F.col("pos")).alias("start")
    return _later(places, "firsts").groupBy("doc_id").agg(F.collect_set(F.struct("pos", start, "h1")).alias("again"))


def _merged(lost: np.ndarray) -> list[tuple[int, int]]:
    """Spans of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in edges.reshape(-1, 2)]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    return "".join(text[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))


def _lost_sentences(texts: list[str], gone: pa.ListArray, width: int, least: int, long: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Of each text the spans of the sentences in lost runs, and how many these are. Runs that only another text of the same id holds do not count."""
    if not texts:
        return []
    cuts = [cut(t) for t in texts]
    doc, pos, n, h1, _ = runs([words for _, words in cuts], width, least, long)
    key = lambda doc, pos, n, h1: _mix(_mix(_mix(h1.astype(np.uint64) + _A) + pos.astype(np.uint64) * _C + n.astype(np.uint64)) + doc.astype(np.uint64))
    lost = gone.flatten()
    own = np.repeat(np.arange(len(texts)), np.diff(gone.offsets.to_numpy()))
    first, many, h = (lost.field(c).to_numpy().astype(np.int64) for c in ("pos", "n", "h1"))
    with np.errstate(over="ignore"):
        on = np.isin(key(own, first, many, h), key(doc, pos, n, h1))
    # a slot for each sentence and one after each text; runs open and close
    size = np.array([len(starts) for starts, _ in cuts], np.int64)
    base = np.cumsum(size + 1) - (size + 1)
    edge = np.zeros(int((size + 1).sum()) + 1, np.int64)
    np.add.at(edge, base[own[on]] + first[on], 1)
    np.add.at(edge, base[own[on]] + first[on] + many[on], -1)
    out, is_lost = [], np.cumsum(edge) > 0
    for k, (starts, _) in enumerate(cuts):
        mask, ends = is_lost[base[k] : base[k] + size[k]], [*starts, len(texts[k])]
        out.append(([(ends[s], ends[e]) for s, e in _merged(mask)] if mask.any() else [], int(mask.sum())))
    return out


def _lost_words(text: str, again: list[dict], long: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the words of lost stretches, and how many sentences these touch."""
    bounds = [*(m.start() for m in _WORD.finditer(text)), len(text)]
    h1, out = _sums(_words([text])[0], long, _B).view(np.int64), np.zeros(len(bounds) - 1, bool)
    for r in again:
        if r["pos"] < len(h1) and h1[r["pos"]] == r["h1"]:
            out[r["start"] : r["pos"] + long] = True
    spans = [(bounds[s], bounds[e]) for s, e in _merged(out)]
    starts = [*cut(text)[0], len(text)]
    return spans, max(sum(any(s < b and e > a for s, e in spans) for a, b in zip(starts, starts[1:], strict=False)), bool(spans))


def _in_old(spans: list[tuple[int, int]], gone: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """All that is lost, in the old text: `gone` of it, and `spans` of the `length` characters that were left."""
    lost = np.zeros(length + sum(e - s for s, e in gone), bool)
    for s, e in gone:
        lost[s:e] = True
    kept = np.flatnonzero(~lost)
    for s, e in spans:
        lost[kept[s:e]] = True
    return _merged(lost)


def _mapped(rows: DataFrame, fields: list, kernel: Callable[[pa.RecordBatch, dict], dict], more: str) -> DataFrame:
    """`rows` with the columns that `kernel` makes of a batch in place of those of the same name, and `more` at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = kernel(b, {n: b.column(i) for i, n in enumerate(b.schema.names)})
            columns = {f.name: made.pop(f.name, b.column(i)) for i, f in enumerate(fields)} | made
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [more] * bool(more)))


def _marked(b: dict) -> list[int]:
    """Rows that have both a text and marks."""
    return np.flatnonzero(pc.and_(b["_own"].is_valid(), b["text"].is_valid()).to_numpy(zero_copy_only=False)).tolist()


def _replaced(column: pa.Array, new: dict[int, object]) -> pa.Array:
    if not new:
        return column
    mask = np.zeros(len(column), bool)
    mask[list(new)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[k] for k in sorted(new)], column.type))


def dedup(docs: DataFrame, width: int = WIDTH, least: int = LEAST, long: int = LONG) -> DataFrame:
    """`docs` with the text cleaned, and n_removed (sentences that lost anything) and removed (start:end of what is lost in the
    old text, code points, comma-joined). n_chars follows where there is such a column; a column of `docs` with a result's
    name gives way."""
    docs, restored = shielded(without(docs, ["n_removed", "removed"]))
    joined = lambda spans: ",".join(f"{s}:{e}" for s, e in spans)

    def sentences(_: pa.RecordBatch, b: dict) -> dict:
        new, counts, removed = {}, np.zeros(len(b["text"]), np.int32), [""] * len(b["text"])
        marked = _marked(b)
        old = b["text"].take(pa.array(marked, pa.int64())).to_pylist()
        for k, text, (spans, counts[k]) in zip(marked, old, _lost_sentences(old, b["_own"].take(pa.array(marked, pa.int64())), width, least, long), strict=True):
            if spans:
                new[k], removed[k] = _without(text, spans), joined(spans)
        texts = _replaced(b["text"], new)
        h, ends = _words([t or "" for t in texts.to_pylist()])
        of, _, part, place = chosen(h, ends, long)
        # once for each place: neighbours mostly share theirs
        first = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(of, prepend=-1))
        parts = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[first], np.arange(len(texts) + 1)).astype(np.int32)), pa.array(part[first]))
        return {"text": texts, "n_removed": pa.array(counts), "removed": pa.array(removed, pa.string()), "parts": parts}

    def words(_: pa.RecordBatch, b: dict) -> dict:
        new, counts, removed = {}, {}, {}
        for k in _marked(b):
            text, gone = b["text"][k].as_py(), [tuple(map(int, r.split(":"))) for r in b["removed"][k].as_py().split(",") if r]
            spans, n = _lost_words(text, b["_own"][k].as_py(), long)
            if spans:
                new[k], counts[k], removed[k] = _without(text, spans), b["n_removed"][k].as_py() + n, joined(_in_old(spans, gone, len(text)))
        return {"text": _replaced(b["text"], new), "n_removed": _replaced(b["n_removed"], counts), "removed": _replaced(b["removed"], removed)}

    gone = written(removals(docs, width, least, long), "removals").select(F.col("doc_id").alias("_id"), F.col("gone").alias("_own"))
    at = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    cleaned = written(_mapped(docs.join(gone.hint("merge"), at, "left").drop("_id"), docs.schema.fields, sentences, "n_removed int, removed string, parts array<bigint>"), "cleaned")
    again = _held(repeated(cleaned, long), "again", "again")
    rows = cleaned.drop("parts")
    made = _mapped(rows.join(again, at, "left").drop("_id"), rows.schema.fields, words, "")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return restored(made, "n_removed", "removed")


def clean(docs: DataFrame) -> DataFrame:
    """`docs` with the texts cleaned, and all other columns, whatever these are called."""
    safe, restored = shielded(docs)
    return restored(dedup(safe))
