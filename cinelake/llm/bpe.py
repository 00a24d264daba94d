"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace) over the vocabulary's byte strings. A whole pre-token
that lies in it, compared byte for byte, is its id. Tier two: a miss is merged from single bytes, kept as
a linked list, by a heap of (rank, place): the lowest rank first and, among equals, the leftmost.

Defined cases: a null text is the empty text, which has no ids; any text decodes to its own UTF-8 bytes;
very long pre-tokens take n log n steps; repeated rows and null ids keep their rows; an empty table gives
an empty result. Ids and merges are those of the rank file alone; there are no special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import set_batches, shielded

#: Pre-tokens whose ids a worker remembers; beyond that they are worked out each time.
MEMO = 400_000

# The letters, numbers and spaces among the first 256 code points.
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_S = "\t\n\x0b\x0c\r \x85\xa0"


def latin(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes spelt out for texts of the first 256 code points."""
    out, inside = [], False
    for token in re.findall(r"\\p\{[LN]\}|\\[sS]|\[\^?|\]|.", pattern, re.S):
        if token in ("[", "[^"):
            inside = True
        elif token == "]":
            inside = False
        elif token == r"\S":
            token = f"[^{_S}]"
        elif token in (r"\p{L}", r"\p{N}", r"\s"):
            chars = {"L": _L, "N": _N, "s": _S}[token[3] if "{" in token else "s"]
            token = chars if inside else f"[{chars}]"
        out.append(token)
    return re.compile("".join(out))


class Splitter:
    """Finds all pre-tokens; texts within the first 256 code points take the standard library's faster engine."""

    def __init__(self, pattern: str):
        self.fast, self.full = latin(pattern).findall, regex.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.full(text)
        return self.fast(text)


class PerfectHash:
    """Minimal perfect hash: a key's bucket has a displacement that sends all its keys to free slots."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n, self.m = max(1, len(keys)), max(1, len(keys) // load)
        self.shift, self.slot = [0] * self.m, [-1] * self.n
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.m)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.m].append((h, i))
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            d, own = 0, buckets[b]
            if len(own) < 2:
                break
            while True:
                places = [self._place(h, d) for h, _ in own]
                if len(set(places)) == len(places) and all(self.slot[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p, (_, i) in zip(places, own, strict=True):
                self.slot[p] = i
        free = (p for p in range(self.n) if self.slot[p] < 0)
        for b, own in enumerate(buckets):  # a bucket's only key needs no search: its slot itself is noted, as -1 - slot
            if len(own) == 1:
                p = next(free)
                self.shift[b], self.slot[p] = -1 - p, own[0][1]

    def _place(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def __getitem__(self, key: bytes) -> int:
        """The only index that `key` can have; the caller compares the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        return self.slot[self._place(h, d) if d >= 0 else -1 - d]


class Vocabulary:
    """Token strings by id, with both tiers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens, self.ids = list(ranks), list(ranks.values())
        self.index = PerfectHash(self.tokens)
        self.strings: list[bytes] = [b""] * (max(self.ids, default=-1) + 1)
        for t, i in ranks.items():
            self.strings[i] = t

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank(self, piece: bytes) -> int | None:
        i = self.index[piece]
        return self.ids[i] if i >= 0 and self.tokens[i] == piece else None

    def merge(self, piece: bytes, rank: _Ranks) -> list[int]:
        """Tier two. rank: what tier one says of byte strings."""
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank[piece[i : i + 2]]) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has grown or gone since
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank[piece[i : end[k]]]) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := rank[piece[h:stop]]) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [rank[piece[i:e]] for i, e in enumerate(end) if e]

    def encode(self, piece: bytes, ranks: _Ranks) -> list[int]:
        return [r] if (r := self.rank(piece)) is not None else self.merge(piece, ranks)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


class _Ranks(dict):
    """Byte string to rank or None; asks tier one for what it lacks."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: bytes) -> int | None:
        r = self.vocabulary.rank(piece)
        if len(self) < MEMO:
            self[piece] = r
        return r


class _Memo(dict):
    """Pre-token to ids; asks the vocabulary for what it lacks."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.ranks = vocabulary, _Ranks(vocabulary)

    def __missing__(self, token: str) -> list[int]:
        ids = self.vocabulary.encode(token.encode(), self.ranks)
        if len(self) < MEMO:
            self[token] = ids
        return ids


_held: dict[tuple[str, str], tuple[Vocabulary, Splitter, _Memo, list[str]]] = {}


def _tools(path: str, pattern: str):
    """Made once a worker; the files lie beside the installed library on every machine."""
    if (path, pattern) not in _held:
        v = Vocabulary.load(path)
        _held[path, pattern] = v, Splitter(pattern), _Memo(v), [str(i) for i in range(len(v.strings))]
    return _held[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds `into`, an array of the ids of each whole text; a column of that name gives way."""
    set_batches(docs.sparkSession)
    docs, restored = shielded(docs.drop(into), (text,))
    schema = StructType(list(docs.schema.fields)).add(into, ArrayType(IntegerType()))
    at = docs.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, split, memo, _ = _tools(path, pattern)
        for b in batches:
            ids = [list(chain.from_iterable(map(memo.__getitem__, split(t or "")))) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, into])

    return restored(docs.mapInArrow(kernel, schema), into)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """Adds `into`, the bytes of each array of ids."""
    encoded, restored = shielded(encoded.drop(into), (ids,))
    schema = StructType(list(encoded.schema.fields)).add(into, BinaryType())
    at = encoded.columns.index(ids)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _tools(path, "")[0]
        for b in batches:
            out = [v.decode(x or []) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, into])

    return restored(encoded.mapInArrow(kernel, schema), into)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each text encoded and its ids decoded again within the task, so that no ids travel: see DIGESTS."""
    set_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, split, memo, names = _tools(path, pattern)
        name, get = names.__getitem__, memo.__getitem__
        for b in batches:
            count, of_ids, of_bytes = np.zeros(b.num_rows, np.int64), [], []
            for k, text in enumerate(b.column(1)):
                ids = list(chain.from_iterable(map(get, split(text.as_py() or ""))))
                count[k] = len(ids)
                of_ids.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, DIGESTS)
