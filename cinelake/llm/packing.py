"""Best-fit packing by a configuration linear program over the length histogram.

Every text is tokenised whole and ends with a separator id; only documents longer than a sequence are cut.
How many pieces have each length is all the plan needs: at most `capacity` counts. A configuration is a
multiset of lengths that fits a sequence. The program "fewest configurations that cover all counts" is
solved by multiplicative weights, at every size: each length has a weight, an unbounded-knapsack dynamic program prices the
best configurations under them, and lengths they cover lose weight. The prices also bound what any packing needs.
Rounding takes full configurations whole, the program's first, then such as a bounded knapsack prices for the counts left; best fit
decreasing packs what fills no sequence. Each piece then finds its place from its rank within its length, by arithmetic.

Defined cases: a null text is the empty text (one separator); repeated rows are pieces of their own;
null ids keep their rows; texts of any length are tokenised whole; pieces of equal length are ranked by (salt, doc_id, piece, checksum), and
ties beyond that are equal pieces, so that any of them may come first; strings of the tokenizer's special tokens are those
tokens, as in the library's plain call; columns but doc_id and text are ignored; an empty table gives an empty plan and an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import alone, remembered, set_batches, written

#: Words whose ids a worker remembers; beyond that they are worked out each time.
MEMO = 800_000

# The letters, numbers and spaces among the first 256 code points, and the tokenizer's word pattern over them.
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_S = "\t\n\x0b\x0c\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class WordTokenizer:
    """The library's ids. Lower-casing and word splitting of texts within the first 256 code points (all of them in normal
    form C) happen here, and each distinct word is asked once; other texts go to the library whole, as do those with its special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        # their strings in a text are one token each: such texts go to the library whole
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = remembered({})

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str], at_once: int = 1000) -> dict[str, bytes]:
        """Ids of distinct words, many asked as one text: spaces part them again just so."""
        out = {}
        for k in range(0, len(words), at_once):
            own = words[k : k + at_once]
            e = self.t.encode(" ".join(own), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4"), np.cumsum(np.bincount(e.word_ids, minlength=len(own)))
            raw, start = ids.tobytes(), 0
            for w, end in zip(own, (4 * ends).tolist(), strict=True):
                out[w] = raw[start:end]
                start = end
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        words = [_WORD.findall(t.lower()) if _is_latin(t) and not any(x in t for x in self.special) else None for t in texts]
        get = alone(self.memo).get
        found = [[] if own is None else list(map(get, own)) for own in words]
        new = {w for own, got in zip(words, found, strict=True) if None in got for w, ids in zip(own, got, strict=True) if ids is None}
        made = self._words(list(new)) if new else {}
        if len(self.memo) + len(made) <= MEMO:
            self.memo.update(made)
        return [self._ask([t])[0] if own is None else b"".join([made[w] if ids is None else ids for w, ids in zip(own, got, strict=True)] if None in got else got) for t, own, got in zip(texts, words, found, strict=True)]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_held: dict[str, WordTokenizer] = {}
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """PIECES of every whole text of (doc_id, text); with_ids adds the ids themselves."""
    set_batches(docs.sparkSession)
    last = np.array([separator], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _held:
            _held[tokenizer] = WordTokenizer(tokenizer)
        for b in batches:
            doc, piece, start, length, crc, held = [], [], [], [], [], []
            for d, ids in zip(b.column(0).to_pylist(), _held[tokenizer]([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        held.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, PIECES + (", ids array<int>" if with_ids else ""))


# --- the plan: driver-side, over at most `capacity` counts


class Knapsack:
    """The unbounded knapsack under `value` (of each of `lengths`): for every room the best multiset of lengths that fits."""

    def __init__(self, lengths: np.ndarray, value: np.ndarray, capacity: int):
        best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
        for c in range(1, capacity + 1):
            n, most, at = fits[c], best[c - 1], 0
            if n:
                got = value[:n] + best[c - lengths[:n]]
                k = got.argmax()
                if got[k] > most:
                    most, at = got[k], lengths[k]
            best[c], pick[c] = most, at
        self.best, self.pick = best, pick.tolist()

    def config(self, room: int) -> Counter:
        out: Counter = Counter()
        while room:
            if l := self.pick[room]:
                out[l] += 1
                room -= l
            else:
                room -= 1
        return out


class Program(NamedTuple):
    """A cover by the program: how many of each configuration; a lower bound of the sequences of any packing, and the prices that
    prove it: no configuration is worth more than 1."""

    configs: dict[tuple, float]
    bound: float
    prices: dict[int, float]


def solve(counts: dict[int, int], capacity: int, rounds: int = 120, rate: float = 6.0, part: int = 8) -> Program:
    """The covering program by multiplicative weights.

    A length's price is its share of a sequence times a weight that falls exponentially with how much of its count is
    covered already. Each round prices once; of the best configurations with each length in them, the least covered
    lengths' first, those that share no length with one before are taken, so often that their scarcest count is served by a
    `part`. Any prices, divided by what the best configuration is worth under them, are a solution of the dual: the largest
    such value of all rounds is the bound.
    """
    lengths = np.array(sorted(counts))
    demand = np.array([counts[int(l)] for l in lengths], float)
    place = {int(l): k for k, l in enumerate(lengths)}
    served, used, bound, prices = np.zeros(len(lengths)), Counter(), 0.0, lengths / capacity
    for _ in range(rounds if len(lengths) else 0):
        value = lengths / capacity * np.exp(rate * (served.min() - served))
        priced = Knapsack(lengths, value, capacity)
        if (proved := float(demand @ value / priced.best[capacity])) > bound:
            bound, prices = proved, value / priced.best[capacity]
        fresh = np.ones(len(lengths), bool)
        for k in np.lexsort([-lengths, served]):
            if not fresh[k]:
                continue
            config = priced.config(capacity - int(lengths[k]))
            config[int(lengths[k])] += 1
            at, take = np.array([place[l] for l in config]), np.array(list(config.values()), float)
            if fresh[at].all():
                fresh[at] = False
                step = float((demand[at] / take).min()) / part
                used[tuple(sorted(config.items(), reverse=True))] += step
                served[at] += step * take / demand[at]
    least = max(float(served.min(initial=1.0)), 1e-9)
    return Program({c: n / least for c, n in used.items()}, bound, dict(zip(lengths.tolist(), prices.tolist(), strict=True)))


def _take(out: Counter, config: tuple, most: int, left: dict[int, int]) -> None:
    if n := min(most, *(left[l] // k for l, k in config)):
        out[config] += n
        for l, k in config:
            left[l] -= n * k


def rounded(program: Program, left: dict[int, int], slack: float = 0.0004) -> Counter:
    """The program's configurations that its prices leave no room to better, the commonest first: each as often as the program says, and
    once at least, while its pieces last. They are taken out of `left`."""
    out: Counter = Counter()
    for config, n in sorted(program.configs.items(), key=lambda x: (-x[1], x[0])):
        if sum(program.prices[l] * k for l, k in config) >= 1 - slack:
            _take(out, config, max(1, int(n)), left)
    return out


def completed(left: dict[int, int], capacity: int) -> Counter:
    """Full configurations of what rounding left, priced by a bounded knapsack: a piece is worth its length, the longest
    length left is a part, and a configuration is taken as often as its pieces last. Lengths for which none is full stay in `left`."""
    out: Counter = Counter()
    for longest in sorted(left, reverse=True):
        while left[longest]:
            # reach: a bit for each sum that the pieces so far can have
            chunks, reach, room = [], 1, capacity - longest
            for l in sorted(left, reverse=True):
                free, k = min(left[l] - (l == longest), room // l), 1
                while free > 0 and not reach >> room & 1:
                    own = min(k, free)
                    chunks.append((l, own, reach))
                    reach |= reach << l * own & (2 << room) - 1
                    free, k = free - own, 2 * k
            if not reach >> room & 1:
                break
            config = Counter({longest: 1})
            for l, k, before in reversed(chunks):
                if not before >> room & 1:
                    config[l] += k
                    room -= l * k
            _take(out, tuple(sorted(config.items(), reverse=True)), left[longest], left)
    return out


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing over counted lengths. Sequences filled alike are kept as one group with its number, so
    the work follows the number of different fillings, not of pieces."""
    rooms: list[int] = []  # the free rooms there are, sorted
    held: dict[int, list[tuple[tuple, int]]] = {}

    def put(room: int, config: tuple, n: int) -> None:
        if room not in held:
            held[room] = []
            insort(rooms, room)
        held[room].append((config, n))

    for l in sorted(counts, reverse=True):
        left = counts[l]
        while left:
            at = bisect_left(rooms, l)
            if at == len(rooms):  # none fits: open as many full ones as this length fills
                k = min(capacity // l, left)
                put(capacity - k * l, ((l, k),), left // k)
                left %= k
                continue
            room = rooms[at]
            config, n = held[room].pop()
            if not held[room]:
                del held[room], rooms[at]
            k = min(room // l, left)
            used = min(n, left // k)
            if used < n:
                put(room, config, n - used)
            put(room - k * l, (*config, (l, k)), used)
            left -= used * k
    out: Counter = Counter()
    for own in held.values():
        for config, n in own:
            out[config] += n
    return out


class Plan(NamedTuple):
    """Configurations with whole numbers of sequences, which together hold every counted piece exactly once. Of those with shorter pieces than
    a sequence: how many the rounded program made, how many the bounded knapsack and best fit, and the bound of any packing."""

    configs: list[tuple[tuple, int]]
    by_program: int
    by_knapsack: int
    by_best_fit: int
    bound: float


def plan(counts: dict[int, int], capacity: int = 2048, rounds: int = 120) -> Plan:
    """The program is solved and rounded, and again, in fewer rounds, for what that leaves, until rounding takes less than a twentieth of it."""
    left = {l: n for l, n in counts.items() if n and l < capacity}
    whole, bound, more = Counter(), 0.0, True
    while more and left:
        before = sum(l * n for l, n in left.items())
        program = solve(left, capacity, rounds if not bound else rounds // 2)
        bound = bound or program.bound
        whole += rounded(program, left)
        left = {l: n for l, n in left.items() if n}
        more = 20 * sum(l * n for l, n in left.items()) < 19 * before
    full = completed(left, capacity)
    rest = best_fit({l: n for l, n in left.items() if n}, capacity)
    out = whole + full + rest
    if counts.get(capacity):
        out[((capacity, 1),)] = counts[capacity]
    return Plan(sorted(out.items()), sum(whole.values()), sum(full.values()), sum(rest.values()), bound)


def layout(planned: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """Rows by length and first rank: ranks from `first` on go, `per` a sequence, to sequences from `sequence` at `offset`."""
    rows, sequence, ranks = [], 0, Counter()
    for config, n in planned:
        offset = 0
        for l, k in config:
            rows.append((l, ranks[l], sequence, k, offset))
            ranks[l] += n * k
            offset += l * k
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "sequence", "per", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pack(pieces: DataFrame, capacity: int = 2048, salts: int = 64, rounds: int = 120) -> DataFrame:
    """PACKED: a place for every row of PIECES. `pieces` is read three times; give a written table.

    A rank within a length is the row's number within (length, salt) plus the counts of smaller salts, so that
    a length with a third of all rows is numbered by `salts` tasks. Those counts, at most capacity x salts
    rows, and the plan are all that is broadcast or reaches the driver.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n"))
    held = counts.collect()
    by_length: Counter = Counter()
    for r in held:
        by_length[r["length"]] += r["n"]
    at = layout(plan(dict(by_length), capacity, rounds).configs)
    before = np.zeros((capacity + 1, salts), np.int64)
    for r in held:
        before[r["length"], r["_salt"]] = r["before"]
    # one sorted key for a search: ranks stay below the number of rows
    stride = max(by_length.values(), default=0) + 1
    keys = at["length"] * stride + at["first"]
    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, n = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_salt", "_n"))
            rank = n + before[length, salt]
            row = np.searchsorted(keys, length * stride + rank, "right") - 1
            k = rank - at["first"][row]
            sequence, offset = at["sequence"][row] + k // at["per"][row], at["offset"][row] + k % at["per"][row] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-2], "sequence_id", "offset"])

    return ranked.mapInArrow(kernel, StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """PACKED pieces of (doc_id, text). Texts are tokenised once; only lengths and checksums go on."""
    return pack(written(cut(docs, tokenizer, capacity), "pieces"), capacity)
