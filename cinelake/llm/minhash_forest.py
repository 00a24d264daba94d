"""MinHash near-dedup by an LSH forest.

A text's set is its distinct shingles of five words. Equal sets form one class; from there on only classes are
compared. Each class has a signature of minimum hashes. A tree of the forest is an order of its own over the
signatures: it starts at another place of the signature and compares value by value. Classes with a common prefix
are neighbours there, and the prefix is as deep as its region asks for: two values where that leaves
at most `region` classes, three or four where it doesn't. Regions are counted, never gathered, until small.

Deeper prefixes would part classes that should meet: of pairs at exactly 0.75 the 24 orders together miss 2e-9 at two values,
1e-4 at four, 8 % at eight. So a region that is too large at four values stays whole: in it, each class is first tried with its
likeliest neighbours in the sorted order; then those that did not come to the region's commonest label meet all its classes,
block by block.

Of a region only a maximum spanning forest of the likely pairs is confirmed at first, on the full sets. Since a pair
of that forest may be refused where another would not, a second pass takes the classes of every region and block that have a
likely partner of another label, with their full sets, and compares them exactly. It gives out links that join labels
only, fewer than classes, so that nothing grows with a group's square but the comparing itself. Links are joined to components by
alternating stars, all in tables.

Defined cases: null and wordless texts have the empty set, which links with nothing; a text of fewer words than a
shingle has one shingle, all its words; rows that share an id are one document; a null id gets no component and
is kept; an empty table gives an empty result; texts of any length count whole, and blocks hold fewer classes where
sets are long; ties of whole signatures are a region like others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alone, drop_written, remembered, set_batches, small, written

HASHES = 128
TREES = 24
#: Places in the signature at which trees start; and how deep prefixes may get.
STRIDE = 5
DEPTHS = (2, 3, 4)
REGION = 256
#: Least share of equal hashes that makes a pair likely: over four standard deviations below 0.75.
LIKELY = 0.58
#: Classes in a block of a crowded region, and shingles they have on average; earlier neighbours a class is tried with there, of so many.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
TRIED, NEAR = 2, 32

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(20240101)
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)

_hashes = remembered(WordHashes())


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    own = text.encode().translate(_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(alone(_hashes).__getitem__, own), np.uint64, len(own))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = s * _A + h[k : len(h) - n + 1 + k]
    s = (s ^ (s >> np.uint64(31))) * _B
    return np.unique(s ^ (s >> np.uint64(29)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, hash] minimum hashes of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(low * _MULTIPLY[j] + high, starts)
    return out


SKETCHES = "doc_id bigint, n_shingles bigint, set_key binary, sig binary"


def sketch(docs: DataFrame) -> DataFrame:
    """SKETCHES of (doc_id, text); set_key and sig are null for the empty set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or "") for t in b.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i] = row.tobytes()
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, SKETCHES)


def _prefix_keys(sigs: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """64-bit keys of the first `depth` values in a tree's order."""
    key = np.full(len(sigs), tree * 1000 + depth, np.uint64)
    for k in range(depth):
        key = (key ^ sigs[:, (tree * STRIDE + k) % HASHES].astype(np.uint64)) * _A
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def regions(classes: DataFrame, region: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, rep) of all regions of 2 to `region` classes, and (key, rep, tree) of those that are larger at the last depth."""
    found, todo = [], None
    for level, depth in enumerate(DEPTHS):

        def kernel(batches: Iterator[pa.RecordBatch], depth: int = depth, level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sigs, rep = _matrix(b.column(1), np.uint32, HASHES), b.column(0).to_numpy()
                trees = b.column(2).to_numpy() if level else None
                for t in range(TREES):
                    own = slice(None) if trees is None else np.flatnonzero(trees == t)
                    if len(rep[own]):
                        yield pa.RecordBatch.from_arrays([pa.array(_prefix_keys(sigs[own], t, depth)), pa.array(rep[own]), pa.array(np.full(len(rep[own]), t, np.int32))], ["key", "rep", "tree"])

        source = classes.select("rep", "sig") if todo is None else todo.join(classes.select("rep", "sig"), "rep").select("rep", "sig", "tree")
        keyed = source.mapInArrow(kernel, "key bigint, rep bigint, tree int")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        # a table of its own, so that a key with very many rows can be split in the join
        shared = written(keyed.join(written(sizes, "sizes").hint("merge"), "key"), "shared")
        found.append(shared.filter(F.col("n") <= region).select("key", "rep"))
        todo = shared.filter(F.col("n") > region).select("key", "rep", "tree")
        if todo.isEmpty():
            todo = None
            break
        todo = todo if depth == DEPTHS[-1] else todo.select("rep", "tree")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, todo


def _spanning(likely: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of a matrix of shares, 0 where a pair is not likely."""
    n, out = len(likely), []
    best, via, left = np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        at = int(np.where(left, best, -1.0).argmax())
        if best[at] > 0:
            out.append((int(via[at]), at))
        left[at] = False
        better = left & (likely[at] > best)
        best[better], via[better] = likely[at][better], at
    return out


def _groups(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[tuple, list[tuple]] | None]:
    """(first `of` columns, rows of the others) of rows sorted by the first; None after each batch."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:of] != at:
                if held:
                    yield at, held
                at, held = row[:of], []
            held.append(row[of:])
        yield None
    if held:
        yield at, held
    yield None


def _batched(batches: Iterator[pa.RecordBatch], of: int, made: Callable[[tuple, list[tuple]], Iterable[tuple]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What `made` gives of each group, with the distinct rows of each batch."""
    out: set = set()
    for group in _groups(batches, of):
        if group:
            out.update(made(*group))
        elif out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(out), strict=True)], names)
            out = set()


def _shares(rows: list[tuple], others: list[tuple], percent: int) -> np.ndarray:
    """Shares of equal hashes of (_, mini, n, ...) rows, 0 where a pair is unlikely or its sizes alone rule it out."""
    x, y = (np.frombuffer(b"".join(r[1] for r in own), np.uint8).reshape(-1, HASHES) for own in (rows, others))
    n, m = (np.array([r[2] for r in own]) for own in (rows, others))
    share = np.stack([(y == row).mean(axis=1) for row in x])
    share[(share < LIKELY) | (100 * np.minimum(n[:, None], m) < percent * np.maximum(n[:, None], m))] = 0
    return share


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b): a maximum spanning forest of the likely pairs of every region. members: key, rep, mini, n."""

    def pairs(_: tuple, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        rows = sorted(dict.fromkeys(rows))
        share = _shares(rows, rows, percent)
        np.fill_diagonal(share, 0)
        for i, j in _spanning(share):
            yield min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])

    rows = members.select("key", "rep", "mini", "n").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: _batched(batches, 1, pairs, ["a", "b"]), "a bigint, b bigint").distinct()


def neighbours(crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of crowded regions: each class with the likeliest few of its neighbours before it in the sorted order.

    crowded: key, rep, mini, n, place (the signature from the region's depth on, in its tree's order). Ranges of the order are dealt to tasks,
    so that a region of any size is split; neighbours that this parts meet later.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for b in batches:
            out = set()
            for key, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                row = tuple(row)
                before = [r for k, r in last if k == key]
                if before:
                    share = _shares([row], before, percent)[0]
                    for k in np.argsort(-share, kind="stable")[:TRIED]:
                        if share[k] and before[k][0] != row[0]:
                            out.add((min(row[0], before[k][0]), max(row[0], before[k][0])))
                last = [*last[1 - NEAR :], (key, row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(out), strict=True)], ["a", "b"])

    rows = crowded.select("key", "rep", "mini", "n", "place").repartitionByRange("key", "place", "rep").sortWithinPartitions("key", "place", "rep")
    return rows.mapInArrow(kernel, "a bigint, b bigint").distinct()


def tiles(members: DataFrame, crowded: DataFrame | None, labels: DataFrame) -> DataFrame:
    """(key, i, j, side, rep, mini, n, label): a region of `members` is a tile of its own, all on side 0. In a crowded one the classes that are
    not of its commonest label are on side 0 of the tiles (i, j) of their block i and each block j of all its classes, on side 1.

    Blocks come from hashes; counts of labels are all that is gathered of a region.
    """
    label = F.coalesce(F.col("label"), F.col("rep")).alias("label")
    own = ["key", "rep", "mini", "n"]
    small_ones = members.join(labels, "rep", "left").select(*own, label)
    mixed = small_ones.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("key")
    place = [F.lit(0).alias(c) for c in ("i", "j", "side")]
    out = small_ones.join(written(mixed, "mixed").hint("merge"), "key").select("key", *place, "rep", "mini", "n", "label")
    if crowded is None:
        return out
    rows = written(crowded.join(labels, "rep", "left").select(*own, label), "crowded")
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s")).filter(F.col("c") > F.col("top.c"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    main = main.select("key", F.col("top.label").alias("main"), blocks(F.col("c"), F.col("s")).alias("all"), blocks(F.col("c") - F.col("top.c"), F.col("s")).alias("others"))
    rows = rows.join(written(main, "main").hint("merge"), "key")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["rep", "mini", "n", "label"]
    asks = rows.filter(F.col("label") != F.col("main")).select("key", block("others").alias("i"), each("all").alias("j"), F.lit(0).alias("side"), *rest)
    asked = rows.select("key", each("others").alias("i"), block("all").alias("j"), F.lit(1).alias("side"), *rest)
    return out.unionByName(asks).unionByName(asked)


def involved(tiled: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, side, rep, label) of the classes in a tile that have a likely partner of another label there."""

    def rows_of(tile: tuple, rows: list[tuple]) -> Iterator[tuple]:
        rows = sorted(dict.fromkeys(rows))
        asking = [r[1:] for r in rows if r[0] == 0]
        asked = [r[1:] for r in rows if r[0] == 1] or asking
        if not asking:
            return
        on = (_shares(asking, asked, percent) > 0) & (np.array([r[3] for r in asking])[:, None] != np.array([r[3] for r in asked]))
        for k in np.flatnonzero(on.any(axis=1)):
            yield *tile, 0, asking[k][0], asking[k][3]
        if asked is not asking:
            for k in np.flatnonzero(on.any(axis=0)):
                yield *tile, 1, asked[k][0], asked[k][3]

    at = ["key", "i", "j"]
    rows = tiled.select(*at, "side", "rep", "mini", "n", "label").repartition(*at).sortWithinPartitions(*at)
    schema = "key bigint, i int, j int, side int, rep bigint, label bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for b in _batched(batches, 3, rows_of, names):
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(b.columns, kinds, strict=True)], names)

    return rows.mapInArrow(kernel, schema)


def joining(asking: list[tuple], asked: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Of (rep, label, items) rows, links at `percent` between the two lists that join labels, each of use."""
    labels, own = np.unique(np.array([r[1] for r in [*asking, *asked]]), return_inverse=True)
    own, other = own[: len(asking)], own[len(asking) :]
    root = np.arange(len(labels))
    size = np.array([len(r[2]) for r in asked])
    flat = np.concatenate([r[2] for r in asked])
    order = np.argsort(flat, kind="stable")
    holder = np.repeat(np.arange(len(asked)), size)[order]
    items, first = np.unique(flat[order], return_index=True)
    first = np.append(first, len(flat))
    for (rep, _, mine), at in zip(asking, own, strict=True):
        k = np.searchsorted(items, mine)
        k = k[(k < len(items)) & (items[np.minimum(k, len(items) - 1)] == mine)]
        n = first[k + 1] - first[k]
        hits = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holder[hits], minlength=len(asked))
        on = 100 * both >= percent * (len(mine) + size - both)
        for j in np.flatnonzero(on & (root[other] != root[at])):
            x, y = root[at], root[other[j]]
            if x != y:
                root[root == y] = x
                yield min(rep, asked[j][0]), max(rep, asked[j][0])


def exact(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a < b) between classes of other labels in a tile, of `involved`, on full sets (rep, items): as many as join labels there."""

    def pairs(_: tuple, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        rows = [(side, rep, label, np.frombuffer(items, np.uint64)) for side, rep, label, items in sorted(dict.fromkeys(rows))]
        asking = [r[1:] for r in rows if r[0] == 0]
        asked = [r[1:] for r in rows if r[0] == 1] or asking
        return joining(asking, asked, percent) if asking else iter(())

    at = ["key", "i", "j"]
    whole = rows.join(sets.hint("merge"), "rep").select(*at, "side", "rep", "label", "items").repartition(*at).sortWithinPartitions(*at)
    return whole.mapInArrow(lambda batches: _batched(batches, 3, pairs, ["a", "b"]), "a bigint, b bigint").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs with 100 * intersection >= percent * union, on full sets (rep, items)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    # pairs whose sizes alone rule them out were left out where they were made
    sized = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a").filter(F.col("a") != F.col("b"))
    both = sized.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(kernel, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, label) of every linked class: the least class it reaches. Alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(written(least, "least"), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        done, edges = edges, written(small_star, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(done)
        if now == state:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("label"))
        state = now


RESULT = ("doc_id", "n_shingles", "component_id", "kept")


def link(docs: DataFrame, percent: int = 75, region: int = REGION, salts: int = 8) -> DataFrame:
    """RESULT for every row of (doc_id, text)."""
    spark = docs.sparkSession
    set_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = written(sketch(docs), "sketches")
    classes = sketches.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    shared, crowded = regions(classes, region)

    def minis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = _matrix(b.column(1), np.uint32, HASHES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in low], pa.binary()), b.column(2), b.column(1)], ["rep", "mini", "n", "sig"])

    mini = classes.select("rep", "sig", "n").mapInArrow(minis, "rep bigint, mini binary, n bigint, sig binary")
    members = written(shared.join(mini.drop("sig").hint("merge"), "rep"), "members")
    tried = candidates(members, percent)
    if crowded is not None:
        # the signature from the tree's start on, less what all of the region share, then from its beginning
        place = F.expr(f"substring(concat(sig, sig), int({4 * STRIDE} * tree + {4 * DEPTHS[-1]}) % {4 * HASHES} + 1, {4 * 16})").alias("place")
        crowded = written(crowded.join(mini.hint("merge"), "rep").select("key", "rep", "mini", "n", place), "crowded")
        tried = tried.union(neighbours(crowded, percent)).distinct()
    tried = written(tried, "tried")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t or "").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "items"])

    def sets_of(reps: DataFrame) -> DataFrame:
        # each class once: a repeated id gives all its sets, whichever of them links
        needed = written(reps.toDF("_id").distinct(), "needed")
        return written(docs.join(small(needed, 16), F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "text").mapInArrow(full, "rep bigint, items binary").distinct(), "sets")

    links = written(confirm(tried, sets_of(tried.select("a").union(tried.select("b"))), percent), "links")
    labels = components(links)
    apart = written(involved(tiles(members, crowded, labels), percent), "involved")
    if not apart.isEmpty():
        more = written(exact(apart, sets_of(apart.select("rep")), percent), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    label = F.coalesce(F.col("label"), F.col("rep"))
    # classes of one document that reached nothing smaller need no join: their component is themselves
    told = classes.join(labels, "rep", "left").filter((F.col("copies") > 1) | F.col("label").isNotNull())
    told = told.select("set_key", label.alias("component"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    rows = sketches.select("doc_id", "n_shingles", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"))
    joined = rows.join(told.hint("merge"), ["set_key", "_salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
