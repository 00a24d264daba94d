"""URL filters by a bit-parallel wildcard automaton.

Glob rules over the canonical URL (lower-cased host, then path) are packed, one after another, into the
bits of as many 64-bit words as they need. A bit is a state: that many literals of its rule are consumed. One
step for one character moves all rules of a whole batch of URLs at once: (D << 1) & B[c], with the carry from
word to word, or D & L[c] where a wildcard lets the state stay. `*` stays within the host or one path segment
(any run without `/`), `**` is any run, `?` any one character.

Defined cases: a null url, or one without `://`, has empty host and path, fits no host rule and gets the
default; empty and very long urls are walked to their end, the batch shrinking as shorter ones finish; repeated
rows and null ids keep their rows; of fitting rules the longest wins, then the one listed first; an empty table
gives an empty result. Bytes are matched: `?` in a rule is one byte of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule: its verdict, host and path. It fits the host and all subdomains where the path starts with the rule's.
HostRule = tuple[str, str, str]
#: A glob over the whole canonical URL with its verdict, for URLs that no host rule fits.
GlobRule = tuple[str, str]

_ANY, _RUN, _SEGMENT = "any", "run", "segment"


def parse(glob: str) -> list:
    """Literal bytes and wildcards of a glob."""
    out, i = [], 0
    raw = glob.encode()
    while i < len(raw):
        if raw[i : i + 2] == b"**":
            out.append(_RUN)
            i += 2
            continue
        out.append({0x2A: _SEGMENT, 0x3F: _ANY}.get(raw[i], raw[i]))
        i += 1
    return out


def host_globs(host: str, path: str) -> list[list]:
    """The two globs of a host rule: the host itself, and any subdomain."""
    own = list((host + path).encode()) + [_RUN]
    return [own, [_SEGMENT, 0x2E, *own]]


@dataclass
class Automaton:
    """Masks of many globs. step[c], stay[c]: words of bits; start and accept: each glob's first and last state."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    accept: list[tuple[int, int]]

    @classmethod
    def of(cls, globs: list[list]) -> Automaton:
        literals = [sum(x not in (_RUN, _SEGMENT) for x in g) for g in globs]
        width = max(1, -(-sum(n + 1 for n in literals) // 64))
        step, stay, start = np.zeros((256, width), np.uint64), np.zeros((256, width), np.uint64), np.zeros(width, np.uint64)
        accept, bit = [], 0
        mark = lambda a, b: np.uint64(1 << (b % 64)) | a
        for g in globs:
            start[bit // 64] = mark(start[bit // 64], bit)
            for x in g:
                if x in (_RUN, _SEGMENT):
                    stay[:, bit // 64] = mark(stay[:, bit // 64], bit) if x == _RUN else np.where(np.arange(256) == 0x2F, stay[:, bit // 64], mark(stay[:, bit // 64], bit))
                    continue
                bit += 1
                at = slice(None) if x == _ANY else slice(x, x + 1)
                step[at, bit // 64] = mark(step[at, bit // 64], bit)
            accept.append((bit // 64, bit % 64))
            bit += 1
        return cls(step, stay, start, accept)

    def run(self, texts: list[bytes], block: int = 4096) -> np.ndarray:
        """[text, glob]: which globs fit each whole text."""
        out = np.zeros((len(texts), len(self.accept)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for k in range(0, len(order), block):
            self._block(texts, order[k : k + block], out)
        return out

    def _block(self, texts: list[bytes], rows: np.ndarray, out: np.ndarray) -> None:
        """rows: longest first, so that those still running are always the first ones."""
        lengths = np.array([len(texts[r]) for r in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8)
        d = np.tile(self.start, (len(rows), 1))
        one, top = np.uint64(1), np.uint64(63)
        for p in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -p, "left"))  # texts longer than p
            c, now = flat[starts[:n] + p], d[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            d[:n] = (moved & self.step[c]) | (now & self.stay[c])
        for g, (word, bit) in enumerate(self.accept):
            out[rows, g] = (d[:, word] >> np.uint64(bit)) & one


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), empty(path)


JUDGED = "page_id bigint, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules: list[HostRule], globs: list[GlobRule] = (), default: str = "allow") -> DataFrame:
    """JUDGED for every row of (page_id, url)."""
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    ordered = [rules[i] for i in ranked]
    automaton = Automaton.of([g for _, host, path in ordered for g in host_globs(host, path)] + [parse(g) for _, g in globs])
    names = np.array([host + path for _, host, path in ordered] + [None], object)
    verdicts = np.array([v for v, _, _ in ordered] + [None], object)
    last = np.array([v for v, _ in globs] + [default], object)
    host, path = canonical(F.col("url"))

    def first(fits: np.ndarray) -> np.ndarray:
        """The first column that fits; their number if none does."""
        return np.where(fits.any(axis=1), fits.argmax(axis=1), fits.shape[1]) if fits.shape[1] else np.zeros(len(fits), np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = automaton.run([(h + p).encode() for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            own = fits[:, : 2 * len(ordered)]
            rule, other = first(own[:, ::2] | own[:, 1::2]), first(fits[:, 2 * len(ordered) :])
            verdict = np.where(rule < len(ordered), verdicts[rule], last[other])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[rule], pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path")).mapInArrow(kernel, JUDGED)
