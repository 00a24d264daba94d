"""Each stage of the pipeline against a plain restatement, on the smallest tables."""

import math
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_texts import by_hand, gapless, plain_components, plain_dedup, plain_metrics
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
BUCKETS, MASK = 1 << 16, (1 << 64) - 1


@pytest.fixture(scope="module")
def stages(spark):
    """Rows (by id) before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [{r.doc_id: r for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append({r.doc_id: r for r in rows})
    return [*out, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()]


def buckets(text):
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x >> 48 for x in h] + [(((a * 0xC2B2AE3D27D4EB4F + b) & MASK) * 0x9E3779B97F4A7C15 & MASK) >> 48 for a, b in zip(h, h[1:])]


def test_quality(spark, stages):
    before, after = stages[0], stages[1]
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = min(labels.get(r.doc_id, 1), r.quality)
    half = lambda i: zlib.crc32(str(i).encode()) % 2
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, r in before.items():
        for b in buckets(r.text):
            raw[b] += 1
            target[b] += labels.get(i) == 1 and half(i) == 0
    p = (raw + 1) / (raw.sum() + BUCKETS)
    ratio = np.rint(1e6 * np.log((target + 8192 * p) / ((target.sum() + 8192) * p)))
    score = {i: float(ratio[own].sum()) / 1e6 / len(own) if (own := buckets(r.text)) else 0.0 for i, r in before.items()}
    metrics = {i: plain_metrics(r.text) for i, r in before.items()}
    failed = {i for i, m in metrics.items() if m[0] < 50 or 100 * m[4] > 50 * m[0]}
    held = [(math.floor(100 * score[i]), q) for i, q in labels.items() if half(i) == 1 and i in before and i not in failed]
    bad, good = (sum(q == k for _, q in held) for k in (0, 1))
    least = -math.inf
    if bad and good:
        met = sorted({b for b, _ in held})
        loss = lambda at: sum(q == 0 and b >= at for b, q in held) / bad + 20 * sum(q == 1 and b < at for b, q in held) / good
        ends = [(loss(b + 1), k) for k, b in enumerate(met)]
        best, k = min(ends)
        least = -math.inf if best >= 1 else (met[k] + 1 + (met[k + 1] if k + 1 < len(met) else met[k] + 1)) / 200
    assert set(after) == {i for i in before if i not in failed and score[i] >= least}
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates(stages):
    before, after = stages[1], stages[2]
    want = plain_components([r.text for r in before.values()], list(before))
    assert set(after) == {i for i, (_, c) in want.items() if i == c} and all(after[i] == before[i] for i in after)


def test_passages(stages):
    before, after = stages[2], stages[3]
    assert {i: r.text for i, r in after.items()} == plain_dedup({i: r.text for i, r in before.items()})
    assert all(r.n_chars == len(r.text) or r.text == before[i].text for i, r in after.items())


def test_secrets(stages):
    before, after = stages[3], stages[4]
    assert set(after) == set(before)
    for i, r in after.items():
        assert not by_hand(r.text) and ("[REDACTED:" in r.text or r.text == before[i].text) and bool(by_hand(before[i].text)) <= ("[REDACTED:" in r.text)


def test_packing(stages):
    before, rows = stages[4], stages[5]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, r in before.items():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want |= {(i, k): (2048 * k, zlib.crc32(np.array(ids[2048 * k : 2048 * k + 2048], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert gapless(rows, 2048) <= 1.1 * math.ceil(sum(r.length for r in rows) / 2048)


@pytest.mark.parametrize("case", ["nulls", "empty"])
def test_stages_take_odd_rows(spark, case):
    """Null and empty texts, ids and other columns, repeated rows, a very long text and columns named like the operators' own, through every stage."""
    text = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 600 and lang = 'en'").orderBy("doc_id").first().text
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, removed string, spans string, _salt int, n int, label string, `a.b` int"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, " \n"), (5, text + " and more at the end of it"), (6, "word " * 30_000), (7, text.upper())]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", "r", "s", 3, 4, "l", 5) for i, t in rows], schema)
    docs = docs.limit(0) if case == "empty" else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        held = made.collect()
        assert made.columns == docs.columns and len(held) <= docs.count(), name
        assert all((r.kept, r.removed, r.spans, r._salt, r.n, r.label, r["a.b"]) == ("k", "r", "s", 3, 4, "l", 5) for r in held), name
        if name != "quality rules":  # which rejects texts of few words
            assert {r.doc_id for r in held} >= {r.doc_id for r in docs.collect() if r.doc_id != 7 or name != "MinHash near-dedup"} - {5, 7}, name
        docs = spark.createDataFrame(held, docs.schema) if name == "quality rules" and held else docs
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packed}) == len(packed) and bool(packed) == (case == "nulls")
