"""Vectors, archives, URLs and the pipeline against plain restatements."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest

from cinelake.llm import queries, topk, url_automaton, warc
from cinelake.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def plain_top(rows, k=5, scale=256):
    held = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(scale * float(x))) for x in v]
        held[i] = min(held.get(i, w), w)
    out = set()
    for q, v in held.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("stripe", [16384, 60])
def test_top_k_is_exact(spark, stripe):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.01, 0.3, 1, 4])]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] + [0.0] * 7), (503, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (550, [0.0] * 8), (7, [2.0] * 8), (600, [1.0, 2.0]), (601, [2.0, 2.0]), (650, [])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, stripe int, score int")
    got = {tuple(r) for r in topk.top_k(df, df.vec_id % 50 == 0, stripe_rows=stripe).collect()}
    assert got == plain_top(rows)
    assert topk.top_k(df.limit(0), df.vec_id % 50 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [4e6, 1.0]), (1, [4e6, 2.0]), (2, [4e6, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, df.vec_id % 50 == 0).collect()}
    assert got == plain_top(rows)


def test_archives_round_trip(spark):
    big = "".join(chr(random.Random(4).randrange(32, 0x2FF)) for _ in range(1000)) * 900
    rows = [(3, "http://a/é x\r\n", "same"), (1, "http://b", "same"), (2, None, None), (9, "u", ""), (4, "u", big), (5, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"), (1, "u", "same"), (1, "u", "other"), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, sha1 int, data string")
    out = [(r.page_id, r.payload_bytes, r.running_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = first is not None and i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, out)) == sorted(map(str, want))
    folder = scratch_path(spark, "warc")
    manifest = warc.write(warc.chunks(warc.decide(df, least=100), size=1000), folder)
    read = warc.read(manifest, folder, size=777).filter("page_id = 4").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in read) == big.encode() and len(read) > 1000 and max(len(r.data) for r in read) <= 777
    assert read[0].running_digest == base64.b32encode(hashlib.sha1(big.encode()[:777]).digest()).decode()
    assert warc.round_trip(df.limit(0)).count() == 0


URLS = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/", "ftp://org/x", "http://x.com/fr/", "http://x.com/fr", "http://x.com", "http://com.evil/x.org/", "no scheme", None, "", "://", "http://h?q/es/#f", "http://é.org/ü/wp-login.php", "http://x.net/a.exe", "http://x.net/cgi-bin/y", "HTTP://X.COM/DE/", "http://x.com/de/" + "y" * 50_000]


def test_urls(spark):
    def plain(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return (host, path, *max(fits)[1:])
        blocked = any(x in host + path for x in ("/wp-login.php", "/cgi-bin/")) or (host + path).endswith(".exe")
        return host, path, None, "block" if blocked else "allow"

    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule int")
    for r in url_automaton.judge(df, queries.URL_RULES, queries.URL_GLOBS).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id]), URLS[r.page_id]
    assert url_automaton.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_automaton_against_regular_expressions():
    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts = ["".join(rng.choice("ab/c") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = url_automaton.Automaton.of([url_automaton.parse(g) for g in globs]).run([t.encode() for t in texts])
    for k, g in enumerate(globs):
        p = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "."}.get(x, x) for x in re.findall(r"\*\*|.", g)), re.S)
        assert [bool(p.fullmatch(t)) for t in texts] == got[:, k].tolist(), g


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "kept")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    texts = [r.text or "" for r in docs.collect()]
    assert not any(re.search(r"AKIA[A-Z0-9]{12}", t) for t in texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rows = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    plain = lambda found: sorted(str(tuple(r)) for r in found)
    assert plain(got.select(*names).collect()) == plain(rows.fetchall()) and sorted(got.columns) >= sorted(names)
