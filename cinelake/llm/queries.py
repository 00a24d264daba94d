"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash_forest, packing, quality_llr, secret_ledger, substring_dedup, topk, toxicity_mil, url_automaton, warc
from .common import table, written


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, which together are the whole table: of the second only what the first one's ledger lacks is scanned."""
    docs = secret_ledger.address(table(spark, sf_dir, "documents").select("doc_id", "text"))
    early = F.xxhash64("doc_id") < 0
    ledger = written(secret_ledger.scan_unseen(docs.filter(early)), "ledger")
    ledger = ledger.union(written(secret_ledger.scan_unseen(docs.filter(~early), ledger), "ledger"))
    found = secret_ledger.findings(docs, ledger, ["doc_id"])
    base = F.expr("filter(spans, x -> x.kind in ('assign', 'access', 'hex'))")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _op2_sql() -> str:
    """Spans in SQL: the pieces between the matches of a rule give each match's place as a running sum of lengths."""
    parts = []
    for k, r in enumerate(secret_ledger.RULES):
        p = r.pattern.replace("'", "''")
        group = f", {r.group}" if r.group else ""
        parts.append(
            f"SELECT rid, {k} AS kind_no, '{r.kind}' AS kind, start_at, end_at FROM ("
            f"SELECT rid, i, whole, grp, sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) + sum(length(whole)) OVER (PARTITION BY rid ORDER BY i) - length(whole) AS start_at,"
            f" sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) + sum(length(whole)) OVER (PARTITION BY rid ORDER BY i) AS end_at FROM ("
            f"SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS whole, unnest(gs) AS grp, unnest(gaps[1:len(ms)]) AS gap FROM ("
            f"SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}'{group}) AS gs, string_split_regex(t, '{p}') AS gaps FROM d))) WHERE length(grp) >= {r.least}"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + "), "
        "g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh, "
        "string_agg(kind || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY start_at, kind_no) FILTER (kind_no < 3) AS b, "
        "string_agg(kind || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY start_at, kind_no) AS a FROM s GROUP BY rid) "
        "SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nc, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (rid)"
    )


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_llr.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_OP6_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


_OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

# The rules of the query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URL_GLOBS = [("block", "**/wp-login.php**"), ("block", "**/cgi-bin/**"), ("block", "**.exe")]


def op8_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def _op8_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    globs = " ".join(f"WHEN host || path LIKE '{g.replace('_', '#_').replace('**', '%')}' ESCAPE '#' THEN '{v}'" for v, g in URL_GLOBS)
    return (
        "WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), "
        "h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r), "
        "c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h) "
        f"SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {globs} ELSE 'allow' END AS verdict FROM c"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.link(table(spark, sf_dir, "documents"))


_OP10_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_sentence_spans, op2_secret_ledger, op3_quality_llr, op4_toxicity_mil, op5_best_fit_packing, op6_norm_buckets, op7_warc_chunks, op8_url_automaton, op9_byte_bpe, op10_minhash_forest)}
ORACLE_SQL = {"op2_secret_ledger": _op2_sql(), "op6_norm_buckets": _OP6_SQL, "op7_warc_chunks": _OP7_SQL, "op8_url_automaton": _op8_sql(), "op10_minhash_forest": _OP10_SQL}
