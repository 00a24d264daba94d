"""Queries of the matching operators over the driver's tables, which stand in for heard texts, references and discs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.functions import words
from cinelake.operators import audio, coverage, intervals, matching, scoring, tfidf

from .tables import broadcast_if_small, table, written


def _words_sql(text: str = "text") -> str:
    """A text's words, as `tfidf.words_of` has them."""
    folded = f"translate(lower(coalesce({text}, '')), '{tfidf.FOLD_FROM}', '{tfidf.FOLD_TO}')"
    for base, letter in (("ss", "ß"), ("ae", "æ"), ("oe", "œ")):
        folded = f"replace({folded}, '{letter}', '{base}')"
    return f"regexp_extract_all({folded}, '[\\pL\\pN]+')"


def _terms_sql(key: str, name: str, p: str) -> str:
    """CTEs of the terms of a table's texts: {p}c has id, term, tf."""
    return (
        f"{p}d AS (SELECT {key} AS id, {_words_sql()} AS w FROM {name}), "
        f"{p}t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {p}d), "
        f"{p}c AS (SELECT id, term, count(*) AS tf FROM {p}t GROUP BY ALL)"
    )


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    counts = written(tfidf.term_counts(docs, ["doc_id"]), "terms")
    asked = broadcast_if_small(written(tfidf.term_counts(items, ["item_id"]), "asked"), 64)
    return tfidf.nearest(asked, counts, F.lit(docs.count()), "item_id", "doc_id")


_COSINE_SQL = (
    "WITH " + _terms_sql("doc_id", "documents", "d") + ", " + _terms_sql("item_id", "benchmark", "q")
    + """,
f AS (SELECT term, count(*) AS df FROM dc GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
dr AS (SELECT id, term, (1 + ln(tf)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM dc JOIN f USING (term), n),
qr AS (SELECT id, term, (1 + ln(tf)) * ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5)) AS w FROM qc LEFT JOIN f USING (term), n),
dw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM dr),
qw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM qr),
cs AS (SELECT qw.id AS item_id, dw.id AS doc_id, round(least(1.0, greatest(0.0, sum(qw.w * dw.w))), 6) AS cosine FROM qw JOIN dw USING (term) GROUP BY ALL)
"""
)


def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to each heard text."""
    best = Window.partitionBy("item_id").orderBy(F.desc("cosine"), "doc_id")
    scored = _cosines(spark, sf_dir).withColumn("cosine", F.round("cosine", 6))
    return scored.withColumn("place", F.row_number().over(best)).filter("place <= 5").select("item_id", "doc_id", "cosine", F.col("place").cast("bigint").alias("place"))


_TOPK_SQL = _COSINE_SQL + "SELECT item_id, doc_id, cosine, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS place FROM cs) WHERE place <= 5"


def agg01_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.term_counts(table(spark, sf_dir, "benchmark"), ["item_id"])


def agg02_idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every term of the corpus."""
    docs = table(spark, sf_dir, "documents")
    frequency = tfidf.term_frequency(docs)
    return frequency.select("term", "df", F.round(tfidf.idf(F.lit(docs.count()), F.col("df")), 6).alias("idf"))


def agg05_typical_phrase_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over all phrases of the idf of their words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    frequency = broadcast_if_small(written(tfidf.term_frequency(docs, pairs=False), "frequency"), 48)
    phrases = tfidf.phrase_weights(docs, frequency, F.lit(docs.count()), ["doc_id"])
    return phrases.agg(F.count("*").alias("n_phrases"), F.round(F.avg("weight"), 6).alias("typical_weight"))


_PHRASE_SQL = "WITH d AS (SELECT doc_id, " + _words_sql() + """ AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS docs FROM documents),
p AS (SELECT doc_id, least(pos // 6, greatest(0, (n + 3) // 6 - 1)) AS phrase, sum(ln(1 + (docs - df + 0.5) / (df + 0.5))) AS weight FROM t JOIN f USING (term), n GROUP BY ALL)
SELECT count(*) AS n_phrases, round(avg(weight), 6) AS typical_weight FROM p
"""


def agg10_summary_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each benchmark item's keyword weight each document holds: the best document by score."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    n = items.count()
    keywords = broadcast_if_small(tfidf.summary_keywords(tfidf.split_words(items, ["item_id"]), F.lit(n), ["item_id"]), 48)
    heard = docs.select("doc_id", F.explode(F.array_distinct(tfidf.words_of(F.col("text")))).alias("term"))
    total = keywords.groupBy("item_id").agg(F.sum("w").alias("all_w"))
    hit = heard.join(keywords, "term").groupBy("item_id", "doc_id").agg(F.sum("w").alias("hit_w"))
    scored = hit.join(broadcast_if_small(total, 24), "item_id").withColumn("score", F.round(tfidf.summary_score(F.col("hit_w") / F.col("all_w")), 6))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(best)).filter("place = 1").select("item_id", "doc_id", "score")


_SUMMARY_SQL = "WITH k0 AS (SELECT DISTINCT item_id, unnest(" + _words_sql() + ") AS term FROM benchmark), h AS (SELECT DISTINCT doc_id, unnest(" + _words_sql() + ") AS term FROM documents), " + f"""
k1 AS (SELECT * FROM k0 WHERE length(term) >= 3 AND NOT list_contains(string_split('{" ".join(sorted(words.STOPWORDS))}', ' '), term)), n AS (SELECT count(*) AS n FROM benchmark), f AS (SELECT term, count(*) AS df FROM k1 GROUP BY term),
k AS (SELECT item_id, term, greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 0.05) AS w FROM k1 JOIN f USING (term), n),
a AS (SELECT item_id, sum(w) AS all_w FROM k GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(0.8 * greatest(0.0, least(1.0, (sum(w) / any_value(all_w) - 0.1) / 0.5)), 6) AS score FROM h JOIN k USING (term) JOIN a USING (item_id) GROUP BY ALL)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1
"""


def sca15_duration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File length against runtime, over line items."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 20).alias("file_s"), F.when(F.col("l_tax") > 0, F.col("l_quantity") * 60).alias("runtime_s"))
    return rows.select("l_orderkey", "l_linenumber", F.round(scoring.duration_fit(F.col("file_s"), F.col("runtime_s")), 6).alias("fit"))


def _fit_sql(f: str, r: str) -> str:
    return (
        f"CASE WHEN {r} IS NULL OR {r} <= 0 THEN NULL WHEN {f} <= 0 THEN 0.0 WHEN abs({f} - {r}) <= greatest(60.0, 0.1 * {r}) THEN 1.0 "
        f"WHEN {r} >= 1800 AND {r} % 1800 < 1 AND {f} < {r} AND {f} >= 0.6 * {r} THEN 0.9 "
        f"ELSE exp(-pow((abs({f} - {r}) - greatest(60.0, 0.1 * {r})) / (0.2 * {r} + 30), 2)) END"
    )


_DURATION_SQL = f"SELECT l_orderkey, l_linenumber, round({_fit_sql('f', 'r')}, 6) AS fit FROM (SELECT *, l_extendedprice / 20 AS f, CASE WHEN l_tax > 0 THEN l_quantity * 60 END AS r FROM lineitem)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c, when: F.when(when, c)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        known(F.col("l_discount") * 8, F.col("l_returnflag") != "N").alias("dialogue"),
        known(F.col("l_tax") * 12, F.col("l_linenumber") % 3 != 0).alias("title"),
        known(F.col("l_quantity") / 50, F.col("l_linestatus") == "O").alias("duration"),
        known(F.when(F.col("l_suppkey") % 2 == 0, 1.0).otherwise(0.6), F.col("l_suppkey") % 5 != 0).alias("order"),
        (F.col("l_partkey") % 2 == 0).alias("gate"), (F.col("l_partkey") % 7 == 0).alias("music"),
    )


def _combined() -> F.Column:
    return scoring.combine(*(F.col(c) for c in ("dialogue", "title", "duration", "order", "gate", "music")))


def agg11_combine_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of measured signals with the identity gate."""
    return _signals(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(_combined(), 6).alias("score"))


_SIGNALS_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_discount * 8 END AS d, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax * 12 END AS t,
  CASE WHEN l_linestatus = 'O' THEN l_quantity / 50 END AS u, CASE WHEN l_suppkey % 5 <> 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE 0.6 END END AS o,
  l_partkey % 2 = 0 AS gate, CASE WHEN l_partkey % 7 = 0 THEN 0.3 ELSE 0.15 END AS tw FROM lineitem),
w AS (SELECT *, coalesce(0.55 * d, 0) + coalesce(tw * t, 0) + coalesce(0.1 * u, 0) + coalesce(0.2 * o, 0) AS total,
  (CASE WHEN d IS NULL THEN 0 ELSE 0.55 END) + (CASE WHEN t IS NULL THEN 0 ELSE tw END) + (CASE WHEN u IS NULL THEN 0 ELSE 0.1 END) + (CASE WHEN o IS NULL THEN 0 ELSE 0.2 END) AS weight FROM s),
m AS (SELECT *, (CASE WHEN weight > 0 THEN total::DOUBLE / weight ELSE 0 END) * (CASE WHEN gate AND d IS NOT NULL THEN least(1.0, greatest(d, CASE WHEN t >= 0.5 THEN t ELSE 0 END) / 0.3) ELSE 1 END) AS raw FROM w),
c AS (SELECT l_orderkey, l_linenumber, d, t, round(greatest(0.0, least(1.0, raw)), 6)::DOUBLE AS score FROM m)
"""


def win10_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files and their lines as episodes: the best candidate's margin over the next, verdict, and whether to listen on."""
    every = _signals(spark, sf_dir).withColumn("score", F.round(_combined(), 6))
    scored = every.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("score", "dialogue", "title")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    best = scoring.ranked(scored, ["l_orderkey"], "l_linenumber").filter("place = 1")
    kind = F.when(F.col("score") < 0.25, scoring.verdict_of_none(F.col("score"))).otherwise(scoring.verdict(F.col("score"), F.col("runner_up"), F.col("dialogue"), F.col("title")))
    margin = F.when(F.col("score") < 0.25, 0.25 - F.col("score")).otherwise(F.col("score") - F.col("runner_up"))
    judged = best.select("l_orderkey", "l_linenumber", "score", F.round(margin, 6).alias("margin"), kind.alias("verdict"))
    return judged.withColumn("listen", scoring.needs_listening(F.col("verdict"), F.col("margin")))


_VERDICT_SQL = _SIGNALS_SQL + """,
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY score DESC, d DESC NULLS LAST, t DESC NULLS LAST) AS n FROM c) WHERE n = 1),
r AS (SELECT *, row_number() OVER w AS place, greatest(0.25, coalesce(lead(score) OVER w, 0.25)) AS other FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber)),
v AS (SELECT l_orderkey, l_linenumber, score, round(CASE WHEN score < 0.25 THEN 0.25 - score ELSE score - other END, 6) AS margin,
  CASE WHEN score < 0.25 THEN 'Extra' WHEN score - other >= 0.15 AND (coalesce(d >= 0.3, false) OR coalesce(t >= 0.5, false)) THEN 'Confident' ELSE 'Check' END AS verdict FROM r WHERE place = 1)
SELECT *, verdict = 'Check' OR (verdict = 'Extra' AND margin < 0.15) AS listen FROM v
"""


def agg12_play_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as discs, lines as files: which file holds all others."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("disc"), F.col("l_linenumber").alias("file_id")).agg((F.max("l_quantity") * 60).alias("duration_s"))
    found = scoring.play_all(files, ["disc"])
    return found.select("disc", "file_id", "candidates", F.round("difference", 6).alias("difference"), F.round("ratio", 6).alias("ratio"), "is_play_all", F.round("confidence", 6).alias("confidence"))


_PLAY_ALL_SQL = """
WITH f AS (SELECT l_orderkey AS disc, l_linenumber AS file_id, max(l_quantity) * 60 AS s FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY disc ORDER BY s DESC, file_id) AS n FROM f),
g AS (SELECT disc, count(*) AS candidates, max(CASE WHEN n = 1 THEN file_id END) AS file_id, max(CASE WHEN n = 1 THEN s END) AS l, max(CASE WHEN n = 2 THEN s END) AS s2, sum(CASE WHEN n > 1 THEN s END) AS o FROM r GROUP BY disc),
h AS (SELECT *, abs(l - o) / o AS diff, l / s2 AS ratio FROM g WHERE candidates >= 3 AND s2 > 0)
SELECT disc, file_id, candidates, round(diff, 6) AS difference, round(ratio, 6) AS ratio, ratio >= 3.0 AND diff <= 0.25 AS is_play_all, round(0.7 * greatest(0.0, least(1.0, 1 - diff / 0.25)), 6) AS confidence FROM h
"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order laid end to end: quantity is their length, tax the gap after them."""
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("order_index")).agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("x"), F.max("l_partkey").alias("p"))
    order = Window.partitionBy("job_id").orderBy("order_index")
    gap = F.when(F.col("x") > 0.05, 45.0).otherwise(0.0)
    before = F.coalesce(F.sum(F.col("q") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    skipped = F.coalesce(F.sum(F.when(F.col("x") > 0.05, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return one.select("job_id", "order_index", before.alias("start_s"), (before + F.col("q")).alias("end_s"), (F.row_number().over(order) + skipped).cast("int").alias("chapter"), "p")


_POSITIONS_SQL = """
WITH o AS (SELECT l_orderkey AS job_id, l_linenumber AS order_index, max(l_quantity) AS q, max(l_tax) AS x, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
b AS (SELECT *, coalesce(sum(q + CASE WHEN x > 0.05 THEN 45 ELSE 0 END) OVER v, 0) AS start_s, row_number() OVER u + coalesce(sum(CASE WHEN x > 0.05 THEN 1 ELSE 0 END) OVER v, 0) AS chapter, row_number() OVER u - 1 AS rank
  FROM o WINDOW u AS (PARTITION BY job_id ORDER BY order_index), v AS (PARTITION BY job_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, start_s + q AS end_s, lag(chapter) OVER u AS pc, lag(start_s + q) OVER u AS pe FROM b WINDOW u AS (PARTITION BY job_id ORDER BY order_index)),
m AS (SELECT *, min(CASE WHEN rank = 0 OR (chapter > pc AND (start_s - pe > 3 OR chapter - pc = 1)) THEN 1 ELSE 0 END) OVER w AS marks, list_sort(list(end_s - start_s) OVER w) AS ls FROM s WINDOW w AS (PARTITION BY job_id)),
g AS (SELECT *, CASE WHEN marks = 1 AND rank > 0 AND chapter - pc > 1 AND (start_s - pe) / (chapter - pc - 1) >= ls[len(ls) // 2 + 1] / 2 THEN chapter - pc - 1 ELSE 0 END AS missing FROM m),
z AS (SELECT job_id, order_index, rank, p, (rank + sum(missing) OVER (PARTITION BY job_id ORDER BY order_index))::INTEGER AS slot FROM g)
"""


def win03_disc_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.disc_slots(_positions(spark, sf_dir)).select("job_id", "order_index", "slot")


def win04_order_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order signal of a guessed episode between the nearest anchors."""
    slots = scoring.disc_slots(_positions(spark, sf_dir))
    files = slots.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("order_index")) - 1)
    guess = (F.col("slot") + F.col("p") % 2).cast("int")
    files = files.withColumn("episode", guess).withColumn("anchor", F.when(F.col("p") % 3 == 0, guess))
    near = scoring.nearest_anchors(files)
    return near.select("job_id", "order_index", scoring.order_signal(F.col("episode"), F.col("slot"), F.col("before"), F.col("after")).alias("signal"))


_ORDER_SQL = _POSITIONS_SQL + """,
e AS (SELECT *, slot + p % 2 AS episode, CASE WHEN p % 3 = 0 THEN slot + p % 2 END AS anchor, CASE WHEN p % 3 = 0 THEN slot END AS aslot FROM z),
n AS (SELECT *, last_value(anchor IGNORE NULLS) OVER b AS pa, last_value(aslot IGNORE NULLS) OVER b AS ps, first_value(anchor IGNORE NULLS) OVER a AS na, first_value(aslot IGNORE NULLS) OVER a AS ns FROM e
  WINDOW b AS (PARTITION BY job_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY job_id ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT job_id, order_index, CASE WHEN pa IS NULL AND na IS NULL THEN NULL WHEN coalesce(episode <= pa, false) OR coalesce(episode >= na, false) THEN 0.0
  WHEN coalesce(episode - pa = slot - ps, false) OR coalesce(na - episode = ns - slot, false) THEN 1.0 ELSE 0.6 END::DOUBLE AS signal FROM n
"""


def _listening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of listening, in seconds of their user's day."""
    start = F.hour("ts") * 3600.0 + F.minute("ts") * 60.0 + F.second("ts")
    return table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("day"), start.alias("start_s"), (start + F.col("value") * 40).alias("end_s"))


_LISTENING_SQL = "WITH w AS (SELECT user_id, dayofyear(ts)::INTEGER AS day, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS start_s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE + value * 40 AS end_s FROM events),"
_MERGE_SQL = """
i0 AS (SELECT *, CASE WHEN max(end_s) OVER (PARTITION BY user_id, day ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_s THEN 0 ELSE 1 END AS new FROM {w}),
i1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i0),
m AS (SELECT user_id, day, min(start_s) AS start_s, max(end_s) AS end_s FROM i1 GROUP BY user_id, day, island)
"""
_KEYS = ["user_id", "day"]


def win06_merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intervals.merge_windows(_listening(spark, sf_dir), _KEYS)
    return m.select(*_KEYS, *(F.round(c, 3).alias(c) for c in ("start_s", "end_s")))


def win07_window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _listening(spark, sf_dir)
    files = done.select(*_KEYS).distinct().withColumn("duration_s", F.lit(86400.0))
    return intervals.gaps(files, done, _KEYS).select(*_KEYS, *(F.round(c, 3).alias(c) for c in ("start_s", "end_s")))


_GAPS_SQL = _LISTENING_SQL + """
cl AS (SELECT user_id, day, greatest(start_s, 0.0::DOUBLE) AS start_s, least(end_s, 86400.0::DOUBLE) AS end_s FROM w WHERE least(end_s, 86400.0) > greatest(start_s, 0.0)),
al AS (SELECT * FROM cl UNION ALL SELECT DISTINCT user_id, day, 0::DOUBLE, 0::DOUBLE FROM w UNION ALL SELECT DISTINCT user_id, day, 86400::DOUBLE, 86400::DOUBLE FROM w),""" + _MERGE_SQL.format(w="al") + """,
g AS (SELECT user_id, day, lag(end_s) OVER (PARTITION BY user_id, day ORDER BY start_s) AS a, start_s AS b FROM m)
SELECT user_id, day, round(a, 3) AS start_s, round(b, 3) AS end_s FROM g WHERE b > a
"""


def agg16_covered_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered_seconds(_listening(spark, sf_dir), _KEYS).select(*_KEYS, F.round("covered_s", 3).alias("covered_s"))


def agg20_audio_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.audio_cost(_listening(spark, sf_dir), _KEYS).select(*_KEYS, F.round("cost_s", 3).alias("cost_s"))


def ker10_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to listen first in files of a line item's length."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") * 30).alias("duration_s"))
    planned = intervals.plan_windows(files, ["l_orderkey", "l_linenumber"])
    return planned.select("l_orderkey", "l_linenumber", *(F.round(c, 3).alias(c) for c in ("start_s", "end_s")))


_PLAN_SQL = """
WITH f AS (SELECT l_orderkey AS user_id, l_linenumber AS day, max(l_quantity) * 30 AS d FROM lineitem GROUP BY ALL),
s AS (SELECT user_id, day, d, unnest([0.15, 0.40, 0.65, 0.85]) AS share FROM f WHERE d > 360),
w AS (SELECT user_id, day, greatest(0.0, least(share * d - 52.5, d - 105))::DOUBLE AS start_s, greatest(0.0, least(share * d - 52.5, d - 105))::DOUBLE + 105 AS end_s FROM s),""" + _MERGE_SQL.format(w="w") + """
SELECT user_id AS l_orderkey, day AS l_linenumber, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM m
UNION ALL SELECT user_id, day, 0::DOUBLE, round(d, 3) FROM f WHERE d <= 360 AND d > 0
"""


def ker10_escalation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to listen next, a planned round done."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") * 30).alias("duration_s"))
    keys = ["l_orderkey", "l_linenumber"]
    more = intervals.escalation_windows(files, intervals.plan_windows(files, keys), keys)
    return more.select(*keys, *(F.round(c, 3).alias(c) for c in ("start_s", "end_s")))


def agg21_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("user_id", (F.col("value") * 10).alias("audio_s"), F.col("value").alias("compute_s"))
    return intervals.speed(runs, ["user_id"], prior=4.0).select("user_id", F.round("speed", 6).alias("speed"))


def agg26_offset_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised correlation of the vectors of the stated set (ids divisible by 20) with all others, also one value early or late."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"))
    asked = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return audio.correlations_of_all(asked, v, "query_id", "vec_id", 1, digits=6, small=F.broadcast if asked.count() * 600 <= 8 << 20 else lambda df: df)


_OFFSETS_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, len(embedding) AS n FROM embeddings),
p AS (SELECT q.vec_id AS query_id, h.vec_id, o AS "offset", q.v[greatest(1, 1 - o):least(q.n, h.n - o)] AS a, h.v[greatest(1, 1 + o):least(h.n, q.n + o)] AS b
  FROM v q JOIN v h ON q.vec_id <> h.vec_id, (SELECT unnest([-1, 0, 1])::BIGINT AS o) WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, "offset", len(a) AS rows_inside, round(CASE WHEN list_inner_product(a, a) * list_inner_product(b, b) > 0 THEN list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) ELSE 0 END, 6) AS correlation FROM p
"""


def joi05_summary_by_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each benchmark item's keyword weight is heard in each conversation turn, by word or by sound: the best turn."""
    items, turns = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    tokens = written(coverage.tokens(items, ["item_id"]), "tokens")
    weights = tfidf.summary_keywords(tokens.select("item_id", F.col("word").alias("term")), F.lit(items.count()), ["item_id"])
    keywords = written(weights.join(tokens.select("item_id", F.col("word").alias("term"), "code").distinct(), ["item_id", "term"]).withColumnRenamed("term", "word"), "keywords")
    heard = written(coverage.tokens(turns.select(F.struct("conv_id", "turn").alias("at"), "text"), ["at"]), "heard")
    scored = coverage.summary_scores(broadcast_if_small(keywords, 64), heard, "item_id", "at")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), "at"))
    return scored.withColumn("place", place).filter("place = 1").select("item_id", "at.conv_id", "at.turn", F.round("score", 6).alias("score"))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Conversations as jobs: their turns are episodes with reference texts, and files that heard the middle of one, in another order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    told = F.split("text", " ")
    episodes = turns.select(F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("ord"), F.when(F.col("turn") % 5 == 4, 0).otherwise(1).alias("season"), F.col("turn").cast("int").alias("number"), F.array_join(F.slice(told, 2, 3), " ").alias("title"), (F.size(told) * 30.0).alias("runtime_s"), F.when(F.col("turn") % 3 == 2, F.col("text")).alias("summary"))
    texts = turns.filter("turn % 3 != 2").select(F.col("conv_id").alias("job_id"), F.when(F.col("turn") % 5 == 4, 0).otherwise(1).alias("season"), F.col("turn").cast("int").alias("number"), F.when(F.col("turn") % 3 == 0, "subtitles").otherwise("lyrics").alias("kind"), F.lit(0).alias("pos"), "text")
    middle = F.array_join(F.slice(told, F.floor(F.size(told) / 10).cast("int") + 1, F.greatest(F.lit(1), F.floor(F.size(told) * 0.8).cast("int"))), " ")
    files = turns.select(F.col("conv_id").alias("job_id"), F.concat(F.lit("file "), 97 - F.col("turn")).alias("file_id"), (F.size(told) * 30.0).alias("duration_s"), middle.alias("transcript"), F.when(F.col("turn") % 7 == 6, F.col("text")).alias("embedded_text"), (F.col("turn") % 11 == 10).alias("mostly_music"))
    positions = turns.filter("conv_id % 2 = 0 and turn % 4 != 3").select(F.col("conv_id").alias("job_id"), F.concat(F.lit("file "), 97 - F.col("turn")).alias("file_id"), F.col("turn").cast("int").alias("order_index"), F.lit(None).cast("int").alias("chapter"), (F.col("turn") * 60.0).alias("start_s"), (F.col("turn") * 60.0 + 60).alias("end_s"))
    return files, episodes, texts, positions


def joi01_score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of every job against every episode of it: all signals and the score."""
    scores = matching.score_all(*_jobs(spark, sf_dir), keep=written)
    return scores.select("job_id", "file_id", "ord", *(F.round(c, 6).alias(c) for c in ("dialogue", "title", "duration", "order", "content", "score")), "rank")


def ker05_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching run: every file's episode, verdict and best candidates."""
    found = matching.match_files(*_jobs(spark, sf_dir), keep=written)
    return found.select("job_id", "file_id", "season", "number", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "verdict", "used_order", F.size("candidates").alias("n_candidates"))


QUERIES = {f.__name__: f for f in (
    tfidf_cosine_topk, agg01_term_counts, agg02_idf_terms, agg05_typical_phrase_weight, agg10_summary_keywords, sca15_duration_fit, agg11_combine_signals, win10_verdicts,
    agg12_play_all, win03_disc_slots, win04_order_signal, win06_merge_windows, win07_window_gaps, agg16_covered_seconds, agg20_audio_cost, ker10_plan_windows,
    ker10_escalation_windows, agg21_speed, agg26_offset_correlation, joi05_summary_by_sound, joi01_score_matrix, ker05_matches,
)}
ORACLE_SQL = {
    "tfidf_cosine_topk": _TOPK_SQL,
    "agg01_term_counts": "WITH " + _terms_sql("item_id", "benchmark", "") + " SELECT id AS item_id, term, tf FROM c",
    "agg02_idf_terms": "WITH " + _terms_sql("doc_id", "documents", "") + ", n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, n",
    "agg05_typical_phrase_weight": _PHRASE_SQL,
    "agg10_summary_keywords": _SUMMARY_SQL,
    "sca15_duration_fit": _DURATION_SQL,
    "agg11_combine_signals": _SIGNALS_SQL + "SELECT l_orderkey, l_linenumber, score FROM c",
    "win10_verdicts": _VERDICT_SQL,
    "agg12_play_all": _PLAY_ALL_SQL,
    "win03_disc_slots": _POSITIONS_SQL + "SELECT job_id, order_index, slot FROM z",
    "win04_order_signal": _ORDER_SQL,
    "win06_merge_windows": _LISTENING_SQL + _MERGE_SQL.format(w="w") + "SELECT user_id, day, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM m",
    "win07_window_gaps": _GAPS_SQL,
    "agg16_covered_seconds": _LISTENING_SQL + _MERGE_SQL.format(w="w") + "SELECT user_id, day, round(sum(end_s - start_s), 3) AS covered_s FROM m GROUP BY user_id, day",
    "agg20_audio_cost": _LISTENING_SQL.rstrip(",") + " SELECT user_id, day, round(sum(CASE WHEN end_s > start_s THEN greatest(end_s - start_s, 30.0) ELSE 0 END), 3) AS cost_s FROM w GROUP BY user_id, day",
    "ker10_plan_windows": _PLAN_SQL,
    "agg21_speed": "SELECT user_id, round((60 + sum(value * 10)) / (15 + sum(value)), 6) AS speed FROM events GROUP BY user_id",
    "agg26_offset_correlation": _OFFSETS_SQL,
}
