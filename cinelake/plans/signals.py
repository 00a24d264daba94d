"""Queries of the signal, disc, listening and assignment operators over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.operators import assignment, audio, discs, intervals, scoring, segments, tfidf
from cinelake.streaming import folds

from .tables import table

_KEYS = ["l_orderkey", "l_linenumber"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, sf_dir, "lineitem").groupBy(*_KEYS).agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")))


_LINES = "l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS x, max(l_extendedprice) AS e, max(l_returnflag) AS rf, max(l_linestatus) AS ls FROM lineitem GROUP BY ALL)"


def fil08_heard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue and title as far as enough was heard; a heard title counts for all episodes of its file."""
    rows = _lines(spark, sf_dir).withColumn("title", F.when(F.col("l_partkey") % 5 == 0, F.col("l_tax") * 10))
    best = F.max("title").over(Window.partitionBy("l_orderkey"))
    told = scoring.heard_gate(F.col("l_orderkey") % 4, (F.col("l_quantity") / 4).cast("int"), best, F.col("l_discount") * 10, F.col("title"))
    return rows.select(*_KEYS, F.round(told[0], 6).alias("dialogue"), F.round(told[1], 6).alias("title"))


_GATE_SQL = (
    "WITH " + _LINES + ", t AS (SELECT *, CASE WHEN p % 5 = 0 THEN x * 10 END AS title, floor(q / 4) >= 8 AS enough FROM l), b AS (SELECT *, max(title) OVER (PARTITION BY l_orderkey) AS best FROM t) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN enough THEN round(d * 10, 6) END AS dialogue, CASE WHEN l_orderkey % 4 > 0 AND (enough OR coalesce(best, 0) > 0) THEN round(coalesce(title, 0), 6) END::DOUBLE AS title FROM b"
)


def fil11_sampling_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether speech detection pays, how many windows a file was sampled by, whether it is unusable, and its starting speed."""
    d = F.col("l_quantity") * 20
    return _lines(spark, sf_dir).select(
        *_KEYS, intervals.use_vad(d, F.col("l_returnflag") == "A").alias("use_vad"), segments.sampled_windows(d, F.col("l_discount") * 9000, F.col("l_linenumber")).alias("windows"),
        segments.unusable(F.col("l_linestatus") == "F", F.when(F.col("l_partkey") % 3 == 0, " ").when(F.col("l_partkey") % 3 == 1, "text"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") - 1)).alias("unusable"),
        intervals.prior_speed(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "N", "fast").otherwise("accurate")).alias("speed"),
    )


_SAMPLING_SQL = (
    "WITH " + _LINES + " SELECT l_orderkey, l_linenumber, rf <> 'A' AND q * 20 > 360 AS use_vad, CASE WHEN q * 20 > 360 AND d * 9000 + 1 < q * 20 THEN l_linenumber END::INTEGER AS windows, "
    "ls = 'F' AND p % 3 <> 1 AND (s % 2 = 1 OR l_linenumber = 1) AS unusable, CASE WHEN ls = 'O' THEN CASE WHEN rf = 'N' THEN 40.0 ELSE 15.0 END ELSE CASE WHEN rf = 'N' THEN 4.0 ELSE 1.0 END END::DOUBLE AS speed FROM l"
)


def fil15_input_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: parts listed twice, and suppliers named in an order that lists no such part."""
    rows = table(spark, sf_dir, "lineitem")
    files = rows.select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 9).alias("file_id"))
    return scoring.input_problems(files, rows.select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 9).alias("file_id")))


_PROBLEMS_SQL = """
WITH f AS (SELECT l_orderkey AS job_id, l_partkey % 9 AS file_id FROM lineitem), o AS (SELECT DISTINCT l_orderkey AS job_id, l_suppkey % 9 AS file_id FROM lineitem)
SELECT job_id, 'listedTwice' AS problem, file_id FROM f GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT job_id, 'unknownInOrder', file_id FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.job_id = o.job_id AND f.file_id = o.file_id)
"""


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order laid along its play-all, some over others; and chapters of ten minutes."""
    rows = _lines(spark, sf_dir)
    at = (F.col("l_linenumber") - 1) * 600.0 + F.col("l_tax") * 800 * (F.col("l_partkey") % 2)
    located = rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("file_id"), at.alias("offset_s"), (300 + F.col("l_quantity") * 8).alias("length_s"), (0.3 + F.col("l_discount") * 5).alias("score"))
    chapters = rows.filter("l_linenumber != 4").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chapter"), ((F.col("l_linenumber") - 1) * 600.0).alias("start_s"), (F.col("l_linenumber") * 600.0 - 5).alias("end_s"))
    return located, chapters


_LOCATED = (
    _LINES + ", f AS (SELECT l_orderkey AS job_id, l_linenumber AS file_id, (l_linenumber - 1) * 600.0::DOUBLE + x * 800 * (p % 2) AS o, 300 + q * 8 AS n, 0.3 + d * 5 AS score FROM l), "
    "c AS (SELECT l_orderkey AS job_id, l_linenumber AS chapter, (l_linenumber - 1) * 600.0::DOUBLE AS a, l_linenumber * 600.0::DOUBLE - 5 AS b FROM l WHERE l_linenumber <> 4)"
)


def joi07_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.overlapping(_located(spark, sf_dir)[0]).select("job_id", "a", "b", F.round("shared_s", 3).alias("shared_s"))


_OVERLAPS_SQL = "WITH " + _LOCATED + " SELECT x.job_id, x.file_id AS a, y.file_id AS b, round(least(x.o + x.n, y.o + y.n) - greatest(x.o, y.o), 3) AS shared_s FROM f x JOIN f y ON x.job_id = y.job_id AND x.file_id < y.file_id WHERE least(x.o + x.n, y.o + y.n) - greatest(x.o, y.o) > 2"


def joi08_on_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that start with a chapter, and the chapter that holds each."""
    located, chapters = _located(spark, sf_dir)
    held = discs.containing_chapter(located, chapters).select("job_id", "file_id", "chapter")
    return held.join(discs.on_chapters(located, chapters).select("job_id", "file_id", F.lit(True).alias("starts")), ["job_id", "file_id"], "left").fillna(False, ["starts"])


_CHAPTERS_SQL = (
    "WITH " + _LOCATED + " SELECT f.job_id, f.file_id, (SELECT min(chapter) FROM c WHERE c.job_id = f.job_id AND a <= o + least(n / 2, 1.0) AND o + least(n / 2, 1.0) < b) AS chapter, "
    "EXISTS (SELECT 1 FROM c WHERE c.job_id = f.job_id AND abs(o - a) <= greatest(3.0, 0.02 * n)) AS starts FROM f"
)


def ker09_disc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that located files tell, and what is wrong with it."""
    located, chapters = _located(spark, sf_dir)
    given = located.groupBy("job_id").agg((F.count("*") + F.col("job_id") % 4).alias("n_files")).select("job_id", "n_files")
    return discs.derive_order(located, chapters, given).select("job_id", "file_id", "order_index", "chapter", "problem")


def joi06_chapter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and files of an order that are of like length."""
    rows = _lines(spark, sf_dir)
    chapters = rows.select("l_orderkey", F.col("l_linenumber").alias("chapter"), (F.col("l_quantity") * 10).alias("chapter_s"))
    files = rows.select("l_orderkey", F.col("l_linenumber").alias("file"), (F.col("l_quantity") * 10 + F.col("l_tax") * 100 - 3).alias("duration_s")).filter("duration_s > 0")
    return scoring.chapter_pairs(chapters, files, ["l_orderkey"]).select("l_orderkey", "chapter", "file", F.round("off", 6).alias("off"))


_PAIRS_SQL = "WITH " + _LINES + ", f AS (SELECT *, q * 10 + x * 100 - 3 AS t FROM l WHERE q * 10 + x * 100 - 3 > 0) SELECT c.l_orderkey, c.l_linenumber AS chapter, f.l_linenumber AS file, round(abs(c.q * 10 - t), 6) AS off FROM l c JOIN f USING (l_orderkey) WHERE abs(c.q * 10 - t) <= greatest(2.0, 0.01 * t)"


def agg28_missing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") >= 20).alias("n_candidates"), F.count("*").alias("n_chapters"), F.count_if(F.col("l_tax") > 0.03).alias("matched"))
    return scoring.missing_titles(rows)


_MISSING_SQL = "WITH " + _LINES + ", g AS (SELECT l_orderkey, count(*) FILTER (q >= 20) AS n_candidates, count(*) AS n_chapters, count(*) FILTER (x > 0.03) AS matched FROM l GROUP BY l_orderkey) SELECT *, CASE WHEN n_chapters > n_candidates AND 2 * matched >= n_candidates THEN 'missingShortTitles' END AS warning FROM g"


def msc01_play_all_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("disc"), F.col("l_linenumber").alias("file_id"), F.pow(F.col("l_quantity"), 2).alias("duration_s"))
    return scoring.play_all_match(scoring.play_all(files, ["disc"]), ["disc"])


_PLAY_ALL_SQL = "WITH " + _LINES + """, f AS (SELECT l_orderkey AS disc, l_linenumber AS file_id, pow(q, 2) AS s FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY disc ORDER BY s DESC, file_id) AS n FROM f),
g AS (SELECT disc, count(*) AS c, max(CASE WHEN n = 1 THEN file_id END) AS file_id, max(CASE WHEN n = 1 THEN s END) AS l, max(CASE WHEN n = 2 THEN s END) AS s2, sum(CASE WHEN n > 1 THEN s END) AS o FROM r GROUP BY disc)
SELECT disc, file_id, 'PlayAll' AS verdict, 1.0::DOUBLE AS score, 1.0::DOUBLE AS margin FROM g WHERE c >= 3 AND s2 > 0 AND l / s2 >= 3 AND abs(l - o) / o <= 0.25"""


def agg13_chapter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs whose longest file has chapters of about the lengths of the others: how many pair off, and whether it is the play-all."""
    rows = _lines(spark, sf_dir).filter("l_linenumber < 7").select(F.col("l_orderkey").alias("disc"), F.col("l_linenumber").alias("file_id"), (F.col("l_quantity") * 20 + 60).alias("duration_s"), F.col("l_tax"), F.col("l_partkey"))
    whole = rows.groupBy("disc").agg(F.lit(99).alias("file_id"), (F.sum("duration_s") * (F.max("l_partkey") % 3 * 0.2 + 0.8)).alias("duration_s"))
    chapters = rows.filter("l_partkey % 5 > 0").select("disc", F.lit(99).alias("file_id"), (F.col("duration_s") + F.col("l_tax") * 100 - 3).alias("chapter_s"))
    found = scoring.play_all(rows.select("disc", "file_id", "duration_s").unionByName(whole), ["disc"], chapters)
    return found.filter("file_id = 99").select("disc", "n_chapters", "matched", "is_play_all", F.round("confidence", 6).alias("confidence"))


_MATCHED_SQL = "WITH " + _LINES + """, r AS (SELECT l_orderkey AS disc, l_linenumber AS f, q * 20 + 60 AS s, x, p FROM l WHERE l_linenumber < 7),
w AS (SELECT disc, count(*) + 1 AS n, sum(s) * (max(p) % 3 * 0.2 + 0.8) AS w, sum(s) AS others, max(s) AS s2 FROM r GROUP BY disc), d AS (SELECT * FROM w WHERE n >= 3 AND w > s2),
c AS (SELECT disc, row_number() OVER (PARTITION BY disc ORDER BY s + x * 100 - 3) AS no, s + x * 100 - 3 AS c FROM r WHERE p % 5 > 0 AND s + x * 100 - 3 > 0), k AS (SELECT disc, count(*) AS n_chapters FROM c GROUP BY disc),
b AS (SELECT disc, list([no, 100 + f] ORDER BY abs(c - s), no, f) AS pairs FROM c JOIN r USING (disc) WHERE abs(c - s) <= greatest(2.0, 0.01 * s) GROUP BY disc),
m AS (SELECT disc, len(list_reduce(list_prepend([]::BIGINT[], pairs), lambda acc, x: CASE WHEN list_contains(acc, x[1]) OR list_contains(acc, x[2]) THEN acc ELSE acc || x END)) // 2 AS matched FROM b),
t AS (SELECT disc, coalesce(n_chapters, 0) AS nc, coalesce(matched, 0) AS m, abs(w - others) / others AS diff, w / s2 AS ratio, coalesce(matched, 0) / (n - 1) AS share FROM d LEFT JOIN k USING (disc) LEFT JOIN m USING (disc)),
u AS (SELECT *, greatest(0.0, least(1.0, 1 - diff / 0.25)) AS a, greatest(0.0, least(1.0, share)) AS b, nc >= 2 AND share >= 0.5 AND m >= 2 AS by_chapters FROM t)
SELECT disc, nc::INTEGER AS n_chapters, m::INTEGER AS matched, (ratio >= 3 AND (diff <= 0.25 OR by_chapters)) OR (ratio >= 1.5 AND diff <= 0.25 AND by_chapters) AS is_play_all, round(CASE WHEN nc >= 2 THEN 0.6 * greatest(a, b) + 0.4 * least(a, b) ELSE 0.7 * a END, 6) AS confidence FROM u"""


def agg09_dialogue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage as far as what was heard is telling, and both cosines."""
    typical = F.col("l_linenumber") - 1
    score = tfidf.dialogue_score(F.col("l_discount") * 9, F.col("l_tax") * 8, F.col("l_tax") * 4, F.col("l_quantity") / 12, typical)
    return _lines(spark, sf_dir).select(*_KEYS, F.round(score, 6).alias("score"))


_SCORE_SQL = "WITH " + _LINES + " SELECT l_orderkey, l_linenumber, round(0.5 * d * 9 * CASE WHEN l_linenumber = 1 THEN 1.0 ELSE least(1.0, q / 12 / (0.5 * (l_linenumber - 1))) END + 0.25 * least(1.0, x * 8 / 0.45) + 0.25 * least(1.0, x * 4 / 0.45), 6) AS score FROM l"


def top01_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's five best orders by price; a chosen one beyond them takes the last place."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("file"), F.col("o_orderkey").alias("episode"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey")).alias("_c"))
    chosen = F.min("_c").over(Window.partitionBy("file"))
    ranks = scoring.ranked(rows.withColumn("assigned", chosen), ["file"], "episode")
    return scoring.top_candidates(ranks, ["file"], "episode", "assigned").select("file", "episode", F.col("place").cast("bigint").alias("place"))


_CANDIDATES_SQL = """
WITH r AS (SELECT o_custkey % 300 AS file, o_orderkey AS episode, min(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 300) AS assigned,
  row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
f AS (SELECT *, max(CASE WHEN episode = assigned THEN place END) OVER (PARTITION BY file) AS far FROM r)
SELECT file, episode, place FROM f WHERE place < 5 OR episode = assigned OR (place = 5 AND coalesce(far, 0) <= 5)
"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as files and as episodes, scored by how near their prices and taxes are."""
    rows = _lines(spark, sf_dir).filter("l_linenumber <= 6")
    files = rows.select("l_orderkey", F.col("l_linenumber").alias("file"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"))
    episodes = rows.select("l_orderkey", F.col("l_linenumber").alias("episode"), F.col("l_quantity").alias("eq"), F.col("l_tax").alias("ex"))
    score = F.greatest(F.lit(0.0), 1 - F.abs(F.col("q") - F.col("eq") - 6) / 20 - F.abs(F.col("x") - F.col("ex")) * 4)
    return files.join(episodes, "l_orderkey").withColumn("s", F.round(score, 6))


_MATRIX = _LINES + ", w AS (SELECT * FROM l WHERE l_linenumber <= 6), m AS (SELECT a.l_orderkey AS job, a.l_linenumber AS file, b.l_linenumber AS ep, round(greatest(0.0, 1 - abs(a.q - b.q - 6) / 20 - abs(a.x - b.x) * 4), 6) AS s FROM w a JOIN w b ON a.l_orderkey = b.l_orderkey)"


def _total(scores: DataFrame, none: float) -> DataFrame:
    """What a job's assignment adds up to."""
    out = assignment.assign(scores, "l_orderkey", "file", "episode")
    got = out.join(scores.select("l_orderkey", "file", "episode", "final"), ["l_orderkey", "file", "episode"], "left")
    return got.groupBy("l_orderkey").agg(F.round(F.sum(F.coalesce("final", F.lit(none))), 5).alias("total"))


def ker01_best_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest total of a free assignment of every order's lines."""
    m = _matrix(spark, sf_dir).select("l_orderkey", "file", "episode", F.col("s").alias("content"), F.col("s").alias("final"), F.lit(True).alias("heard"), F.lit(None).cast("int").alias("rank"), F.lit(False).alias("special"))
    return _total(m, 0.25)


def _best_sql() -> str:
    """Every choice of columns, file by file: the best total for each set of columns taken."""
    levels = ["b0 AS (SELECT DISTINCT job, 0 AS taken, 0.0::DOUBLE AS total FROM m)"]
    for k in range(1, 7):
        levels.append(
            f"b{k} AS (SELECT job, taken, max(total) AS total FROM (SELECT b.job, b.taken | (1 << m.ep) AS taken, b.total + m.s AS total FROM b{k - 1} b JOIN m ON m.job = b.job AND m.file = {k} WHERE b.taken & (1 << m.ep) = 0 "
            f"UNION ALL SELECT b.job, b.taken, b.total + CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = b.job AND w.l_linenumber = {k}) THEN 0.25 ELSE 0 END FROM b{k - 1} b) GROUP BY ALL)"
        )
    return "WITH " + _MATRIX + ", " + ", ".join(levels) + " SELECT job AS l_orderkey, round(max(total), 5) AS total FROM b6 GROUP BY job"


def ker02_ordered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest total of files in the disc's order, rising in both; files may go without at a price, then take what is left."""

    import pandas as pd

    m = _matrix(spark, sf_dir).select("l_orderkey", "file", "episode", "s")
    packed = m.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("file", "episode", "s"))).alias("rows"))

    def run(batches):
        for b in batches:
            out = []
            for job, rows in zip(b["l_orderkey"], b["rows"], strict=True):
                n = round(len(rows) ** 0.5)
                wide = np.array([r["s"] for r in rows]).reshape(n, n) - 0.25
                got = assignment.in_order(wide, np.full(n, -0.1))
                out.append((job, round(float(sum(-0.1 if c is None else wide[f, c] for f, c in enumerate(got))), 5)))
            yield pd.DataFrame(out, columns=["l_orderkey", "total"])

    return packed.mapInPandas(run, "l_orderkey bigint, total double")


def _ordered_sql() -> str:
    levels = ["b0 AS (SELECT DISTINCT job, 0 AS last, 0.0::DOUBLE AS total FROM m)"]
    for k in range(1, 7):
        levels.append(
            f"b{k} AS (SELECT job, last, max(total) AS total FROM (SELECT b.job, m.ep AS last, b.total + m.s - 0.25 AS total FROM b{k - 1} b JOIN m ON m.job = b.job AND m.file = {k} WHERE m.ep > b.last "
            f"UNION ALL SELECT b.job, b.last, b.total - CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = b.job AND w.l_linenumber = {k}) THEN 0.1 ELSE 0 END FROM b{k - 1} b) GROUP BY ALL)"
        )
    return "WITH " + _MATRIX + ", " + ", ".join(levels) + " SELECT job AS l_orderkey, round(max(total), 5) AS total FROM b6 GROUP BY job"


def agg25_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each user's day of events rises in value."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.dayofyear("ts")).alias("job"), "event_id", "value")
    return assignment.agreement(rows, "job", "event_id", "value").select("job", F.round("agreement", 6).alias("agreement"))


_RISING_SQL = """
WITH v AS (SELECT user_id || '-' || dayofyear(ts) AS job, list([value] ORDER BY event_id) AS vs FROM events GROUP BY 1)
SELECT job, round(len(list_reduce(vs, lambda acc, x: acc[1:len(list_filter(acc, lambda t: t < x[1]))] || x || acc[len(list_filter(acc, lambda t: t < x[1])) + 2:])) / len(vs), 6) AS agreement FROM v
"""


def win11_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as log energies: their changes as signed bytes, and sums of four of these."""

    def run(batches):
        for b in batches:
            steps = [audio.deltas(np.asarray(v, float)[:, None]) for v in b.embedding]
            b["steps"] = [",".join(map(str, s[:, 0].tolist())) for s in steps]
            b["pools"] = [",".join(map(str, audio.pooled(s)[:, 0].tolist())) for s in steps]
            yield b[["vec_id", "steps", "pools"]]

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("embedding"))
    return rows.mapInPandas(run, "vec_id bigint, steps string, pools string").select("vec_id", F.md5("steps").alias("steps_md5"), F.md5("pools").alias("pools_md5"))


_DELTAS_SQL = """
WITH d AS (SELECT vec_id, list_transform(range(1, len(embedding)), lambda i: greatest(-127, least(127, round_even((embedding[i + 1]::DOUBLE * 8 - embedding[i]::DOUBLE * 8) * 16, 0)))::INTEGER) AS s FROM embeddings)
SELECT vec_id, md5(array_to_string(s, ',')) AS steps_md5, md5(array_to_string(list_transform(range(len(s) - 3), lambda i: s[i + 1] + s[i + 2] + s[i + 3] + s[i + 4]), ',')) AS pools_md5 FROM d
"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stretches of speech of a user's day, in seconds."""
    start = F.hour("ts") * 60.0 + F.minute("ts") + F.second("ts") / 60
    return table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("day"), start.alias("start_s"), (start + F.col("value") - 1).alias("end_s"), "event_id")


_REGIONS = "r AS (SELECT user_id, dayofyear(ts)::INTEGER AS day, hour(ts) * 60.0::DOUBLE + minute(ts) + second(ts) / 60 AS a, hour(ts) * 60.0::DOUBLE + minute(ts) + second(ts) / 60 + value - 1 AS b, event_id FROM events)"
_LAYOUT = (
    _REGIONS + ", g AS (SELECT * FROM r WHERE b > a), n AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.3 THEN 0 ELSE 1 END AS new FROM g), "
    "i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY a, b) AS k FROM n), m AS (SELECT user_id, day, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, day, k), "
    "z AS (SELECT *, coalesce(sum(b - a + 0.2) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM m)"
)


def win16_speech_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = intervals.speech_layout(_regions(spark, sf_dir), ["user_id", "day"])
    return layout.select("user_id", "day", *(F.round(c, 4).alias(c) for c in ("start_s", "end_s", "joined_start_s")))


def ker12_to_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the joined speech of each day, as places in the day."""
    regions = _regions(spark, sf_dir)
    layout = intervals.speech_layout(regions, ["user_id", "day"])
    asked = regions.select("user_id", "day", (F.col("event_id") % 50 + 0.05).alias("at_s")).distinct()
    days = layout.select("user_id", "day").distinct()
    return intervals.to_original(asked.join(days, ["user_id", "day"], "left_semi"), layout, ["user_id", "day"]).select("user_id", "day", "at_s", F.round("original_s", 4).alias("original_s"))


_ORIGINAL_SQL = (
    "WITH " + _LAYOUT + ", t AS (SELECT DISTINCT user_id, day, (event_id % 50)::DOUBLE + 0.05 AS at_s FROM r WHERE EXISTS (SELECT 1 FROM z WHERE z.user_id = r.user_id AND z.day = r.day)) "
    "SELECT t.user_id, t.day, t.at_s, round(least(z.a + greatest(0.0, t.at_s - z.j), z.b), 4) AS original_s FROM t ASOF JOIN z ON t.user_id = z.user_id AND t.day = z.day AND t.at_s >= z.j"
)


def agg15_mostly_music(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files: how many of their turns are music or no speech, and how sure their words are on average."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("♪ "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"), F.when(F.length("text") % 5 == 0, "noSpeech").alias("filtered"))
    tokens = turns.select("conv_id", (-F.length(F.coalesce("text", F.lit(""))) / 1000).alias("logprob"), (F.col("role") == "user").alias("is_text"))
    return segments.mostly_music(rows, ["conv_id"]).join(segments.average_logprob(tokens, ["conv_id"]), "conv_id").select("conv_id", "mostly_music", F.round("avg_logprob", 6).alias("avg_logprob"))


_MUSIC_SQL = "SELECT conv_id, 2 * count(*) FILTER (coalesce(turn % 2 = 1 AND text IS NOT NULL, false) OR coalesce(length(text) % 5 = 0, false)) > count(*) AS mostly_music, round(coalesce(avg(-length(coalesce(text, '')) / 1000) FILTER (role = 'user'), 0), 6) AS avg_logprob FROM conversations GROUP BY conv_id"


def str03_undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal's operations: what undoing each user's moves would do, as the files now are."""
    e = table(spark, sf_dir, "events")
    at = lambda c: F.concat(F.lit("/d/"), F.col("user_id"), F.lit("/"), c)
    ops = e.select(F.col("user_id").cast("string").alias("entry"), (F.col("event_id") % 7).cast("string").alias("item"), F.lit("move").alias("action"), F.col("event_id").alias("line_no"), at(F.col("event_id") - 7).alias("from"), at(F.col("event_id")).alias("to"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    disk = e.filter("event_type != 'view'").select(at(F.col("event_id")).alias("path"), F.floor("value").alias("size_bytes"), (F.floor("value") + F.col("event_id") % 2).alias("written_bytes"))
    return folds.undo_plan(ops, disk).select("entry", "item", "from", "to", "action", F.col("turn").cast("bigint").alias("turn"))


_UNDO_SQL = """
WITH d AS (SELECT * FROM events WHERE event_type <> 'error'), m AS (SELECT user_id, event_id % 7 AS item, min(event_id) - 7 AS f, max(event_id) AS t FROM d GROUP BY ALL), k AS (SELECT user_id, event_id, event_id % 2 = 1 AS changed FROM events WHERE event_type <> 'view')
SELECT m.user_id::VARCHAR AS entry, item::VARCHAR AS item, '/d/' || m.user_id || '/' || t AS "from", '/d/' || m.user_id || '/' || f AS "to",
  CASE WHEN k.event_id IS NULL THEN 'missing' WHEN k.changed THEN 'changed' WHEN EXISTS (SELECT 1 FROM k x WHERE x.user_id = m.user_id AND x.event_id = f) THEN 'taken' ELSE 'back' END AS action,
  row_number() OVER (PARTITION BY m.user_id ORDER BY t DESC) AS turn FROM m LEFT JOIN k ON k.user_id = m.user_id AND k.event_id = t
"""


QUERIES = {f.__name__: f for f in (
    fil08_heard_gate, fil11_sampling_rules, fil15_input_problems, joi07_overlaps, joi08_on_chapters, ker09_disc_order, joi06_chapter_pairs, agg28_missing_titles, msc01_play_all_match, agg13_chapter_matches,
    agg09_dialogue_score, top01_candidates, ker01_best_totals, ker02_ordered_totals, agg25_rising, win11_deltas, win16_speech_layout, ker12_to_original, agg15_mostly_music, str03_undo_plan,
)}
ORACLE_SQL = {
    "fil08_heard_gate": _GATE_SQL,
    "fil11_sampling_rules": _SAMPLING_SQL,
    "fil15_input_problems": _PROBLEMS_SQL,
    "joi07_overlaps": _OVERLAPS_SQL,
    "joi08_on_chapters": _CHAPTERS_SQL,
    "joi06_chapter_pairs": _PAIRS_SQL,
    "agg28_missing_titles": _MISSING_SQL,
    "msc01_play_all_match": _PLAY_ALL_SQL,
    "agg09_dialogue_score": _SCORE_SQL,
    "agg13_chapter_matches": _MATCHED_SQL,
    "top01_candidates": _CANDIDATES_SQL,
    "ker01_best_totals": _best_sql(),
    "ker02_ordered_totals": _ordered_sql(),
    "agg25_rising": _RISING_SQL,
    "win11_deltas": _DELTAS_SQL,
    "win16_speech_layout": "WITH " + _LAYOUT + " SELECT user_id, day, round(a, 4) AS start_s, round(b, 4) AS end_s, round(j, 4) AS joined_start_s FROM z",
    "ker12_to_original": _ORIGINAL_SQL,
    "agg15_mostly_music": _MUSIC_SQL,
    "str03_undo_plan": _UNDO_SQL,
}
