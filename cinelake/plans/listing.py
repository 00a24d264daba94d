"""Queries of the catalogue, text, cache, plan and log operators over the driver's tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import naming, subtitles
from cinelake.functions import text as T
from cinelake.operators import assignment, coverage, library, matching, renames, segments
from cinelake.sources import cache, probe
from cinelake.streaming import folds

from .tables import broadcast_if_small, table, written


def win05_aired_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes of their customer: those with a missing season or number are specials."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("show"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("season"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_orderkey") % 30).cast("int")).alias("number"),
        F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("airdate"),
    )
    return library.aired_numbering(rows, ["show"]).select("show", "id", "season", "number")


_AIRED_SQL = """
WITH e AS (SELECT o_custkey AS "show", o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS season, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 30 END AS number,
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS airdate FROM orders),
n AS (SELECT *, season IS NULL OR number IS NULL AS special, row_number() OVER (PARTITION BY "show", season IS NULL OR number IS NULL ORDER BY coalesce(airdate, '') = '', coalesce(airdate, ''), id) AS rn FROM e)
SELECT "show", id, CASE WHEN special THEN 0 ELSE season END::INTEGER AS season, CASE WHEN special THEN rn ELSE number END::INTEGER AS number FROM n
"""


def win08_group_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as named groups of a show."""
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Specials "), "p_size")).when(F.col("p_size") % 3 == 0, F.concat(F.lit("Season "), "p_size")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("order"), name.alias("name"))
    return library.group_numbering(rows, ["p_brand"]).select("p_brand", F.col("order").alias("position"), "season")


_GROUP_SQL = """
WITH g AS (SELECT p_brand, p_partkey AS position, CASE WHEN p_size % 5 = 0 THEN 'Specials ' || p_size WHEN p_size % 3 = 0 THEN 'Season ' || p_size ELSE p_name END AS name FROM part),
n AS (SELECT *, contains(lower(name), 'special') AS s, sum(CASE WHEN contains(lower(name), 'special') THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY position) AS place FROM g)
SELECT p_brand, position, CASE WHEN s THEN 0 ELSE coalesce(TRY_CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS INTEGER), place) END::INTEGER AS season FROM n
"""


def agg18_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("season"), (F.col("o_orderkey") % 30).alias("number"))
    return library.counts(rows, ["o_custkey"])


def joi12_reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes: texts from their labels' provider first, then by language, then whatever has a summary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").alias("summary"))
    labels = table(spark, sf_dir, "labels")
    first = labels.filter("quality = 1").select("doc_id", F.lit("subtitles").alias("kind"), F.lit("label").alias("text"))
    second = docs.filter("lang = 'en'").select("doc_id", F.lit("lyrics").alias("kind"), F.col("source").alias("text"))
    found = library.cascade(docs, [first.distinct(), second.distinct()], ["doc_id"])
    return library.with_summaries(docs.filter("n_chars > 500"), found, ["doc_id"]).select("doc_id", "kind", F.when(F.col("kind") == "summary", "").otherwise(F.col("text")).alias("text"))


_CASCADE_SQL = """
WITH a AS (SELECT DISTINCT doc_id, 'subtitles' AS kind, 'label' AS text FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)),
b AS (SELECT DISTINCT doc_id, 'lyrics' AS kind, source AS text FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a)),
t AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT * FROM t UNION ALL SELECT doc_id, 'summary', '' FROM documents WHERE n_chars > 500 AND trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM t)
"""


def top04_best_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' suppliers as packs that cover line numbers: the best for each order."""
    lines = table(spark, sf_dir, "lineitem")
    covers = lines.select(F.col("l_orderkey").alias("job"), F.col("l_suppkey").alias("pack"), F.col("l_linenumber").alias("episode"))
    packs = covers.select("job", "pack").distinct().select("job", "pack", F.when(F.col("pack") % 3 == 0, True).when(F.col("pack") % 3 == 1, False).alias("hi"), F.col("pack").alias("pos"), F.when(F.col("pack") % 11 == 0, "").otherwise("u").alias("url"))
    wanted = covers.filter("episode <= 5").select("job", "episode")
    return library.best_pack(packs, covers, wanted, ["job"]).select("job", "pack", "covered")


_PACK_SQL = """
WITH c AS (SELECT l_orderkey AS job, l_suppkey AS pack, count(DISTINCT l_linenumber) AS covered FROM lineitem WHERE l_linenumber <= 5 AND l_suppkey % 11 <> 0 GROUP BY ALL)
SELECT job, pack, covered FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY covered DESC, pack % 3 = 0, pack) AS n FROM c) WHERE n = 1
"""


def top03_best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lyrics records: per brand the one that fits its type as title best."""
    rows = table(spark, sf_dir, "part").select(
        "p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("track"), F.col("p_brand").alias("artist"), F.lit("").alias("album"),
        (F.col("p_size") % 13 == 0).alias("instrumental"), F.when(F.col("p_size") % 2 == 0, "words").alias("plain"), F.lit("[00:01] words").alias("synced"),
        F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("double")).alias("duration"), F.lit("Ring").alias("title"), F.lit("brand").alias("show"), F.lit(20.0).alias("runtime"),
    )
    return library.best_lyrics(rows, ["p_brand"], "title", "show", "runtime").select("p_brand", "id", "track")


_RECORD_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY replace(lower(p_name), ' ', '') <> 'ring', p_size % 2 <> 0, CASE WHEN p_size % 4 > 0 THEN abs(20.0 - p_size) ELSE 1e308 END, p_partkey) AS n
  FROM part WHERE p_size % 13 <> 0 AND contains(' ' || lower(p_name) || ' ', ' ring '))
SELECT p_brand, p_partkey AS id, p_name AS track FROM r WHERE n = 1
"""


def snk01_cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached responses: the latest of each user and type."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("fetched_at"), "event_id", "value")
    return cache.latest(rows, ["user_id", "event_type"], at="fetched_at", tie="event_id").select("user_id", "event_type", "event_id", "value")


def src16_cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh, stale or expired events as of the last one."""
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    now = rows.agg(F.max("at_ms").alias("now")).first()["now"]
    return rows.select("event_id", cache.freshness(F.lit(now) - F.col("at_ms"), 7, 20).alias("state"))


def snk02_cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), F.unix_millis(F.col("ts").cast("timestamp")).alias("fetched_at_ms"))
    now = rows.agg((F.max("fetched_at_ms") + 160 * cache.DAY_MS).alias("now")).first()["now"]
    return cache.purge(rows, "click", F.lit(now)).select("event_id", "provider")


def str01_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each kind of event by user, as a job's state."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", *(F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "view", "error")))
    return folds.fold_events(rows, ["user_id"], ["click", "view", "error"], "event_id").select("user_id", "click", F.col("view").alias("viewed"), "error", "event_id")


_FOLD_SQL = """
SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS viewed,
  arg_max(value, event_id) FILTER (event_type = 'error') AS error, max(event_id) AS event_id FROM events GROUP BY user_id
"""


def str02_journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as journal lines and replayed: each user's operations with their status."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 9 == 0, "begin").when(F.col("event_type") == "click", "intent").when(F.col("event_type") == "error", "failed").otherwise("done")
    record = F.struct(kind.alias("kind"), F.col("user_id").cast("string").alias("entry"), (F.col("event_id") % 5).cast("int").alias("op"), F.lit("move").alias("action"), F.concat(F.lit("/a/"), "event_id").alias("from"), F.concat(F.lit("/b/"), "event_id").alias("to"))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 50 == 7, F.lit("{torn")).otherwise(F.to_json(record)).alias("value"))
    return folds.operations(folds.read_journal(lines)).select("entry", "op", F.col("line_no").alias("intent_line"), "to", "status")


_JOURNAL_SQL = """
WITH r AS (SELECT event_id AS line_no, user_id::VARCHAR AS entry, (event_id % 5)::INTEGER AS op, '/b/' || event_id AS dest,
  CASE WHEN event_id % 9 = 0 THEN 'begin' WHEN event_type = 'click' THEN 'intent' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS kind FROM events WHERE event_id % 50 <> 7),
b AS (SELECT entry, min(line_no) AS begun FROM r WHERE kind = 'begin' GROUP BY entry),
t AS (SELECT r.* FROM r JOIN b USING (entry) WHERE line_no >= begun),
i AS (SELECT entry, op, min(line_no) AS intent_line, arg_min(dest, line_no) AS "to" FROM t WHERE kind = 'intent' GROUP BY ALL),
s AS (SELECT entry, op, arg_max(kind, line_no) AS status FROM t WHERE kind IN ('done', 'failed') GROUP BY ALL)
SELECT entry, op, intent_line, "to", coalesce(status, 'unknown') AS status FROM i LEFT JOIN s USING (entry, op)
"""


def pln02_plan_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand renamed to their name: whose targets coincide or are there."""
    parts = table(spark, sf_dir, "part")
    items = parts.select(F.col("p_brand").alias("job_id"), F.col("p_partkey").alias("file_id"), F.concat(F.lit("/in/"), "p_partkey").alias("from"), F.concat(F.lit("/out/"), F.initcap("p_name"), F.lit(" "), (F.col("p_size") % 4).cast("string")).alias("to"), F.col("p_size").alias("size_bytes"))
    disk = parts.select(F.col("p_brand").alias("job_id"), F.concat(F.lit("/in/"), "p_partkey").alias("path"), (F.col("p_size") + F.when(F.col("p_partkey") % 17 == 0, 1).otherwise(0)).alias("size_bytes")).unionByName(
        parts.filter("p_partkey % 5 = 0").select(F.col("p_brand").alias("job_id"), F.concat(F.lit("/OUT/"), F.upper("p_name"), F.lit(" 1")).alias("path"), F.lit(1).alias("size_bytes"))
    )
    found = renames.conflicts(items, disk, move=True)
    return found.select("job_id", "kind", F.lower("path").alias("path"), F.array_join(F.col("file_ids").cast("array<string>"), ",").alias("file_ids"))


_CONFLICT_SQL = """
WITH i AS (SELECT p_brand AS job_id, p_partkey AS file_id, '/in/' || p_partkey AS src, lower('/out/' || p_name || ' ' || (p_size % 4)) AS dest FROM part),
d AS (SELECT job_id, dest, count(*) AS n, string_agg(file_id::VARCHAR, ',' ORDER BY file_id) AS ids FROM i GROUP BY ALL),
x AS (SELECT DISTINCT p_brand AS job_id, lower('/out/' || p_name || ' 1') AS dest FROM part WHERE p_partkey % 5 = 0)
SELECT job_id, 'sourceChanged' AS kind, src AS path, file_id::VARCHAR AS file_ids FROM i WHERE file_id % 17 = 0
UNION ALL SELECT job_id, 'duplicateTarget', dest, ids FROM d WHERE n > 1
UNION ALL SELECT job_id, 'targetExists', dest, ids FROM d JOIN x USING (job_id, dest) WHERE n = 1
"""


def snk03_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of an exported list."""
    title = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("=SUM("), "o_orderkey")).otherwise(F.concat(F.lit("Order "), "o_orderkey"))
    outcome = F.when(F.col("o_orderstatus") == "F", "item").when(F.col("o_orderstatus") == "O", "extra").otherwise("playAll")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("file_id"), outcome.alias("outcome"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("number"), title.alias("title"), F.concat(F.lit("-"), "o_orderkey").alias("new_name"))
    return renames.csv_rows(rows)


_CSV_SQL = """
WITH r AS (SELECT o_custkey AS job_id, o_orderkey, o_orderstatus = 'F' AS item, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 6 = 0 THEN '''=SUM(' || o_orderkey ELSE 'Order ' || o_orderkey END AS t FROM orders)
SELECT job_id, o_orderkey::VARCHAR AS file, CASE WHEN item THEN 'episode' WHEN o_orderstatus = 'O' THEN 'extra' ELSE 'play-all' END AS status, CASE WHEN item THEN year(o_orderdate)::VARCHAR ELSE '' END AS season,
  CASE WHEN item THEN month(o_orderdate)::VARCHAR ELSE '' END AS episode, CASE WHEN item THEN t ELSE '' END AS title, CASE WHEN item THEN '''-' || o_orderkey ELSE '' END AS new_name FROM r
"""


def joi19_shared_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that chose the same part in an order's month."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("job_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("number"), F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("decision"))
    return renames.shared_episodes(rows).select("job_id", "file_id", F.size("others").cast("bigint").alias("n_others"), F.try_element_at("others", F.lit(1)).alias("first_other"))


_SHARED_SQL = """
WITH c AS (SELECT o_custkey % 50 AS job_id, year(o_orderdate) AS s, month(o_orderdate) AS m, o_orderkey AS f FROM orders WHERE o_orderstatus = 'F')
SELECT a.job_id, a.f AS file_id, count(b.f) AS n_others, min(b.f) AS first_other FROM c a LEFT JOIN c b ON a.job_id = b.job_id AND a.s = b.s AND a.m = b.m AND a.f <> b.f GROUP BY ALL
"""


def win01_repeat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as segments: what a recogniser would have invented, or said twice. Compression aside."""
    turns = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 7 == 3, "Thank you. Thank you!").when(F.col("turn") % 5 == 2, "[door slams]").when(F.col("turn") % 4 == 1, "So be it.").when(F.col("turn") % 4 == 2, "so, be it").otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", text.alias("text"), F.lit(0.1).alias("no_speech_prob"), F.lit(-0.2).alias("avg_logprob"), F.lit(None).cast("string").alias("filtered"))
    return segments.mark(rows, ["conv_id"], ["turn"], ratio=F.lit(1.0)).select("conv_id", "turn", "filtered")


_REPEAT_SQL = """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'Thank you. Thank you!' WHEN turn % 5 = 2 THEN '[door slams]' WHEN turn % 4 = 1 THEN 'So be it.' WHEN turn % 4 = 2 THEN 'so, be it' ELSE coalesce(text, '') END AS text FROM conversations),
n AS (SELECT *, trim(regexp_replace(lower(regexp_replace(text, '[''’]', '', 'g')), '[^\\pL\\pN]+', ' ', 'g')) AS norm FROM s),
p AS (SELECT *, last_value(nullif(norm, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM n)
SELECT conv_id, turn, CASE WHEN norm = 'thank you thank you' THEN 'knownHallucination' WHEN text = '[door slams]' THEN 'noSpeech' WHEN norm <> '' AND norm = prev THEN 'repeated' END AS filtered FROM p
"""


def agg17_matching_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns as one text."""
    rows = table(spark, sf_dir, "conversations").withColumn("filtered", F.when(F.col("role") != "user", "noSpeech"))
    return segments.matching_text(rows, ["conv_id"], ["turn"])


def sca26_compression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that compress too well to be speech."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", (segments.compression_ratio(F.trim("text")) > 2.4).alias("repetitive"))


def sca38_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


_STRIP_SQL = (
    "WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</*(p|br|div|li|ul|ol|h1|h2|h3)(?:[^a-z0-9>][^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages), "
    + "b AS (SELECT page_id, replace(" + "replace(" * len(T.ENTITIES) + "t" + "".join(f", '&{n};', '{c.replace(chr(39), chr(39) * 2)}')" for n, c in T.ENTITIES.items()) + ", '&amp;', '&') AS t FROM a) "
    "SELECT page_id, md5(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ([,.!?;:)])', '\\1', 'g')) AS text_md5 FROM b"
)


def sca16_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and squashed names, and whether a page's path names a part."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" & "), "p_type", F.lit("'s No."), "p_size").alias("name"))
    return rows.select("p_partkey", T.normalize_name(F.col("name")).alias("normal"), T.squash(F.col("name")).alias("squashed"), T.contains_words(F.col("name"), F.lit("Ring")).alias("has_ring"), T.refers_to(F.col("name"), F.lit("wid get")).alias("of_widget"))


_NAMES_SQL = """
WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(replace(replace(p_name || ' & ' || p_type || '''s No.' || p_size, '&', ' and '), '''', '')), '[^\\pL\\pN]+', ' ', 'g')) AS normal FROM part)
SELECT p_partkey, normal, replace(normal, ' ', '') AS squashed, contains(' ' || normal || ' ', ' ring ') AS has_ring, contains(replace(normal, ' ', ''), 'widget') AS of_widget FROM n
"""


def sca20_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season and episode told by file names of every form."""
    k = F.col("l_linenumber")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("Show.S"), F.lpad(k.cast("string"), 2, "0"), F.lit("E"), F.floor("l_quantity").cast("int"), F.lit(".mkv")))
        .when(k % 5 == 1, F.concat(F.lit("show "), k, F.lit("x"), F.lpad(F.floor("l_quantity").cast("int").cast("string"), 2, "0")))
        .when(k % 5 == 2, F.concat(F.lit("Season "), k, F.lit(" - Episode "), F.floor("l_quantity").cast("int")))
        .when(k % 5 == 3, F.concat(F.lit("clips"), k, F.lit("e1 s4 e"), F.floor("l_quantity").cast("int")))
        .otherwise(F.lit("VTS_01_1.VOB"))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.episode_marker(name).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "m.season", "m.episode")


_MARKER_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 3 THEN 4 WHEN 4 THEN NULL ELSE l_linenumber END::INTEGER AS season, CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE floor(l_quantity) END::INTEGER AS episode FROM lineitem
"""


def sca50_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and episode codes as text."""
    s = F.col("l_extendedprice") / 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.clock(s).alias("clock"), T.episode_code(F.col("l_linenumber"), F.floor("l_quantity").cast("int")).alias("code"))


_FORMATS_SQL = """
WITH s AS (SELECT *, floor(l_extendedprice / 7 + 0.5)::BIGINT AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, printf('S%02dE%02d', l_linenumber, floor(l_quantity)::INTEGER) AS code FROM s
"""


def fil01_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files with probe JSON: duration, streams, role and warning."""
    o = table(spark, sf_dir, "orders")
    audio = F.when(F.col("o_orderkey") % 6 > 0, F.array(F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.create_map(F.lit("default"), F.lit(1)).alias("disposition"), F.create_map(F.lit("LANGUAGE"), F.lit("eng")).alias("tags")))).otherwise(F.array().cast("array<struct<index:int,codec_type:string,codec_name:string,disposition:map<string,int>,tags:map<string,string>>>"))
    length = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise((F.col("o_totalprice") / 1000).cast("decimal(12,3)").cast("string"))
    raw = F.to_json(F.struct(F.struct(F.lit("matroska").alias("format_name"), length.alias("duration")).alias("format"), audio.alias("streams"), F.array(F.struct(F.lit("0").alias("start_time"), F.lit("15.5").alias("end_time"))).alias("chapters")))
    rows = o.select("o_orderkey", probe.parse(raw).alias("p"))
    kind, warning = probe.role(F.lit(False), F.col("p"))
    return rows.select("o_orderkey", F.round("p.duration_s", 3).alias("duration_s"), F.size("p.audio_streams").cast("bigint").alias("n_audio"), kind.alias("role"), warning.alias("warning"))


_ROLES_SQL = """
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 15.5 ELSE round((o_totalprice / 1000)::DECIMAL(12, 3)::DOUBLE, 3) END::DOUBLE AS d, (o_orderkey % 6 > 0)::BIGINT AS n FROM orders)
SELECT o_orderkey, d AS duration_s, n AS n_audio, CASE WHEN n = 0 OR d < 20 THEN 'ignored' ELSE 'candidate' END AS role, CASE WHEN n = 0 THEN 'noAudio' END AS warning FROM f
"""


def agg14_musical(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("show"), F.lit(1).alias("season"), F.col("l_linenumber").alias("number"), F.when(F.col("l_returnflag") == "N", "lyrics").otherwise("subtitles").alias("kind"))
    return library.musical(lines, lines, ["show"])


_MUSICAL_SQL = """
WITH c AS (SELECT l_orderkey AS "show", count(DISTINCT l_linenumber) AS n, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS k FROM lineitem GROUP BY 1)
SELECT "show", k > 0 AND 2 * k >= n AS is_musical FROM c
"""


def top09_scaled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("score"))
    return library.scaled_candidates(rows, ["s_nationkey"]).select("s_nationkey", "s_suppkey", F.round("score", 6).alias("score"))


def sca01_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and code counts of the full tokenizer, numbers spelt out, over benchmark items and conversation turns."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("turn "), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    return coverage.tokens(items.unionByName(turns), ["id"]).groupBy("id").agg(F.count("*").alias("n_words"), F.countDistinct("code").alias("n_codes"))


def joi03_phrase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each benchmark item is heard, phrase by phrase, in the documents whose words come nearest."""
    from .matching import tfidf_cosine_topk

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    near = written(tfidf_cosine_topk(spark, sf_dir).select("item_id", "doc_id"), "near")
    wanted = broadcast_if_small(near.select("doc_id").distinct(), 16)
    heard = written(coverage.tokens(items, ["item_id"]), "heard")
    frequency = heard.select("item_id", F.col("word").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    phrases = coverage.phrases(heard, frequency, F.lit(items.count()), ["item_id"])
    told = written(coverage.tokens(docs.join(wanted, "doc_id", "left_semi"), ["doc_id"]), "told")
    found = coverage.phrase_coverage(heard, told, written(phrases, "phrases"), "item_id", "doc_id", pairs=near)
    return found.select("item_id", "doc_id", F.round("coverage", 6).alias("coverage"))


def joi04_title_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's opening words as a title, heard in every conversation turn: the turn that sounds most like it."""
    items, turns = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    title = F.struct("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("title"))
    # the items are a stated set, and meet all turns in blocks
    blocks = items.groupBy(F.floor(F.col("item_id") / 256).alias("block")).agg(F.sort_array(F.collect_list(title)).alias("items"))
    heard = turns.select("conv_id", "turn", "text").crossJoin(broadcast_if_small(written(blocks, "blocks"), 16384))
    told = heard.select("conv_id", "turn", "items", matching.title_hooks(F.transform("items", lambda x: x["title"]), F.col("text")).alias("scores"))
    rows = told.select("conv_id", "turn", F.explode(F.arrays_zip(F.transform("items", lambda x: x["item_id"]).alias("item_id"), F.col("scores").alias("score"))).alias("x")).select("conv_id", "turn", "x.item_id", "x.score")
    best = rows.filter("score is not null").groupBy("item_id").agg(F.max_by(F.struct("conv_id", "turn"), F.struct(F.round("score", 6), -F.col("conv_id"), -F.col("turn"))).alias("at"), F.max(F.round("score", 6)).alias("score"))
    return best.select("item_id", "at.conv_id", "at.turn", "score")


def ker04_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as files, their numbers as episodes: a global assignment by job."""
    # dealt by order at once: the grouping, both sides of the join and the assignment keep that layout
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    files = lines.select("l_orderkey", F.col("l_linenumber").alias("file"), "q", "d")
    episodes = lines.select("l_orderkey", F.col("l_linenumber").alias("episode"), F.col("q").alias("eq"))
    score = F.greatest(F.lit(0.0), 1 - F.abs(F.col("q") - F.col("eq")) / 25 - F.abs(F.col("file") - F.col("episode")) / 40)
    rows = files.join(episodes, "l_orderkey").select("l_orderkey", "file", "episode", score.alias("content"), score.alias("final"), (F.col("d") > 0.01).alias("heard"), F.when(F.col("d") > 0.05, F.col("file")).alias("rank"), (F.col("episode") % 6 == 0).alias("special"))
    return assignment.assign(rows, "l_orderkey", "file", "episode")


def sca43_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered paths of orders as episodes. The template and names go through the naming kernel in Arrow batches."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_orderpriority", "o_custkey")

    def run(batches):
        for b in batches:
            b["path"] = [naming.render("jellyfinPlex", f"Show: {c}", int(y) if y % 2 else None, int(y) % 20, int(m), p, "mkv") for c, y, m, p in zip(b.o_custkey, b.y, b.m, b.o_orderpriority, strict=True)]
            yield b[["o_orderkey", "path"]]

    return rows.mapInPandas(run, "o_orderkey bigint, path string")


_PATHS_SQL = """
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, 'Show - ' || o_custkey AS s, o_orderpriority AS p FROM orders),
n AS (SELECT *, s || CASE WHEN y % 2 = 1 THEN ' (' || y || ')' ELSE '' END AS sy FROM o)
SELECT o_orderkey, sy || '/Season ' || printf('%02d', y % 20) || '/' || sy || ' - S' || printf('%02d', y % 20) || 'E' || printf('%02d', m) || ' - ' || p || '.mkv' AS path FROM n
"""


def sca31_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as subtitles, then read back as dialogue."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2.0 + 1).alias("end_s"), F.regexp_replace("text", r"\s+", " ").alias("text"), F.lit(None).cast("string").alias("filtered"))
    return segments.heard_srt(turns, ["conv_id"]).select("conv_id", F.md5(subtitles.dialogue_udf(F.col("srt"))).alias("dialogue_md5"))


QUERIES = {f.__name__: f for f in (
    win05_aired_numbering, win08_group_numbering, agg18_counts, joi12_reference_cascade, top04_best_pack, top03_best_record, snk01_cache_latest, src16_cache_freshness, snk02_cache_purge,
    str01_event_fold, str02_journal_replay, pln02_plan_conflicts, snk03_csv_rows, joi19_shared_episodes, win01_repeat_filter, agg17_matching_text,
    sca26_compression_filter, sca38_strip_html, sca16_name_keys, sca20_markers, sca50_formats, fil01_roles, agg14_musical, top09_scaled_candidates, sca01_tokenize, joi03_phrase_coverage,
    joi04_title_hook, ker04_assignment, sca43_paths, sca31_dialogue,
)}
ORACLE_SQL = {
    "win05_aired_numbering": _AIRED_SQL,
    "win08_group_numbering": _GROUP_SQL,
    "agg18_counts": "SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END) AS seasons, count(*) FILTER (o_orderstatus <> 'P') AS episodes FROM orders GROUP BY o_custkey",
    "joi12_reference_cascade": _CASCADE_SQL,
    "top04_best_pack": _PACK_SQL,
    "top03_best_record": _RECORD_SQL,
    "snk01_cache_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "src16_cache_freshness": "WITH e AS (SELECT event_id, epoch_ms(ts) AS t, max(epoch_ms(ts)) OVER () AS now FROM events) SELECT event_id, CASE WHEN now - t <= 7 * 86400000::BIGINT THEN 'fresh' WHEN now - t <= 20 * 86400000::BIGINT THEN 'stale' ELSE 'expired' END AS state FROM e",
    "snk02_cache_purge": "WITH e AS (SELECT event_id, event_type AS provider, epoch_ms(ts) AS t, max(epoch_ms(ts)) OVER () + 160 * 86400000::BIGINT AS now FROM events) SELECT event_id, provider FROM e WHERE NOT (provider = 'click' AND now - t > 183 * 86400000::BIGINT)",
    "str01_event_fold": _FOLD_SQL,
    "str02_journal_replay": _JOURNAL_SQL,
    "pln02_plan_conflicts": _CONFLICT_SQL,
    "snk03_csv_rows": _CSV_SQL,
    "joi19_shared_episodes": _SHARED_SQL,
    "win01_repeat_filter": _REPEAT_SQL,
    "agg17_matching_text": "SELECT conv_id, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND trim(text, ' ') <> '' GROUP BY conv_id",
    "sca38_strip_html": _STRIP_SQL,
    "sca16_name_keys": _NAMES_SQL,
    "sca20_markers": _MARKER_SQL,
    "sca50_formats": _FORMATS_SQL,
    "fil01_roles": _ROLES_SQL,
    "agg14_musical": _MUSICAL_SQL,
    "top09_scaled_candidates": "SELECT s_nationkey, s_suppkey, round(CASE WHEN m > 0 THEN greatest(0.0, least(1.0, s_acctbal / m)) ELSE 0 END, 6) AS score FROM (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier)",
    "sca43_paths": _PATHS_SQL,
}
