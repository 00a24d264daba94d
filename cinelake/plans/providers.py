"""Queries of the probe, provider, library, subtitle and plan operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.functions import subtitles
from cinelake.functions import text as T
from cinelake.operators import evidence, library, renames, segments
from cinelake.sources import archives, cache, probe, providers
from cinelake.streaming import folds

from .tables import table


def _json(rows: DataFrame, keys: list[str], item: F.Column, order: str, wrap: str | None = None) -> DataFrame:
    """`keys` and body: a provider's response that lists an item for each row of a key, in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("_i")))), lambda x: x["_i"])
    return rows.groupBy(*keys).agg(F.to_json(F.struct(listed.alias(wrap)) if wrap else listed).alias("body"))


# --- probes


def fil05_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as streams: the audio to listen to, and the embedded subtitles to use."""
    language = F.element_at(F.array(F.lit("eng"), F.lit("fre"), F.lit(None).cast("string"), F.lit("en"), F.lit("ger")), (F.col("l_partkey") % 5 + 1).cast("int"))
    codec = F.element_at(F.array(F.lit("subrip"), F.lit("hdmv_pgs"), F.lit("ass"), F.lit("dvd_subtitle")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"), F.max("l_returnflag").alias("rf"))
    one = F.struct(F.col("l_linenumber").alias("index"), codec.alias("codec"), language.alias("language"), (F.col("rf") == "R").alias("default"))
    held = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("streams"))
    return held.select("l_orderkey", probe.choose_audio(F.col("streams"), F.lit("en")).alias("audio"), probe.embedded_choice(F.col("streams"), F.lit("EN")).alias("subtitles"))


_STREAMS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber AS i, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_returnflag) AS rf FROM lineitem GROUP BY ALL)
SELECT l_orderkey, arg_min(i, (CASE WHEN p % 5 IN (0, 3) THEN 0 ELSE 1 END) * 1000 + (CASE WHEN rf = 'R' THEN 0 ELSE 1 END) * 100 + i)::INTEGER AS audio, min(i) FILTER (s % 2 = 0 AND p % 5 IN (0, 2, 3))::INTEGER AS subtitles FROM l GROUP BY l_orderkey
"""


def src06_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as probed files whose length is told by the container, a stream, a stream's tag or the chapters only; cover art, blank languages, chapters out of order."""
    k = F.col("o_orderkey")
    seconds = F.floor(F.col("o_totalprice") / 100).cast("bigint").cast("string")
    none = F.lit(None).cast("string")
    clock = F.concat(F.floor(F.col("o_totalprice") / 360000).cast("bigint").cast("string"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lit(":30.5"))
    tags = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    disposition = lambda name, on: F.create_map(F.lit(name), on.cast("bigint"))
    kinds = "struct<`index`:int,codec_type:string,codec_name:string,width:int,height:int,duration:string,disposition:map<string,bigint>,tags:map<string,string>>"
    video = F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.lit("mjpeg").alias("codec_name"), F.lit(640).alias("width"), F.lit(480).alias("height"), none.alias("duration"), disposition("attached_pic", k % 2 == 0).alias("disposition"), tags("title", "x").alias("tags"))
    film = F.struct(F.lit(1), F.lit("video"), F.lit("h264"), F.when(k % 9 > 0, 1280).otherwise(0), F.lit(720), F.when(k % 4 == 1, seconds), disposition("default", k > 0), F.when(k % 4 == 2, tags("DURATION", clock)).otherwise(tags("handler", "y"))).cast(kinds)
    sound = F.struct(F.lit(2), F.lit("audio"), F.lit("aac"), F.lit(None).cast("int"), F.lit(None).cast("int"), none, disposition("default", k % 3 == 0), tags("LANGUAGE", F.element_at(F.array(F.lit("eng"), F.lit("und"), F.lit(" ")), (k % 3 + 1).cast("int")))).cast(kinds)
    chapter = lambda i, start: F.struct(start.cast("string").alias("start_time"), (start + 50).cast("string").alias("end_time"), tags("title", F.lit(f"c{i}") if i else F.lit("  ")).alias("tags"))
    chapters = F.when(k % 8 < 4, F.array(chapter(1, F.lit(100.0)), chapter(0, F.lit(50.0)), chapter(2, k % 100 + 0.5))).otherwise(F.array().cast("array<struct<start_time:string,end_time:string,tags:map<string,string>>>"))
    raw = F.to_json(F.struct(F.struct(F.lit("matroska").alias("format_name"), F.when(k % 4 == 0, seconds).otherwise("N/A").alias("duration")).alias("format"), F.array(video.cast(kinds), film, sound).alias("streams"), chapters.alias("chapters")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", probe.parse(raw).alias("p"))
    return rows.select("o_orderkey", F.round("p.duration_s", 2).alias("duration_s"), F.col("p.video.width").alias("width"), F.element_at("p.audio_streams", 1)["language"].alias("language"), F.element_at("p.audio_streams", 1)["default"].alias("is_default"), F.array_join(F.transform("p.chapters", lambda c: F.concat_ws(":", c["index"], c["start_s"], F.coalesce(c["title"], F.lit("-")))), " ").alias("chapters"))


_PROBES_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey AS k, floor(o_totalprice / 100)::DOUBLE AS s, floor(o_totalprice / 360000) * 3600 + o_custkey % 60 * 60 + 30.5 AS t, o_orderkey % 100 + 0.5 AS c FROM orders),
h AS (SELECT o_orderkey, list_sort([[100.0::DOUBLE, 1], [50.0::DOUBLE, 0], [c::DOUBLE, 2]]) AS cs FROM o WHERE k % 8 < 4)
SELECT o_orderkey, CASE WHEN k % 4 < 2 AND s > 0 THEN s WHEN k % 4 = 2 THEN round(t, 2) WHEN k % 8 < 4 THEN round(greatest(150.0, c + 50), 2) END::DOUBLE AS duration_s, CASE WHEN k % 2 = 1 THEN 640 WHEN k % 9 > 0 THEN 1280 END::INTEGER AS width,
  CASE WHEN k % 3 = 0 THEN 'eng' END AS language, k % 3 = 0 AS is_default,
  coalesce(array_to_string(list_transform(range(3), lambda i: i || ':' || cs[i + 1][1]::DOUBLE || ':' || CASE cs[i + 1][2]::INTEGER WHEN 0 THEN '-' ELSE 'c' || cs[i + 1][2]::INTEGER END), ' '), '') AS chapters FROM o LEFT JOIN h USING (o_orderkey)
"""


def src02_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files below a folder: those listed, and what structure a folder is."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("a{k}.mkv", ".hidden{k}.mkv", "s/VIDEO_TS/v{k}.vob", "sub{b}/c{k}.MP4", "d{b}/video_ts.ifo", "sub/.x/e{k}.avi", "note{k}.txt", "r{b}/BDMV/index.bdmv", "q{b}/Index.BDMV", "f{k}.TS")]), (F.col("p_partkey") % 10 + 1).cast("int"))
    path = F.replace(F.replace(form, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{b}"), (F.col("p_partkey") % 70).cast("string"))
    files = table(spark, sf_dir, "part").select(path.alias("path"))
    flat, deep = (probe.listed(files, r).select("path", F.lit(k).alias("kind")) for r, k in ((False, "flat"), (True, "deep")))
    return flat.unionByName(deep).unionByName(probe.disc_folders(files).select(F.col("folder").alias("path"), F.col("format").alias("kind")))


_LISTING_SQL = """
WITH p AS (SELECT p_partkey % 10 AS f, p_partkey AS k, p_partkey % 70 AS b FROM part)
SELECT CASE f WHEN 0 THEN 'a' || k || '.mkv' ELSE 'f' || k || '.TS' END AS path, 'flat' AS kind FROM p WHERE f IN (0, 9)
UNION ALL SELECT CASE f WHEN 0 THEN 'a' || k || '.mkv' WHEN 3 THEN 'sub' || b || '/c' || k || '.MP4' ELSE 'f' || k || '.TS' END, 'deep' FROM p WHERE f IN (0, 3, 9)
UNION ALL SELECT DISTINCT CASE f WHEN 2 THEN 's/VIDEO_TS' WHEN 4 THEN 'd' || b WHEN 7 THEN 'r' || b || '/BDMV' ELSE 'q' || b END, CASE WHEN f IN (2, 4) THEN 'dvd' ELSE 'bluRay' END FROM p WHERE f IN (2, 4, 7, 8)
"""

# --- providers


def src12_found_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as one provider's search result, by score, and as another's, by place."""
    rows = table(spark, sf_dir, "supplier")
    show = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat((F.col("s_suppkey") % 60 + 1960).cast("string"), F.lit("-05-01")).alias("premiered"))
    a = providers.search_a(_json(rows, ["s_nationkey"], F.struct(F.abs("s_acctbal").alias("score"), show.alias("show")), "s_suppkey"), ["s_nationkey"])
    hit = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.concat((F.col("s_suppkey") % 60 + 1960).cast("string"), F.lit("-05-01"))).otherwise("").alias("first_air_date"))
    b = providers.search_b(_json(rows, ["s_nationkey"], hit, "s_suppkey", "results"), ["s_nationkey"])
    both = a.withColumn("via", F.lit("a")).unionByName(b.withColumn("via", F.lit("b")))
    return library.flag_guess(both, F.col("name"), F.upper(F.concat(F.lit(" "), F.when(F.col("s_nationkey") % 2 == 0, F.col("name"))))).select("s_nationkey", "via", "id", "year", F.round("score", 6).alias("score"), "from_folder")


_SHOWS_SQL = """
WITH s AS (SELECT *, s_suppkey % 60 + 1960 AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n, max(abs(s_acctbal)) OVER (PARTITION BY s_nationkey) AS top FROM supplier)
SELECT s_nationkey, 'a' AS via, s_suppkey AS id, y::INTEGER AS year, round(CASE WHEN top > 0 THEN abs(s_acctbal) / top ELSE 0 END, 6) AS score, s_nationkey % 2 = 0 AS from_folder FROM s
UNION ALL SELECT s_nationkey, 'b', s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN y END::INTEGER, round(1 - i / n, 6), s_nationkey % 2 = 0 FROM s
"""


def src12_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a provider's episode list: specials numbered, runtimes in seconds, summaries without markup."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    item = F.struct(
        k.alias("id"), F.concat(F.lit("Part "), k).alias("name"), F.when(k % 6 > 0, F.year("o_orderdate")).alias("season"), F.when(k % 5 > 0, k % 30).cast("int").alias("number"), F.when(k % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("airdate"),
        F.when(k % 3 > 0, F.col("o_totalprice") / 1000).alias("runtime"), F.when(k % 2 == 0, F.concat(F.lit("<p>It is "), F.lower("o_orderpriority"), F.lit(" &amp; <b>done</b>.</p>"))).otherwise("<p> </p>").alias("summary"),
    )
    made = providers.episodes_a(_json(o, ["o_custkey"], item, "o_orderkey"), ["o_custkey"])
    return made.select("o_custkey", "id", "season", "number", F.round("runtime_s", 4).alias("runtime_s"), "summary")


_EPISODES_SQL = """
WITH e AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN year(o_orderdate) END AS s, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 30 END AS n, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS a FROM orders),
r AS (SELECT *, s IS NULL OR n IS NULL AS special, row_number() OVER (PARTITION BY o_custkey, s IS NULL OR n IS NULL ORDER BY a IS NULL, a, k) AS i FROM e)
SELECT o_custkey, k AS id, CASE WHEN special THEN 0 ELSE s END::INTEGER AS season, CASE WHEN special THEN i ELSE n END::INTEGER AS number, CASE WHEN k % 3 > 0 THEN round(o_totalprice / 1000 * 60, 4) END AS runtime_s, CASE WHEN k % 2 = 0 THEN 'It is ' || lower(o_orderpriority) || ' & done.' END AS summary FROM r
"""


def joi14_dvd_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in another order, with their originals embedded; then each with the number it was aired under."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kinds = "struct<id:bigint,name:string,season:int,number:int,airdate:string,runtime:double,summary:string>"
    original = F.struct(k.alias("id"), F.concat(F.lit("Part "), k).alias("name"), F.year("o_orderdate").alias("season"), (k % 30).cast("int").alias("number"), F.lit("").alias("airdate"), F.lit(40.0).alias("runtime"), F.lit("").alias("summary")).cast(kinds)
    item = F.struct(F.when(k % 3 == 0, F.concat(F.lit("Disc "), k)).when(k % 3 == 1, " ").alias("name"), F.when(k % 7 > 0, 1).alias("season"), (k % 50).cast("int").alias("number"), F.when(k % 2 == 0, 41.5).alias("runtime"), F.struct(F.when(k % 11 > 0, F.array(original)).otherwise(F.array().cast(f"array<{kinds}>")).alias("episodes")).alias("_embedded"))
    dvd = providers.dvd_a(_json(o, ["o_custkey"], item, "o_orderkey"), ["o_custkey"])
    aired = o.filter("o_orderstatus != 'F'").select("o_custkey", k.alias("id"), F.year("o_orderdate").alias("season"), (k % 30).cast("int").alias("number"))
    return library.aired_keys(dvd, aired, ["o_custkey"]).select("o_custkey", "id", "title", "runtime", "season", "number", "aired_season", "aired_number")


_DVD_SQL = """
SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Disc ' || o_orderkey ELSE 'Part ' || o_orderkey END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 41.5 ELSE 40.0 END::DOUBLE AS runtime, 1::INTEGER AS season, (o_orderkey % 50)::INTEGER AS number,
  CASE WHEN o_orderstatus <> 'F' THEN year(o_orderdate) ELSE 1 END::INTEGER AS aired_season, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 30 ELSE o_orderkey % 50 END::INTEGER AS aired_number FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 11 > 0
"""


def src13_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as another provider's seasons, and its named groups with their members numbered."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    item = F.struct(k.alias("id"), F.concat(F.lit("Part "), k).alias("name"), F.year("o_orderdate").alias("season_number"), (k % 30).cast("int").alias("episode_number"), F.lit("2000-01-01").alias("air_date"), F.when(k % 2 == 0, " ").otherwise("told").alias("overview"), F.when(k % 3 > 0, F.lit(22.5)).alias("runtime"))
    seasons = providers.season_b(_json(o, ["o_custkey"], item, "o_orderkey", "episodes"), ["o_custkey"]).select("o_custkey", "id", "season", "number", "runtime_s", "summary")
    own = F.struct(k.alias("id"), F.concat(F.lit("Part "), k).alias("name"), (-k).cast("int").alias("order"))
    eps = o.groupBy("o_custkey", "o_orderpriority").agg(F.sort_array(F.collect_list(own)).alias("eps"))
    name = F.when(F.col("o_orderpriority").startswith("1"), "The Specials").when(F.col("o_orderpriority").startswith("2"), "Season 7").otherwise(F.col("o_orderpriority").substr(3, 20))
    group = F.struct(name.alias("name"), F.col("o_orderpriority").substr(1, 1).cast("int").alias("order"), F.col("eps").alias("episodes"))
    groups = providers.groups_b(_json(eps, ["o_custkey"], group, "o_orderpriority", "groups"), ["o_custkey"]).select("o_custkey", "id", "season", "number", F.lit(None).cast("double").alias("runtime_s"), F.lit("group").alias("summary"))
    return seasons.unionByName(groups)


_SEASONS_SQL = """
WITH g AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders), n AS (SELECT *, sum(CASE WHEN p[1] = '1' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY p) AS place FROM g)
SELECT o_custkey, o_orderkey AS id, year(o_orderdate)::INTEGER AS season, (o_orderkey % 30)::INTEGER AS number, CASE WHEN o_orderkey % 3 > 0 THEN 1350.0 END::DOUBLE AS runtime_s, CASE WHEN o_orderkey % 2 = 1 THEN 'told' END AS summary FROM orders
UNION ALL SELECT o.o_custkey, o_orderkey, CASE p[1] WHEN '1' THEN 0 WHEN '2' THEN 7 ELSE place END::INTEGER, (row_number() OVER (PARTITION BY o.o_custkey, p ORDER BY o_orderkey DESC))::INTEGER, NULL, 'group' FROM orders o JOIN n ON n.o_custkey = o.o_custkey AND p = o_orderpriority
"""


def joi20_find_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers found by one id, another id or the only search result, in that order."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).alias("show"), F.col("c_custkey").alias("id"), F.element_at(F.array(F.lit("search"), F.lit("search"), F.lit("imdb"), F.lit("search"), F.lit("thetvdb")), (F.abs(F.floor(F.col("c_acctbal")).cast("bigint")) % 5 + 1).cast("int")).alias("how"))
    one = c.withColumn("_n", F.row_number().over(Window.partitionBy("show", F.col("how") == "search", "how").orderBy("id"))).filter("how = 'search' or _n = 1").drop("_n")
    return providers.find_show(one, ["show"])


_FIND_SQL = """
WITH c AS (SELECT c_custkey % 400 AS "show", c_custkey AS id, ['search', 'search', 'imdb', 'search', 'thetvdb'][abs(floor(c_acctbal)::BIGINT) % 5 + 1] AS how FROM customer),
n AS (SELECT *, count(*) FILTER (how = 'search') OVER (PARTITION BY "show") AS searches FROM c)
SELECT "show", coalesce(min(id) FILTER (how = 'thetvdb'), min(id) FILTER (how = 'imdb'), min(id) FILTER (how = 'search')) AS id, CASE WHEN bool_or(how = 'thetvdb') THEN 'thetvdb' WHEN bool_or(how = 'imdb') THEN 'imdb' ELSE 'search' END AS how
FROM n WHERE how <> 'search' OR searches = 1 GROUP BY "show"
"""


def src14_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as listed subtitles: packs, and the episodes each covers; numbers as texts."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    n, p = F.col("l_linenumber"), F.col("p")
    file = lambda i: F.struct(F.concat(F.lit("x"), n).alias("name"), F.when(p % 2 == 0, "1").alias("season"), (n + i).cast("string").alias("episode"), F.lit(False).alias("hi"), F.lit("srt").alias("format"), F.lit("u").alias("url"))
    item = F.struct(
        F.concat(F.lit("u"), n).alias("url"), F.lit("r").alias("release_name"), F.when(p % 9 > 0, "1").otherwise("2").alias("season"), F.when(p % 5 > 0, F.concat(F.lit(" "), n)).otherwise("x").alias("episode"), F.when(p % 4 == 1, n.cast("string")).alias("episode_from"),
        F.when(p % 4 == 1, (n + F.col("q").cast("int") % 4).cast("string")).alias("episode_end"), (p % 6 == 0).alias("full_season"), (p % 3 == 0).alias("hi"), F.when(p % 4 == 0, F.array(file(0), file(1))).when(p % 4 == 2, F.array(file(2))).alias("unpack_files"),
    )
    listed = providers.packs(_json(rows, ["l_orderkey"], item, "l_linenumber", "subtitles"), ["l_orderkey"])
    covers = library.pack_covers(F.col("files"), F.col("season"), F.col("episode_from"), F.col("episode_end"), F.col("episode"), F.lit(1))
    return listed.select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), "url", "hi", "is_pack", "episode", F.array_join(covers, ",").alias("covers"))


_PACKS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS p, max(l_quantity)::INTEGER % 4 AS more, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, pos, 'u' || n AS url, p % 3 = 0 AS hi, p % 6 = 0 OR p % 4 = 0 AS is_pack, CASE WHEN p % 5 > 0 THEN n END::INTEGER AS episode,
  CASE p % 4 WHEN 0 THEN n || ',' || (n + 1) WHEN 2 THEN (n + 2)::VARCHAR WHEN 1 THEN CASE WHEN p % 9 = 0 THEN '' ELSE array_to_string(range(n, n + more + 1), ',') END ELSE CASE WHEN p % 9 = 0 OR p % 5 = 0 THEN '' ELSE n::VARCHAR END END AS covers FROM l
"""


def top05_season_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as packs and its parts as single subtitles: what serves each of its first six lines."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job")
    covers = rows.filter("l_partkey % 2 = 0").select("job", F.col("l_suppkey").alias("pack"), F.col("l_linenumber").alias("episode"))
    packs = covers.select("job", "pack").distinct().select("job", "pack", (F.col("pack") % 3 == 0).alias("hi"), F.col("pack").alias("pos"), F.when(F.col("pack") % 7 == 0, "").otherwise(F.concat(F.lit("p"), "pack")).alias("url"))
    singles = rows.filter("l_quantity > 10").select("job", F.col("l_linenumber").alias("episode"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 4 == 1).alias("hi"), F.col("l_partkey").alias("pos"), F.concat(F.lit("s"), "l_partkey").alias("url"))
    wanted = rows.filter("l_linenumber <= 6").select("job", F.col("l_linenumber").alias("episode"))
    return library.season_texts(packs, covers, singles, wanted, ["job"])


_SERVED_SQL = """
WITH l AS (SELECT l_orderkey AS job, l_linenumber AS episode, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem),
c AS (SELECT DISTINCT job, s, episode FROM l WHERE p % 2 = 0 AND s % 7 > 0 AND episode <= 6), n AS (SELECT job, s, count(*) AS k FROM c GROUP BY ALL),
b AS (SELECT job, s FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY k DESC, s % 3 = 0, s) AS r FROM n) WHERE r = 1),
v AS (SELECT c.job, c.episode, 'p' || c.s AS url, 'pack' AS via FROM c JOIN b ON b.job = c.job AND b.s = c.s),
x AS (SELECT *, row_number() OVER (PARTITION BY job, episode ORDER BY p % 4 = 1, p) AS r FROM l WHERE q > 10 AND episode <= 6 AND NOT EXISTS (SELECT 1 FROM v WHERE v.job = l.job AND v.episode = l.episode))
SELECT * FROM v UNION ALL SELECT job, episode, 's' || p, 'single' FROM x WHERE r = 1
"""


def src15_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a provider's lyrics records: those short enough, and what they sing."""
    item = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("trackName"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("artistName"), F.lit(None).cast("string").alias("albumName"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 15.0).alias("duration"),
        F.when(F.col("p_size") % 7 == 0, True).alias("instrumental"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("plainLyrics"), F.concat(F.lit("[00:01.00] "), "p_name").alias("syncedLyrics"),
    )
    found = providers.lyrics(_json(table(spark, sf_dir, "part"), ["p_brand"], item, "p_partkey"), ["p_brand"])
    text = F.coalesce(F.nullif("plain", F.lit("")), subtitles.column_udf(subtitles.lrc_to_lyrics)(F.col("synced")))
    return found.select("p_brand", "id", "artist", "duration", "instrumental", text.alias("text"))


_LYRICS_SQL = "SELECT p_brand, p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS artist, CASE WHEN p_size % 5 > 0 THEN p_size * 15.0 END::DOUBLE AS duration, p_size % 7 = 0 AS instrumental, CASE WHEN p_size % 3 = 0 AND p_type <> '' THEN p_type ELSE p_name END AS text FROM part WHERE p_size % 5 = 0 OR p_size * 15 <= 600"


def msc05_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a provider stands after the last event, and whether its credit is due."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("kind"))
    outcome = F.when(F.col("last") % 3 == 0, "unauthorized").when(F.col("kind") == "error", "network").when(F.col("kind") == "click", "rateLimited").when(F.col("last") % 5 == 0, "ok")
    return rows.select("user_id", cache.source_status(F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0, outcome).alias("status"))


_STATUS_SQL = "WITH e AS (SELECT user_id, max(event_id) AS l, arg_max(event_type, event_id) AS k FROM events GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 2 = 0 AND user_id % 3 > 0 THEN 'needsKey' WHEN l % 3 = 0 THEN 'rejected' WHEN k IN ('error', 'click') THEN 'unavailable' ELSE 'ready' END AS status FROM e"

# --- texts


def fil03_dialogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as reference texts of their conversation, joined in order; summaries only where nothing is said. Then what of it was heard."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("conv_id") % 3 == 0, "summary").when(F.col("turn") % 3 == 0, "subtitles").when(F.col("turn") % 3 == 1, "lyrics").otherwise("summary")
    texts = turns.select("conv_id", kind.alias("kind"), F.col("turn").alias("pos"), F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("text"))
    made = library.dialogue_text(texts, ["conv_id"])
    every = turns.select("conv_id").distinct().join(made, "conv_id", "left")
    return every.select("conv_id", "has_dialogue", F.md5("text").alias("text_md5"), F.md5(segments.heard_text(F.when(F.col("conv_id") % 2 == 0, " ").otherwise(F.col("text")), F.lit("heard"))).alias("heard_md5"))


_DIALOGUE_SQL = """
WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 OR turn % 3 = 2 THEN false ELSE true END AS d, trim(CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END, ' ') AS x FROM conversations),
g AS (SELECT conv_id, d, string_agg(x, chr(10) ORDER BY turn) AS x FROM t WHERE x <> '' GROUP BY ALL), b AS (SELECT conv_id, arg_max(x, d) AS x, bool_or(d) AS has_dialogue FROM g GROUP BY conv_id)
SELECT c.conv_id, has_dialogue, md5(x) AS text_md5, md5(CASE WHEN c.conv_id % 2 = 1 AND trim(x, ' ') <> '' THEN x ELSE 'heard' END) AS heard_md5 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b USING (conv_id)
"""


def snk04_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitles: numbered, timed, without what was filtered."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2.5).alias("start_s"), (F.col("turn") * 2.5 + 1.75 - F.col("turn") % 3 * 3).alias("end_s"), F.regexp_replace("text", r"\s+", " ").alias("text"), F.when(F.col("turn") % 4 == 3, "repeated").alias("filtered"))
    return segments.heard_srt(turns, ["conv_id"]).select("conv_id", F.md5("srt").alias("srt_md5"))


_SRT_SQL = """
WITH s AS (SELECT conv_id, (turn * 2500)::BIGINT AS a, greatest(turn * 2500, turn * 2500 + 1750 - turn % 3 * 3000)::BIGINT AS b, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t, turn FROM conversations WHERE turn % 4 <> 3),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS i FROM s WHERE t <> '')
SELECT conv_id, md5(string_agg(i || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || t || chr(10), chr(10) ORDER BY i)) AS srt_md5 FROM n GROUP BY conv_id
"""

def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each turn, dressed up as subtitles, as lyrics and as events of a styled file."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("text", r"^[^.,!?]*", 0), r"[^\p{L} ]", " "), r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("plain"))


def sca31_subtitle_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words as timed cues with tags, labels, sounds and notes, as stamped lyrics, and as styled events out of order: all read as the same dialogue."""
    rows, n = _cues(spark, sf_dir), F.col("turn") % 6
    dressed = (
        F.when(n == 0, F.concat(F.lit("<i>"), "plain", F.lit("</i>"))).when(n == 1, F.concat(F.lit("- "), "plain", F.lit(" (sighs [loudly])"))).when(n == 2, F.concat(F.lit("ANNA O'NEIL: "), "plain"))
        .when(n == 3, F.concat(F.lit("♪ "), "plain", F.lit(" ♪"))).when(n == 4, F.concat(F.lit(r"{\an8}"), "plain", F.lit(" &amp; [door]"))).otherwise(F.concat(F.lit("[music]\n"), "plain"))
    )
    times = F.concat(T.srt_time(F.col("turn") * 3.0), F.lit(" --> "), T.srt_time(F.col("turn") * 3.0 + 2))
    cue = F.concat(F.col("turn") + 1, F.lit("\n"), times, F.lit("\n"), dressed, F.lit("\n"))
    lyric = F.concat(F.format_string("[%02d:%02d.50]", F.col("turn") % 7, F.col("turn") % 60), F.lit(" "), F.lit("<00:01> "), "plain", F.lit(" [chorus]"))
    event = F.concat(F.lit("Dialogue: 0,0:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(".00,0:01:00.00,Default,,0,0,0,,"), F.lit(r"{\i1}"), F.replace("plain", F.lit(" "), F.lit(r"\N")))
    joined = lambda c, order, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c.alias("c")))), lambda x: x["c"]), by)
    files = rows.groupBy("conv_id").agg(joined(cue, F.col("turn"), "\n").alias("srt"), joined(lyric, F.col("turn"), "\n").alias("lrc"), joined(event, -F.col("turn"), "\n").alias("events"))
    styled = F.concat(F.lit("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"), "events")
    read = lambda c: F.md5(subtitles.dialogue_udf(c))
    return files.select("conv_id", read(F.col("srt")).alias("srt"), read(F.concat(F.lit("﻿WEBVTT\n\n"), "srt")).alias("vtt"), F.when(F.size(F.split("lrc", "\n")) > 1, F.md5(subtitles.column_udf(subtitles.lrc_to_lyrics)(F.col("lrc")))).alias("lrc"), read(styled).alias("ass"))


_KINDS_SQL = r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_extract(text, '^[^.,!?]*'), '[^\pL ]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM conversations),
d AS (SELECT *, CASE WHEN turn % 6 = 4 THEN trim(plain || ' &') ELSE plain END AS cue FROM c),
k AS (SELECT *, lag(lower(cue)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM d WHERE regexp_matches(cue, '[\pL\pN]')),
p AS (SELECT *, lag(lower(plain)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c WHERE plain <> ''),
a AS (SELECT conv_id, md5(string_agg(cue, chr(10) ORDER BY turn)) AS srt FROM k WHERE before IS NULL OR before <> lower(cue) GROUP BY conv_id),
b AS (SELECT conv_id, md5(string_agg(plain, chr(10) ORDER BY turn)) AS ass FROM p WHERE before IS NULL OR before <> lower(plain) GROUP BY conv_id),
l AS (SELECT conv_id, md5(coalesce(string_agg(plain, chr(10) ORDER BY turn) FILTER (plain <> ''), '')) AS lrc, count(*) AS n FROM c GROUP BY conv_id)
SELECT conv_id, coalesce(srt, md5('')) AS srt, coalesce(srt, md5('')) AS vtt, CASE WHEN n > 1 THEN lrc END AS lrc, coalesce(ass, md5('')) AS ass FROM l LEFT JOIN a USING (conv_id) LEFT JOIN b USING (conv_id)
"""


def win02_finished_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns as cues: those with letters or digits, runs that differ in case alone once."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.translate(F.coalesce("text", F.lit("")), "ß", "s"), " ")).alias("pos", "w"))
    cues = words.select("conv_id", "turn", "pos", F.when(F.col("pos") % 4 == 1, F.upper(F.substring("w", 1, 1))).when(F.col("pos") % 7 == 2, "...").otherwise(F.lower(F.substring("w", 1, 1))).alias("cue"))
    kept = segments.finish(cues, ["conv_id", "turn"], ["pos"])
    return kept.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "cue"))), lambda x: x["cue"]), "")).alias("cues_md5"))


_CUES_SQL = r"""
WITH w AS (SELECT conv_id, turn, unnest(string_split(replace(coalesce(text, ''), 'ß', 's'), ' ')) AS w, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS pos FROM conversations),
c AS (SELECT conv_id, turn, pos, CASE WHEN pos % 4 = 1 THEN upper(substr(w, 1, 1)) WHEN pos % 7 = 2 THEN '...' ELSE lower(substr(w, 1, 1)) END AS cue FROM w),
l AS (SELECT *, lag(lower(cue)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS p FROM c WHERE regexp_matches(cue, '[\pL\pN]'))
SELECT conv_id, turn, count(*) AS n, md5(string_agg(cue, '' ORDER BY pos)) AS cues_md5 FROM l WHERE p IS NULL OR p <> lower(cue) GROUP BY ALL
"""


def src10_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four encodings, read back whole."""
    n, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    latin = F.regexp_replace(text, r"[^\x00-\x7f\xa0-\xff]", "?")
    raw = F.when(n == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(n == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(n == 2, F.encode(text, "UTF-8")).otherwise(F.concat(F.encode(latin, "ISO-8859-1"), F.unhex(F.lit("80E9"))))

    def run(batches):
        for b in batches:
            b["text"] = [subtitles.decode_bytes(bytes(x)) for x in b.raw]
            yield b[["doc_id", "text"]]

    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).mapInPandas(run, "doc_id bigint, text string").select("doc_id", F.md5("text").alias("text_md5"))


_DECODED_SQL = r"SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN regexp_replace(coalesce(text, ''), '[^\x00-\x7f\x{a0}-\x{ff}]', '?', 'g') || '€é' ELSE coalesce(text, '') END) AS text_md5 FROM documents"


def joi16_files_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as local files named by marker or by title, and the episode each is."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    k = F.col("l_linenumber")
    name = F.when(F.col("p") % 3 == 0, F.concat(F.lit("Show.S01E"), F.lpad(k.cast("string"), 2, "0"), F.lit(".x.mkv"))).when(F.col("p") % 3 == 1, F.concat(F.lit("the long way "), k, F.lit(" home.avi"))).otherwise(F.concat(F.lit("clip"), k))
    files = lines.select("l_orderkey", name.alias("name"))
    title = F.when(k % 2 == 0, F.concat(F.lit("Way "), k)).otherwise(F.concat(F.lit("Long Way "), k))
    episodes = lines.filter("l_linenumber != 3").select("l_orderkey", F.lit(1).alias("season"), k.alias("number"), title.alias("title"))
    return library.file_for(files, episodes, ["l_orderkey"])


_FILES_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber AS k, max(l_partkey) % 3 AS p FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE p WHEN 0 THEN 'Show.S01E' || lpad(k::VARCHAR, 2, '0') || '.x.mkv' ELSE 'the long way ' || k || ' home.avi' END AS name, 1::INTEGER AS season, k::INTEGER AS number FROM l WHERE p < 2 AND k <> 3
"""


def joi15_archive_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an order's archive: listed by name, else told by their marker; the first of an episode serves it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    k = F.col("l_linenumber")
    entries = lines.select("l_orderkey", k.alias("pos"), F.when(F.col("p") % 3 == 0, F.concat(F.lit("dir/Sub "), F.col("s") % 5, F.lit(".SRT"))).when(F.col("p") % 3 == 1, F.concat(F.lit("x.s02e"), F.lpad((F.col("s") % 4).cast("string"), 2, "0"), F.lit(".srt"))).otherwise("readme.txt").alias("name"))
    listed = lines.select("l_orderkey", F.concat(F.lit("sub "), F.col("s") % 5, F.lit(".srt")).alias("name"), F.lit(2).alias("season"), (F.col("s") % 5).cast("int").alias("episode"))
    return library.archive_episodes(entries, listed, ["l_orderkey"]).select("l_orderkey", "season", "episode", "pos")


_ENTRIES_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber AS pos, max(l_partkey) % 3 AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey, pos, CASE p WHEN 0 THEN s % 5 ELSE s % 4 END AS episode FROM l WHERE p < 2)
SELECT l_orderkey, 2::INTEGER AS season, episode::INTEGER AS episode, min(pos) AS pos FROM e GROUP BY l_orderkey, episode
"""

# --- review and plans


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a customer's job."""
    o = table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderkey") % 13 == 0, "PlayAll").when(F.col("o_orderstatus") == "F", "Confident").when(F.col("o_orderstatus") == "O", "Extra").otherwise("Check")
    return o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("file_id"), verdict.alias("verdict"), F.col("o_totalprice").alias("price"), "o_orderpriority")


_FILES = "f AS (SELECT o_custkey AS job_id, o_orderkey AS file_id, CASE WHEN o_orderkey % 13 = 0 THEN 'PlayAll' WHEN o_orderstatus = 'F' THEN 'Confident' WHEN o_orderstatus = 'O' THEN 'Extra' ELSE 'Check' END AS verdict, o_orderpriority AS pr FROM orders)"


def agg22_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every category of each customer's review: the user's choices where there are any, else what the verdicts start with."""
    files = _files(spark, sf_dir)
    own = files.filter("file_id % 5 = 0 and verdict != 'PlayAll'").select("job_id", "file_id", F.when(F.col("file_id") % 10 == 0, "skip").otherwise("pending").alias("choice"), F.lit(False).alias("approved"))
    reviews = renames.with_initial(own, files, ["job_id", "file_id"])
    told = files.join(reviews, ["job_id", "file_id"], "left").withColumn("category", renames.category(F.col("file_id") % 17 > 0, F.when(F.col("verdict") == "PlayAll", "playAll").otherwise("episode"), F.col("choice"), F.coalesce("approved", F.lit(False))))
    shown = renames.in_filter(F.col("category"), "extras")
    return renames.category_counts(told, ["job_id"]).join(told.groupBy("job_id").agg(F.count_if(shown).alias("shown")), "job_id")


_REVIEW_SQL = "WITH " + _FILES + """, r AS (SELECT *, CASE WHEN verdict = 'PlayAll' THEN NULL WHEN file_id % 10 = 0 THEN 'skip' WHEN file_id % 5 = 0 THEN 'pending' WHEN verdict = 'Confident' THEN 'approved' WHEN verdict = 'Extra' THEN 'notAnEpisode' ELSE 'pending' END AS choice,
  file_id % 5 > 0 AND verdict IN ('Confident', 'Extra') AS ok FROM f),
c AS (SELECT *, CASE WHEN file_id % 17 = 0 THEN 'waiting' WHEN verdict = 'PlayAll' THEN 'playAll' WHEN choice = 'skip' THEN 'skipped' WHEN NOT ok THEN 'check' WHEN choice = 'notAnEpisode' THEN 'extra' ELSE 'approved' END AS k FROM r)
SELECT job_id, count(*) FILTER (k = 'approved') AS approved, count(*) FILTER (k = 'check') AS "check", count(*) FILTER (k = 'extra') AS extra, count(*) FILTER (k = 'skipped') AS skipped, count(*) FILTER (k = 'playAll') AS "playAll", count(*) FILTER (k = 'waiting') AS waiting, count(*) FILTER (k = 'extra') AS shown FROM c GROUP BY job_id"""


def top06_recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty customers' jobs that finished last, with their files and those to review."""
    files = _files(spark, sf_dir)
    finished = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("t"))
    jobs = finished.select("job_id", F.when(F.col("job_id") % 4 > 0, F.col("t")).alias("finished_ms"), (F.col("job_id") % 3 == 0).alias("saved"))
    return renames.recent_jobs(jobs, files)


_RECENT_SQL = "WITH " + _FILES + """, j AS (SELECT o_custkey AS job_id, max(epoch_ms(o_orderdate)) AS finished_ms, o_custkey % 3 = 0 AS saved FROM orders WHERE o_custkey % 4 > 0 GROUP BY o_custkey ORDER BY finished_ms DESC, job_id DESC LIMIT 20)
SELECT job_id, any_value(finished_ms) AS finished_ms, any_value(saved) AS saved, count(*) FILTER (verdict <> 'PlayAll') AS file_count, CASE WHEN any_value(saved) THEN 0 ELSE count(*) FILTER (verdict = 'Check') END AS to_review FROM j JOIN f USING (job_id) GROUP BY job_id"""


def pln01_built_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's rename plan: approved orders at their rendered paths, all others with why they stay."""
    f = _files(spark, sf_dir)
    files = f.select("job_id", "file_id", F.concat(F.lit("/in/"), "file_id", F.lit(".MKV")).alias("path"), F.when(F.col("file_id") % 19 == 0, "ignored").otherwise("candidate").alias("role"), F.lit(1).alias("size_bytes"))
    decisions = f.filter("file_id % 3 > 0").select("job_id", "file_id", F.when(F.col("verdict") == "Confident", "approved").when(F.col("file_id") % 2 == 0, "notAnEpisode").otherwise("pending").alias("decision"), F.lit(1).alias("season"), (F.col("file_id") % 100).cast("int").alias("number"))
    episodes = decisions.select("job_id", "season", "number").distinct().withColumn("title", F.concat(F.lit("Part: "), "number"))
    items, rest = renames.build_plan(files, decisions, f, episodes, ("Show", 1999), "kodi", "/out/")
    return items.select("job_id", "file_id", F.col("to").alias("told")).unionByName(rest.select("job_id", "file_id", F.col("reason").alias("told")))


_BUILT_SQL = "WITH " + _FILES + """ SELECT job_id, file_id, CASE WHEN verdict = 'PlayAll' THEN 'playAll' WHEN file_id % 19 = 0 THEN 'skipped' WHEN file_id % 3 = 0 THEN CASE WHEN verdict = 'Extra' THEN 'extra' ELSE 'skipped' END
  WHEN verdict = 'Confident' THEN printf('/out/Show (1999)/Season 01/Show S01E%02d - Part - %d.mkv', file_id % 100, file_id % 100) WHEN file_id % 2 = 0 THEN 'extra' ELSE 'skipped' END AS told FROM f"""


def sca55_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each customer's files, in a sentence; and how far its job is."""
    f = _files(spark, sf_dir).filter("verdict != 'Confident'")
    reason = F.when(F.col("verdict") == "PlayAll", "playAll").when(F.col("verdict") == "Extra", "extra").otherwise("skipped")
    listed = f.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("file_id", F.concat(F.lit("/x/"), "file_id", F.lit(".mkv")).alias("path"), reason.alias("reason")))), lambda r: F.struct(r["path"].alias("path"), r["reason"].alias("reason"))).alias("rows"))
    progress = renames.file_progress(f.withColumn("status", F.element_at(F.array(F.lit("done"), F.lit("waiting"), F.lit("failed")), (F.col("file_id") % 3 + 1).cast("int"))), ["job_id"])
    return listed.select("job_id", evidence.untouched_summary(F.col("rows")).alias("said")).join(progress, "job_id")


_UNTOUCHED_SQL = "WITH " + _FILES + """, g AS (SELECT job_id, list(file_id || '.mkv (play all)' ORDER BY file_id) FILTER (verdict = 'PlayAll') AS p, list(file_id || '.mkv' ORDER BY file_id) FILTER (verdict = 'Extra') AS e, count(*) FILTER (verdict = 'Check') AS s, count(*) AS n,
  count(*) FILTER (verdict <> 'PlayAll' AND file_id % 3 <> 1) AS done, count(*) FILTER (verdict <> 'PlayAll') AS total FROM f WHERE verdict <> 'Confident' GROUP BY job_id),
t AS (SELECT *, list_concat(coalesce(p, []), CASE WHEN len(e) = 1 THEN [e[1] || ' (extra)'] WHEN len(e) > 3 THEN [len(e) || ' extras (' || array_to_string(e[1:3], ', ') || ', …)'] WHEN len(e) > 1 THEN [len(e) || ' extras (' || array_to_string(e, ', ') || ')'] ELSE [] END,
  CASE s WHEN 0 THEN [] WHEN 1 THEN ['1 skipped or unchecked file'] ELSE [s || ' skipped or unchecked files'] END) AS parts FROM g)
SELECT job_id, 'Not renamed: ' || CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], ', ') || ' and ' || parts[len(parts)] ELSE parts[1] END || CASE WHEN n = 1 THEN ' stays as it is.' ELSE ' stay as they are.' END AS said, done, total FROM t"""


def win14_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts below folders of their brand as a preview: a folder's line where it differs from the one before."""
    items = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("job_id"), F.concat(F.when(F.col("p_size") % 4 > 0, F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"))).otherwise(""), F.col("p_partkey").cast("string")).alias("to"))
    return renames.preview_tree(items).select("job_id", "to", F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"), "line")


_PREVIEW_SQL = """
WITH i AS (SELECT p_partkey % 20 AS job_id, CASE WHEN p_size % 4 > 0 THEN replace(p_brand, '#', '') ELSE '' END AS folder, p_partkey::VARCHAR AS name FROM part), t AS (SELECT *, CASE WHEN folder <> '' THEN folder || '/' ELSE '' END || name AS "to" FROM i),
l AS (SELECT *, lag(folder) OVER (PARTITION BY job_id ORDER BY "to") AS before FROM t), h AS (SELECT *, folder <> '' AND (before IS NULL OR before <> folder) AS head FROM l)
SELECT job_id, "to", 0::BIGINT AS pos, 0::BIGINT AS depth, folder AS line FROM h WHERE head UNION ALL SELECT job_id, "to", CASE WHEN head THEN 1 ELSE 0 END, 1, name FROM h
"""

def win15_next_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer's middle file on, the next that needs a check."""
    f = _files(spark, sf_dir)
    idx = F.row_number().over(Window.partitionBy("job_id").orderBy("file_id")) - 1
    rows = f.select("job_id", idx.alias("idx"), F.when(F.col("verdict") == "Check", "check").otherwise("approved").alias("category"), F.floor(F.count("*").over(Window.partitionBy("job_id")) / 2).cast("int").alias("at"))
    return renames.next_to_review(rows, ["job_id"], F.col("at")).select("job_id", F.col("next_idx").cast("bigint").alias("next_idx"))


_NEXT_SQL = "WITH " + _FILES + """, i AS (SELECT job_id, verdict, row_number() OVER (PARTITION BY job_id ORDER BY file_id) - 1 AS idx, count(*) OVER (PARTITION BY job_id) // 2 AS a, count(*) OVER (PARTITION BY job_id) - 1 AS last FROM f)
SELECT job_id, coalesce(min(idx) FILTER (verdict = 'Check' AND idx > a), min(idx) FILTER (verdict = 'Check' AND idx < a), least(any_value(a) + 1, any_value(last)))::BIGINT AS next_idx FROM i GROUP BY job_id"""


def top07_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal: the entries that show in the history, with how many items moved."""
    e = table(spark, sf_dir, "events")
    entry, k = F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 500)), F.col("event_id")
    kind = F.when(k % 9 == 0, "begin").when(F.col("event_type") == "click", "intent").when(F.col("event_type") == "error", "failed").when(k % 41 == 5, "undone").otherwise("done")
    record = F.struct(kind.alias("kind"), entry.alias("entry"), (k % 5).cast("int").alias("op"), F.lit("move").alias("action"), (k % 5).cast("string").alias("item"), F.concat(F.lit("/a/"), k).alias("from"), F.concat(F.lit("/b/"), k % 7).alias("to"), (k * 10).alias("createdMs"), (k * 10 + 1).alias("atMs"))
    records = folds.read_journal(e.select(k.alias("line_no"), F.to_json(record).alias("value")))
    return folds.history(records, folds.operations(records)).select("entry", "created_ms", "items", "undone_ms")


_HISTORY_SQL = """
WITH r AS (SELECT event_id AS k, user_id || '-' || (event_id // 500) AS entry, event_id % 5 AS op, '/a/' || event_id AS f, '/b/' || (event_id % 7) AS t,
  CASE WHEN event_id % 9 = 0 THEN 'begin' WHEN event_type = 'click' THEN 'intent' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 41 = 5 THEN 'undone' ELSE 'done' END AS kind FROM events),
b AS (SELECT entry, min(k) AS begun, max(k) * 10 AS created_ms FROM r WHERE kind = 'begin' GROUP BY entry), t AS (SELECT r.* FROM r JOIN b USING (entry) WHERE k >= begun),
i AS (SELECT entry, op, arg_min(f, k) AS f, arg_min(t, k) AS t FROM t WHERE kind = 'intent' GROUP BY ALL), s AS (SELECT entry, op, arg_max(kind, k) AS status FROM t WHERE kind IN ('done', 'failed') GROUP BY ALL),
n AS (SELECT entry, count(*) AS items FROM i JOIN s USING (entry, op) WHERE status = 'done' AND f <> t GROUP BY entry), u AS (SELECT entry, max(k * 10 + 1) AS undone_ms FROM r WHERE kind = 'undone' GROUP BY entry)
SELECT entry, created_ms, coalesce(items, 0) AS items, undone_ms FROM b LEFT JOIN n USING (entry) LEFT JOIN u USING (entry) WHERE items > 0 OR undone_ms IS NOT NULL
"""


def set07_left_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users' events left that a later error did not delete; and the folder each was scanned under."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), F.concat(F.lit("/root/"), F.col("event_id") % 40, F.lit("/"), F.col("event_id") % 11).alias("path"), "event_type")
    kept = folds.retained(e.filter("event_type = 'click'").select("entry", "path").distinct(), e.filter("event_type = 'error'"))
    return kept.select("entry", "path", T.scan_root(F.col("path"), F.regexp_extract("path", "([^/]*/[^/]*)$", 1)).alias("root"))


_LEFT_SQL = "WITH e AS (SELECT user_id AS entry, '/root/' || (event_id % 40) || '/' || (event_id % 11) AS path, event_type AS t FROM events) SELECT DISTINCT entry, path, '/root' AS root FROM e WHERE t = 'click' AND NOT EXISTS (SELECT 1 FROM e d WHERE d.t = 'error' AND d.entry = e.entry AND d.path = e.path)"


def top08_reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reference texts of their order, ranked by kind, provider and reference; and the orders of the chosen seasons."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("rf"), F.max("l_suppkey").alias("provider_rank"), F.max("l_partkey").alias("provider_ref"), F.max(F.year("l_shipdate")).alias("season"))
    texts = rows.withColumn("kind", F.when(F.col("rf") == "N", "subtitles").when(F.col("rf") == "A", "lyrics").otherwise("summary"))
    placed = texts.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*library.reference_order(), "l_linenumber")))
    years = [r["y"] for r in table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).distinct().orderBy("y").limit(3).collect()]
    return library.season_filter(placed, years).select("l_orderkey", "l_linenumber", F.col("place").cast("bigint").alias("place"))


_ORDERED_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS rf, max(l_suppkey) AS s, max(l_partkey) AS p, max(year(l_shipdate)) AS y FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE rf WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, s, p, l_linenumber) AS place FROM l)
SELECT l_orderkey, l_linenumber, place FROM r WHERE y IN (SELECT DISTINCT year(l_shipdate) FROM lineitem ORDER BY 1 LIMIT 3)
"""

def src01_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one scanned folder, some unreadable or without sound, one of them as long as a thousand: its files, and the summary as a row of its own."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(F.concat(F.when(k % 7 == 0, "sub/").otherwise(""), F.lit("t"), k, F.when(k % 10 == 3, ".txt").otherwise(".mkv")).alias("path"), k.alias("k"), F.col("o_custkey").alias("c"))
    audio = F.when(F.col("k") % 6 > 0, F.array(F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type")))).otherwise(F.array().cast("array<struct<index:int,codec_type:string>>"))
    raw = F.to_json(F.struct(F.struct(F.lit("x").alias("format_name"), (F.col("c") % 40 + 5).cast("string").alias("duration")).alias("format"), audio.alias("streams")))
    scanned, summary = probe.scan(files.select("path"), files.select("path", F.when(F.col("k") % 11 > 0, raw).alias("raw")), "/rips/Harbour Lights Disc 1", recursive=True)
    told = F.concat_ws(" ", F.coalesce("play_all", F.lit("none")), "n_candidates", "n_warnings", "show_guess")
    return scanned.select("file_id", "duration_s", "role", "warning").unionByName(summary.select(F.lit("summary").alias("file_id"), F.lit(None).cast("double").alias("duration_s"), told.alias("role"), F.lit(None).cast("string").alias("warning")))


_SCANS_SQL = """
WITH f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'sub/' ELSE '' END || 't' || o_orderkey || '.mkv' AS file_id, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 40 + 5 END::DOUBLE AS duration_s, o_orderkey % 6 > 0 AS sound FROM orders WHERE o_orderkey % 10 <> 3),
r AS (SELECT file_id, duration_s, CASE WHEN duration_s IS NULL OR NOT sound OR duration_s < 20 THEN 'ignored' ELSE 'candidate' END AS role, CASE WHEN duration_s IS NULL THEN 'unreadable' WHEN NOT sound THEN 'noAudio' END AS warning FROM f)
SELECT * FROM r UNION ALL SELECT 'summary', NULL, 'none ' || count(*) FILTER (role = 'candidate') || ' ' || count(warning) || ' Harbour Lights', NULL FROM r
"""


def src11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as archives of subtitle files in several kinds beside what is none: the texts, preferred kinds first."""
    import io
    import zipfile

    def packed(batches):
        for b in batches:
            payloads = []
            for turns in b.turns:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("__MACOSX/x.srt", "no")
                    z.writestr("read.me", "no")
                    for t in turns:
                        kind = ("vtt", "srt", "ass")[t["turn"] % 3]
                        body = t["plain"] if kind == "ass" else f"1\n00:00:01,000 --> 00:00:02,000\n{t['plain']}\n"
                        text = {"vtt": "WEBVTT\n\n" + body, "srt": body, "ass": "[Events]\nFormat: Start, Text\nDialogue: 0:00:01.00," + body + "\n"}[kind]
                        z.writestr(f"d/T{t['turn']}.{kind.upper()}", text.encode("utf-16" if t["turn"] % 2 else "utf-8"))
                payloads.append(held.getvalue())
            b["payload"] = payloads
            yield b[["conv_id", "payload"]]

    turns = _cues(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "plain"))).alias("turns"))
    found = archives.extract(turns.mapInPandas(packed, "conv_id bigint, payload binary"), ["conv_id"])
    return found.select("conv_id", "pos", "name", F.md5("text").alias("text_md5"), "error")


_ARCHIVES_SQL = r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_extract(text, '^[^.,!?]*'), '[^\pL ]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE turn % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END, turn) - 1)::INTEGER AS pos, 'd/T' || turn || CASE turn % 3 WHEN 0 THEN '.VTT' WHEN 1 THEN '.SRT' ELSE '.ASS' END AS name, md5(plain) AS text_md5, NULL::VARCHAR AS error FROM c
"""


def top12_lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped lyrics whose lines are sung twice: a row for each stamp, by time."""
    import pandas as pd

    rows = _cues(spark, sf_dir)
    line = F.concat(F.format_string("[%02d:%02d.00][by:x][%d:30]", F.col("turn") % 5, F.col("turn") * 7 % 60, F.col("turn") + 2), "plain")
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("lrc"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(c, i, s, t) for c, text in zip(b.conv_id, b.lrc, strict=True) for i, (s, t) in enumerate(subtitles.lrc_lines(text))], columns=["conv_id", "pos", "at_s", "line"])

    return files.mapInPandas(run, "conv_id bigint, pos bigint, at_s double, line string")


_LRC_SQL = r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_extract(text, '^[^.,!?]*'), '[^\pL ]', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM conversations),
s AS (SELECT conv_id, turn, 0 AS k, (turn % 5 * 60 + turn * 7 % 60)::DOUBLE AS at_s, line FROM c UNION ALL SELECT conv_id, turn, 1, ((turn + 2) * 60 + 30)::DOUBLE, line FROM c)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY at_s, turn, k) - 1 AS pos, at_s, line FROM s
"""

def pln04_plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plan rows, some of them twice, against a plan made later: what changed."""
    p = table(spark, sf_dir, "part")
    old = p.select((F.col("p_partkey") % 50).alias("job_id"), "p_name", "p_size")
    new = p.filter("p_partkey % 13 > 0").select((F.col("p_partkey") % 50).alias("job_id"), "p_name", (F.col("p_size") + F.when(F.col("p_partkey") % 17 == 0, 1).otherwise(0)).alias("p_size"))
    return renames.plan_changes(old, new)


_CHANGES_SQL = """
WITH o AS (SELECT p_partkey % 50 AS job_id, p_name, p_size FROM part), n AS (SELECT p_partkey % 50 AS job_id, p_name, (p_size + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END)::INTEGER AS p_size FROM part WHERE p_partkey % 13 > 0)
SELECT *, 'gone' AS change FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'new' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)
"""


def ker11_added_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns heard in two passes, put together: all marked anew in order, and the stretches listened to, merged."""
    turns = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 6 == 1, "please subscribe").when(F.col("turn") % 5 == 3, "(door) [slams (twice)]").when(F.col("turn") % 2 == 0, "Where is it?").otherwise("where, is it")
    rows = turns.select("conv_id", (F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2.0 + 1.5).alias("end_s"), text.alias("text"), F.lit(0.1).alias("no_speech_prob"), F.lit(-0.2).alias("avg_logprob"), F.lit("repeated").alias("filtered"))
    windows = turns.select("conv_id", (F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2.0 + 1 + F.col("turn") % 3).alias("end_s"))
    marked, merged = segments.add_window(rows.filter("start_s % 4 = 0"), rows.filter("start_s % 4 != 0"), windows, ["conv_id"])
    return marked.select("conv_id", "start_s", "filtered").unionByName(merged.select("conv_id", "start_s", F.concat(F.lit("until "), F.col("end_s").cast("int")).alias("filtered")))


_ADDED_SQL = r"""
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 1 THEN 'please subscribe' WHEN turn % 5 = 3 THEN 'door slams twice' ELSE 'where is it' END AS norm FROM conversations),
p AS (SELECT *, lag(norm) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM s),
i AS (SELECT conv_id, turn, turn * 2.0 AS a, turn * 2.0 + 1 + turn % 3 AS b FROM conversations), n AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY conv_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY a) AS k FROM n)
SELECT conv_id, (turn * 2)::DOUBLE AS start_s, CASE WHEN norm = 'please subscribe' THEN 'knownHallucination' WHEN norm = 'door slams twice' THEN 'noSpeech' WHEN norm = before THEN 'repeated' END AS filtered FROM p
UNION ALL SELECT conv_id, min(a)::DOUBLE, 'until ' || max(b)::INTEGER FROM g GROUP BY conv_id, k
"""


def sca37_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and numeric character references in parts' names, none decoded twice, unknown and over-long ones left."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("{n}&#233;&#x4E2D;", "&lt;{n}&gt;&amp;lt;", "{n}&bogus; &hellip;", "&#00000000000065;{n}", "&ldquo;{n}&rdquo;&nbsp;&mdash;", "&#xD800;{n}&#1114112;")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", subtitles.column_udf(subtitles.decode_entities)(F.replace(form, F.lit("{n}"), F.col("p_name"))).alias("text"))


_REFERENCES_SQL = "SELECT p_partkey, replace(['{n}é中', '<{n}>&lt;', '{n}&bogus; …', '&#00000000000065;{n}', '\"{n}\" —', '&#xD800;{n}&#1114112;'][p_partkey % 6 + 1], '{n}', p_name) AS text FROM part"


QUERIES = {f.__name__: f for f in (
    fil05_streams, src06_probes, src02_listing, src12_found_shows, src12_episodes, joi14_dvd_numbering, src13_seasons, joi20_find_show, src14_packs, top05_season_texts, src15_lyrics, msc05_source_status,
    fil03_dialogue_texts, snk04_srt, sca31_subtitle_kinds, win02_finished_cues, src10_decoded, joi16_files_for, joi15_archive_episodes, agg22_review_counts, top06_recent_jobs, pln01_built_plan, sca55_untouched,
    win14_preview, win15_next_to_review, top07_history, set07_left_behind, top08_reference_order, src01_scans, src11_archives, top12_lyric_lines, pln04_plan_changes, ker11_added_windows, sca37_references,
)}
ORACLE_SQL = {
    "fil05_streams": _STREAMS_SQL, "src06_probes": _PROBES_SQL, "src02_listing": _LISTING_SQL, "src12_found_shows": _SHOWS_SQL, "src12_episodes": _EPISODES_SQL, "joi14_dvd_numbering": _DVD_SQL, "src13_seasons": _SEASONS_SQL,
    "joi20_find_show": _FIND_SQL, "src14_packs": _PACKS_SQL, "top05_season_texts": _SERVED_SQL, "src15_lyrics": _LYRICS_SQL, "msc05_source_status": _STATUS_SQL, "fil03_dialogue_texts": _DIALOGUE_SQL, "snk04_srt": _SRT_SQL,
    "sca31_subtitle_kinds": _KINDS_SQL, "win02_finished_cues": _CUES_SQL, "src10_decoded": _DECODED_SQL, "joi16_files_for": _FILES_SQL, "joi15_archive_episodes": _ENTRIES_SQL, "agg22_review_counts": _REVIEW_SQL,
    "top06_recent_jobs": _RECENT_SQL, "pln01_built_plan": _BUILT_SQL, "sca55_untouched": _UNTOUCHED_SQL, "win14_preview": _PREVIEW_SQL, "win15_next_to_review": _NEXT_SQL, "top07_history": _HISTORY_SQL, "set07_left_behind": _LEFT_SQL,
    "top08_reference_order": _ORDERED_SQL, "src01_scans": _SCANS_SQL, "src11_archives": _ARCHIVES_SQL, "top12_lyric_lines": _LRC_SQL, "pln04_plan_changes": _CHANGES_SQL, "ker11_added_windows": _ADDED_SQL, "sca37_references": _REFERENCES_SQL,
}
