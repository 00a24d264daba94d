"""Landed provider responses as typed tables. Fetching stays outside; lenient fields become null, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import text as T

SHOW = "struct<id:bigint,name:string,premiered:string,externals:struct<thetvdb:string,imdb:string>>"
EPISODE = "struct<id:bigint,name:string,season:int,number:int,airdate:string,runtime:double,summary:string>"
SEARCH_A = f"array<struct<score:double,show:{SHOW}>>"
EPISODES_A = f"array<{EPISODE}>"
ALTERNATES_A = f"array<struct<name:string,season:int,number:int,runtime:double,_embedded:struct<episodes:array<{EPISODE}>>>>"
FIND_B = "struct<tv_results:array<struct<id:bigint,name:string,first_air_date:string>>,results:array<struct<id:bigint,name:string,first_air_date:string>>>"
SEASON_B = "struct<episodes:array<struct<id:bigint,name:string,season_number:int,episode_number:int,air_date:string,overview:string,runtime:double>>>"
GROUPS_B = "struct<groups:array<struct<name:string,`order`:int,episodes:array<struct<id:bigint,name:string,air_date:string,overview:string,runtime:double,`order`:int>>>>>"
PACKS = "struct<status:boolean,error:string,results:array<struct<name:string,year:string>>,subtitles:array<struct<url:string,release_name:string,season:string,episode:string,episode_from:string,episode_end:string,full_season:boolean,hi:boolean,unpack_files:array<struct<name:string,season:string,episode:string,hi:boolean,format:string,url:string>>>>>"
LYRICS = "array<struct<id:bigint,trackName:string,artistName:string,albumName:string,duration:double,instrumental:boolean,plainLyrics:string,syncedLyrics:string>>"


def whole_number(c: Column) -> Column:
    """A number or a numeric string, else null."""
    return F.trim(c.cast("string")).try_cast("int")


def search_a(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Shows found, scores as shares of the best."""
    from cinelake.operators.library import scaled_candidates

    found = rows.select(*keys, F.explode(F.from_json(body, SEARCH_A)).alias("r")).select(*keys, F.coalesce("r.score", F.lit(0.0)).alias("score"), "r.show.id", "r.show.name", T.year_of(F.col("r.show.premiered")).alias("year"))
    return scaled_candidates(found, keys)


def search_b(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Shows found, scored by their place: the first 1, falling evenly."""
    results = F.coalesce(F.from_json(body, FIND_B)["results"], F.array().cast("array<struct<id:bigint,name:string,first_air_date:string>>"))
    found = rows.select(*keys, F.size(results).alias("n"), F.posexplode(results).alias("i", "r"))
    return found.select(*keys, (1 - F.col("i") / F.col("n")).alias("score"), "r.id", "r.name", T.year_of(F.col("r.first_air_date")).alias("year"))


def episodes_a(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Aired episodes, specials numbered; runtimes in seconds, summaries without markup."""
    from cinelake.operators.library import aired_numbering

    raw = rows.select(*keys, F.explode(F.from_json(body, EPISODES_A)).alias("e")).select(*keys, "e.*")
    return aired_numbering(raw, keys).withColumn("runtime_s", F.col("runtime") * 60).withColumn("summary", F.nullif(T.strip_html(F.col("summary")), F.lit(""))).drop("runtime")


def dvd_a(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """The alternate order with its originals embedded."""
    raw = rows.select(*keys, F.explode(F.from_json(body, ALTERNATES_A)).alias("e")).select(*keys, "e.name", "e.season", "e.number", "e.runtime", F.col("e._embedded.episodes").alias("_eps"))
    original = F.try_element_at("_eps", F.lit(1))
    kept = raw.withColumn("_o", original).filter(F.col("_o").isNotNull() & F.col("season").isNotNull() & F.col("number").isNotNull())
    return kept.select(*keys, "season", "number", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("_o.name")).alias("title"), F.coalesce("runtime", "_o.runtime").alias("runtime"), F.col("_o.id").alias("id"))


def season_b(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    raw = rows.select(*keys, F.explode(F.from_json(body, SEASON_B)["episodes"]).alias("e"))
    return raw.select(*keys, "e.id", F.col("e.name").alias("title"), F.col("e.season_number").alias("season"), F.col("e.episode_number").alias("number"), F.col("e.air_date").alias("airdate"), (F.col("e.runtime") * 60).alias("runtime_s"), F.nullif(F.trim("e.overview"), F.lit("")).alias("summary"))


def groups_b(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Episodes of named groups, numbered within them; the group's place or name gives the season."""
    from cinelake.operators.library import group_members, group_numbering

    groups = rows.select(*keys, F.explode(F.from_json(body, GROUPS_B)["groups"]).alias("g")).select(*keys, "g.name", "g.order", F.col("g.episodes").alias("eps"))
    placed = group_numbering(groups, keys).select(*keys, F.col("order").alias("group_order"), "season", F.explode("eps").alias("e"))
    return group_members(placed.select(*keys, "group_order", "season", "e.id", F.col("e.name").alias("title"), "e.order"), keys, "group_order").drop("order")


def find_show(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The show of another provider: by one id, else another, else the only search result of the same name and year."""
    one = F.count("*").over(Window.partitionBy(*keys))
    searched = rows.filter("how = 'search'").withColumn("_n", one).filter("_n = 1").drop("_n")
    known = rows.filter("how != 'search'").unionByName(searched)
    rank = F.when(F.col("how") == "thetvdb", 0).when(F.col("how") == "imdb", 1).otherwise(2)
    return known.groupBy(*keys).agg(F.min_by("id", rank).alias("id"), F.min_by("how", rank).alias("how"))


def packs(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Subtitles listed by a provider: what they cover and whether they are a pack."""
    raw = rows.select(*keys, F.posexplode(F.from_json(body, PACKS)["subtitles"]).alias("pos", "s"))
    files = F.transform(F.coalesce(F.col("s.unpack_files"), F.array().cast("array<struct<name:string,season:string,episode:string,hi:boolean,format:string,url:string>>")), lambda f: F.struct(f["name"].alias("name"), whole_number(f["season"]).alias("season"), whole_number(f["episode"]).alias("episode"), f["hi"].alias("hi"), f["url"].alias("url")))
    one = raw.select(*keys, "pos", F.coalesce("s.url", F.lit("")).alias("url"), F.col("s.hi").alias("hi"), "s.full_season", files.alias("files"), *(whole_number(F.col(f"s.{c}")).alias(c) for c in ("season", "episode", "episode_from", "episode_end")))
    return one.withColumn("is_pack", F.coalesce("full_season", F.lit(False)) | (F.size("files") > 1))


def lyrics(rows: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Lyrics records whose length is unknown or at most ten minutes."""
    raw = rows.select(*keys, F.explode(F.from_json(body, LYRICS)).alias("r"))
    made = raw.select(*keys, "r.id", F.col("r.trackName").alias("track"), F.coalesce("r.artistName", F.lit("")).alias("artist"), F.coalesce("r.albumName", F.lit("")).alias("album"), "r.duration", F.coalesce("r.instrumental", F.lit(False)).alias("instrumental"), F.col("r.plainLyrics").alias("plain"), F.col("r.syncedLyrics").alias("synced"))
    return made.filter(F.col("duration").isNull() | (F.col("duration") <= 600))
