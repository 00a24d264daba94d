"""Episode lists and reference texts: numbering, choosing and cascades, as windows and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.functions import text as T


def aired_numbering(episodes: DataFrame, show: list[str]) -> DataFrame:
    """season and number of an aired list; an episode without either is a special, numbered by air date (none last), then id."""
    special = F.col("season").isNull() | F.col("number").isNull()
    blank = F.coalesce(F.col("airdate"), F.lit("")) == ""
    order = Window.partitionBy(*show, special).orderBy(blank, F.coalesce("airdate", F.lit("")), "id")
    n = F.row_number().over(order)
    return episodes.withColumn("_n", n).withColumn("_s", special).withColumn("season", F.when(F.col("_s"), 0).otherwise(F.col("season"))).withColumn("number", F.when(F.col("_s"), F.col("_n")).otherwise(F.col("number"))).drop("_n", "_s")


def group_numbering(groups: DataFrame, show: list[str]) -> DataFrame:
    """season of each named group in its order: specials 0, else the first number in the name, else its place among the others."""
    special = F.contains(F.lower("name"), F.lit("special"))
    place = F.sum(F.when(special, 0).otherwise(1)).over(Window.partitionBy(*show).orderBy("order"))
    told = F.regexp_extract("name", "([0-9]+)", 1).try_cast("int")
    return groups.withColumn("season", F.when(special, 0).otherwise(F.coalesce(told, place)).cast("int"))


def group_members(episodes: DataFrame, show: list[str], group: str) -> DataFrame:
    """number within the group, by the episodes' own order (none last)."""
    return episodes.withColumn("number", F.row_number().over(Window.partitionBy(*show, group).orderBy(F.asc_nulls_last("order"), "id")))


def counts(episodes: DataFrame, show: list[str]) -> DataFrame:
    """Distinct seasons and episodes of what is numbered."""
    numbered = F.col("season").isNotNull() & F.col("number").isNotNull()
    return episodes.groupBy(*show).agg(F.countDistinct(F.when(numbered, F.col("season"))).alias("seasons"), F.count_if(numbered).alias("episodes"))


def dvd_list(alternates: DataFrame) -> DataFrame:
    """The alternate order with its first embedded original: own title and runtime where present; no original or number drops."""
    original = F.try_element_at("originals", F.lit(1))
    kept = alternates.withColumn("_o", original).filter(F.col("_o").isNotNull() & F.col("season").isNotNull() & F.col("number").isNotNull())
    own = lambda c, o: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(o))
    return kept.select("season", "number", own("name", "_o.name").alias("title"), F.coalesce("runtime", "_o.runtime").alias("runtime"), F.col("_o.id").alias("id"))


def aired_keys(dvd: DataFrame, aired: DataFrame, show: list[str]) -> DataFrame:
    """The aired season and number of each DVD episode, by the provider's id; its own where the id is unknown."""
    known = aired.select(*show, F.col("id").alias("_id"), F.col("season").alias("_s"), F.col("number").alias("_n"))
    joined = dvd.join(known, [*(dvd[c] == known[c] for c in show), dvd["id"] == known["_id"]], "left") if not show else dvd.join(known.withColumnRenamed("_id", "id"), [*show, "id"], "left")
    return joined.withColumn("aired_season", F.coalesce("_s", "season")).withColumn("aired_number", F.coalesce("_n", "number")).drop("_s", "_n", "_id")


def cascade(episodes: DataFrame, providers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Reference texts by priority: each provider fills only the episodes that all before it left without."""
    found, lacking = [], episodes.select(*keys).distinct()
    for rank, texts in enumerate(providers):
        got = texts.join(lacking, keys, "left_semi").withColumn("provider_rank", F.lit(rank))
        found.append(got)
        lacking = lacking.join(got.select(*keys).distinct(), keys, "left_anti")
    return reduce(DataFrame.unionByName, found)


def with_summaries(episodes: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts, and for episodes without any their summary where it isn't blank."""
    bare = episodes.join(texts.select(*keys).distinct(), keys, "left_anti").filter(F.trim("summary") != "")
    return texts.select(*keys, "kind", "text").unionByName(bare.select(*keys, F.lit("summary").alias("kind"), F.col("summary").alias("text")))


def reference_order() -> list[Column]:
    """Subtitles before lyrics before summaries, then as the providers rank."""
    kind = F.when(F.col("kind") == "subtitles", 0).when(F.col("kind") == "lyrics", 1).otherwise(2)
    return [kind, F.col("provider_rank"), F.col("provider_ref")]


def dialogue_text(texts: DataFrame, keys: list[str]) -> DataFrame:
    """text of each episode: its trimmed, non-blank subtitles and lyrics in order, a line each; else its summaries."""
    clean = texts.withColumn("text", F.trim("text")).filter(F.col("text") != "").withColumn("_d", F.col("kind") != "summary")
    one = clean.groupBy(*keys, "_d").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_l"))
    both = one.groupBy(*keys).agg(F.max_by("_l", "_d").alias("_l"), F.max("_d").alias("has_dialogue"))
    return both.select(*keys, "has_dialogue", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"))


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_first = 1").drop("_first")


def best_pack(packs: DataFrame, covers: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The pack that covers most wanted episodes, not for the hearing impaired rather than so, the first listed of equals.

    packs: pack, hi, pos, url; covers: pack, episode; wanted: episode.
    """
    covered = covers.join(wanted.select(*keys, "episode").distinct(), [*keys, "episode"], "left_semi").groupBy(*keys, "pack").agg(F.countDistinct("episode").alias("covered"))
    return first_by(packs.filter(F.col("url") != "").join(covered, [*keys, "pack"]), keys, F.desc("covered"), F.coalesce("hi", F.lit(False)), "pos")


def pack_covers(files: Column, season: Column, first: Column, last: Column, episode: Column, wanted: Column) -> Column:
    """The episodes of a season that a subtitle says it covers: its files', else its range (below 500), else its one."""
    named = F.transform(F.filter(files, lambda f: (F.coalesce(f["season"], season) == wanted) & f["episode"].isNotNull()), lambda f: f["episode"])
    spread = (first <= last) & (last - first < 500)
    own = F.when(season != wanted, F.array().cast("array<int>")).when(F.coalesce(spread, F.lit(False)), F.sequence(first, F.greatest(first, last))).when(episode.isNotNull(), F.array(episode)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(F.size(files), F.lit(0)) > 0, named).otherwise(own)


def best_lyrics(records: DataFrame, keys: list[str], title: str, show: str, runtime: str) -> DataFrame:
    """The record that fits a title: same title first, then plain text, then the nearest length, then the least id."""
    text = F.coalesce(F.nullif(F.col("plain"), F.lit("")), F.nullif(F.col("synced"), F.lit("")))
    fits = ~F.col("instrumental") & text.isNotNull() & (T.same_title(F.col("track"), F.col(title)) | T.contains_words(F.col("track"), F.col(title)))
    named = T.refers_to(F.col("artist"), F.col(show)) | T.refers_to(F.col("album"), F.col(show))
    distance = F.coalesce(F.abs(F.col(runtime) - F.col("duration")), F.lit(1.7976931348623157e308))
    return first_by(records.filter(fits & named), keys, ~T.same_title(F.col("track"), F.col(title)), F.coalesce(F.col("plain"), F.lit("")) == "", distance, "id")


def file_for(files: DataFrame, episodes: DataFrame, show: list[str]) -> DataFrame:
    """The episode of each named file: by its marker, else by the longest title its name holds."""
    marked = files.withColumn("_m", T.episode_marker(F.col("name")))
    keyed = episodes.select(*show, F.col("season").alias("_s"), F.col("number").alias("_n"), "title")
    by_marker = marked.join(keyed, [*show], "inner").filter((F.col("_m.season") == F.col("_s")) & (F.col("_m.episode") == F.col("_n"))).withColumn("_rank", F.lit(0))
    by_title = marked.join(keyed, [*show]).filter(T.contains_words(F.col("name"), F.col("title"))).withColumn("_rank", F.lit(1))
    both = by_marker.unionByName(by_title)
    return first_by(both, [*show, "name"], "_rank", F.desc(F.length("title")), "_s", "_n").select(*show, "name", F.col("_s").alias("season"), F.col("_n").alias("number"))


def musical(episodes: DataFrame, texts: DataFrame, show: list[str]) -> DataFrame:
    """Whether half of a show's episodes, and at least one, have lyrics."""
    lyrics = texts.filter(F.col("kind") == "lyrics").groupBy(*show).agg(F.countDistinct("season", "number").alias("with_lyrics"))
    every = episodes.groupBy(*show).agg(F.countDistinct("season", "number").alias("episodes"))
    n = F.coalesce("with_lyrics", F.lit(0))
    return every.join(lyrics, show, "left").select(*show, ((n > 0) & (2 * n >= F.col("episodes"))).alias("is_musical"))


def scaled_candidates(found: DataFrame, keys: list[str]) -> DataFrame:
    """Search results' scores as shares of the best, within 0..1."""
    top = F.max("score").over(Window.partitionBy(*keys))
    return found.withColumn("score", F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / top))).otherwise(0.0))


def season_filter(episodes: DataFrame, seasons: list[int] | None) -> DataFrame:
    """Episodes of the chosen seasons, all where none is chosen. A choice that leaves none raises."""
    if not seasons:
        return episodes
    kept = episodes.filter(F.col("season").isin(seasons))
    if kept.isEmpty():
        raise ValueError(f"no episode is of the seasons {seasons}")
    return kept


def single_subtitle(subtitles: DataFrame, keys: list[str]) -> DataFrame:
    """The first listed subtitle of each episode that is not for the hearing impaired, else the first."""
    return first_by(subtitles.filter(F.col("url") != ""), keys, F.coalesce("hi", F.lit(False)), "pos")


def season_texts(packs: DataFrame, covers: DataFrame, singles: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Which subtitle serves each wanted episode: the best pack for what it covers, single subtitles for the rest."""
    pack = best_pack(packs, covers, wanted, keys).select(*keys, "pack", "url")
    by_pack = wanted.select(*keys, "episode").distinct().join(covers.select(*keys, "pack", "episode").distinct(), [*keys, "episode"]).join(pack, [*keys, "pack"])
    served = by_pack.select(*keys, "episode", "url", F.lit("pack").alias("via"))
    lacking = wanted.select(*keys, "episode").distinct().join(served, [*keys, "episode"], "left_anti")
    rest = single_subtitle(singles.join(lacking, [*keys, "episode"], "left_semi"), [*keys, "episode"])
    return served.unionByName(rest.select(*keys, "episode", "url", F.lit("single").alias("via")))


def archive_episodes(entries: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """The episode of each archive entry: as listed by its base name (case aside), else by its name's marker; the first entry of an episode serves it.

    entries: pos, name; listed: name, season, episode."""
    base = lambda c: F.lower(T.base_name(F.col(c)))
    told = listed.select(*keys, base("name").alias("_base"), F.struct("season", "episode").alias("_listed")).dropDuplicates([*keys, "_base"])
    found = entries.withColumn("_base", base("name")).join(told, [*keys, "_base"], "left")
    at = F.coalesce("_listed", T.episode_marker(T.base_name(F.col("name"))))
    return first_by(found.select(*keys, "pos", "name", at["season"].alias("season"), at["episode"].alias("episode")).filter("episode is not null"), [*keys, "season", "episode"], "pos")


def flag_guess(found: DataFrame, query: Column, guess: Column) -> DataFrame:
    """Adds `from_folder`: whether what was searched for is the name guessed from the folder, white space and case aside."""
    plain = lambda c: F.lower(F.trim(c))
    return found.withColumn("from_folder", F.coalesce(plain(query) == plain(guess), F.lit(False)))
