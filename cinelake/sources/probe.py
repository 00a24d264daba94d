"""Landed file probes: JSON to typed rows, roles, and the choice of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import text as T

PROBE_JSON = """format struct<format_name string, duration string>,
streams array<struct<`index` int, codec_name string, codec_type string, width int, height int, sample_rate string, channels int, duration string, disposition map<string, bigint>, tags map<string, string>>>,
chapters array<struct<start_time string, end_time string, tags map<string, string>>>"""


def _tag(tags: Column, name: str) -> Column:
    found = F.map_values(F.map_filter(tags, lambda k, _: F.lower(k) == name))
    return F.nullif(F.trim(F.try_element_at(found, F.lit(1))), F.lit(""))


def _language(tags: Column) -> Column:
    code = _tag(tags, "language")
    return F.when(F.lower(code) != "und", code)


def parse(raw: Column) -> Column:
    """struct(duration_s, container, video, audio_streams, subtitle_streams, chapters) of probe JSON; duration_s null if there is none."""
    j = F.from_json(raw, PROBE_JSON)
    positive = lambda c: F.when((c > 0) & (c < float("inf")), c)
    streams = F.coalesce(j["streams"], F.array().cast(_streams_type()))
    lengths = F.transform(streams, lambda s: F.greatest(positive(T.parse_clock(s["duration"])), positive(T.parse_clock(_tag(s["tags"], "duration")))))
    times = F.transform(
        F.coalesce(j["chapters"], F.array().cast("array<struct<start_time:string,end_time:string,tags:map<string,string>>>")),
        lambda c: F.struct(T.parse_clock(c["start_time"]).alias("start_s"), T.parse_clock(c["end_time"]).alias("end_s"), _tag(c["tags"], "title").alias("title")),
    )
    chapters = F.transform(F.array_sort(times), lambda c, i: F.struct(i.alias("index"), c["start_s"], c["end_s"], c["title"]))
    duration = F.coalesce(positive(j["format"]["duration"].try_cast("double")), F.array_max(lengths), positive(F.array_max(F.transform(times, lambda c: c["end_s"]))))
    picture = lambda s: F.coalesce(F.try_element_at(s["disposition"], F.lit("attached_pic")) == 1, F.lit(False))
    video = F.try_element_at(F.filter(streams, lambda s: (s["codec_type"] == "video") & ~picture(s) & (s["width"] > 0) & (s["height"] > 0)), F.lit(1))
    flag = lambda s, name: F.coalesce(F.try_element_at(s["disposition"], F.lit(name)) == 1, F.lit(False))
    audio = F.transform(F.filter(streams, lambda s: s["codec_type"] == "audio"), lambda s: F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), s["channels"].alias("channels"), _language(s["tags"]).alias("language"), flag(s, "default").alias("default")))
    subtitles = F.transform(F.filter(streams, lambda s: s["codec_type"] == "subtitle"), lambda s: F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), _language(s["tags"]).alias("language"), flag(s, "default").alias("default")))
    return F.struct(duration.alias("duration_s"), j["format"]["format_name"].alias("container"), F.when(video.isNotNull(), F.struct(video["width"].alias("width"), video["height"].alias("height"))).alias("video"), audio.alias("audio_streams"), subtitles.alias("subtitle_streams"), chapters.alias("chapters"))


def _streams_type() -> str:
    return "array<struct<`index`:int,codec_name:string,codec_type:string,width:int,height:int,sample_rate:string,channels:int,duration:string,disposition:map<string,bigint>,tags:map<string,string>>>"


def role(failed: Column, probe: Column) -> tuple[Column, Column]:
    """(role, warning) of a probed file."""
    silent = F.size(probe["audio_streams"]) == 0
    short = probe["duration_s"] < 20
    bad = failed | probe["duration_s"].isNull()
    kind = F.when(bad | silent | short, "ignored").otherwise("candidate")
    return kind, F.when(bad, "unreadable").when(silent, "noAudio")


def scan(files: DataFrame, probes: DataFrame, folder: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, summary) of a scanned folder: its listed files with duration, streams, role and warning, the play-all among them found by lengths; and one row with
    the play-all, the number of candidates, the show that the folder is named after and how many warnings there are.

    files: path relative to the folder; probes: path, raw (probe JSON, null where probing failed)."""
    from cinelake.functions import naming
    from cinelake.operators import scoring

    probed = listed(files, recursive).join(probes, "path", "left").withColumn("p", parse(F.col("raw")))
    kind, warning = role(F.col("raw").isNull(), F.col("p"))
    told = probed.select(F.col("path").alias("file_id"), F.col("p.duration_s").alias("duration_s"), F.size("p.chapters").alias("n_chapters"), kind.alias("role"), warning.alias("warning"), F.lit(0).alias("_one"))
    found = scoring.play_all(told.filter("role = 'candidate'"), ["_one"]).filter("is_play_all").select("file_id", F.lit(True).alias("_all"))
    told = told.join(found, "file_id", "left").withColumn("role", F.when(F.col("_all"), "playAll").otherwise(F.col("role"))).drop("_all", "_one")
    summary = told.agg(F.max(F.when(F.col("role") == "playAll", F.col("file_id"))).alias("play_all"), F.count_if(F.col("role") == "candidate").alias("n_candidates"), F.count("warning").alias("n_warnings"))
    return told, summary.withColumn("show_guess", F.lit(naming.guess_show(folder)))


def listed(files: DataFrame, recursive: bool = False) -> DataFrame:
    """Video files of a listing (path relative to its root): none that is hidden or in a disc structure, by id."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    disc = F.exists(parts, lambda p: F.upper(p).isin("VIDEO_TS", "BDMV"))
    deep = F.lit(True) if recursive else F.size(parts) == 1
    return files.filter(T.has_video_extension(F.col("path")) & ~hidden & ~disc & deep)


def disc_folders(files: DataFrame) -> DataFrame:
    """folder, format of every disc structure: named so, or holding its index file."""
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name, index = F.upper(T.base_name(parent)), F.upper(T.base_name(F.col("path")))
    kind = F.when((name == "VIDEO_TS") | (index == "VIDEO_TS.IFO"), "dvd").when((name == "BDMV") | (index == "INDEX.BDMV"), "bluRay")
    return files.select(parent.alias("folder"), kind.alias("format")).filter("format is not null").distinct()


def choose_audio(streams: Column, language: Column) -> Column:
    """The index of the stream to listen to: of the language, else the default, else the first."""
    return F.array_min(F.transform(streams, lambda s: F.struct((~T.languages_match(s["language"], language)).alias("a"), (~s["default"]).alias("b"), s["index"].alias("index"))))["index"]


def embedded_choice(streams: Column, language: Column) -> Column:
    """The first text subtitle stream of unknown or fitting language."""
    text = ("subrip", "ass", "ssa", "webvtt", "mov_text", "text")
    return F.try_element_at(F.filter(streams, lambda s: s["codec"].isin(*text) & (s["language"].isNull() | T.languages_match(s["language"], language))), F.lit(1))["index"]
