"""Heard segments: what a recogniser invented, what of a transcript counts, and how a window joins it."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cinelake.functions import text as T

from . import intervals


@F.pandas_udf(DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """UTF-8 bytes over their zlib-compressed size; 0 for no text."""
    raw = text.fillna("").str.encode("utf-8")
    return raw.map(lambda b: len(b) / len(zlib.compress(b)) if b else 0.0)


def own_reason(text: Column, no_speech: Column, logprob: Column, ratio: Column, limit: float = 2.4) -> Column:
    """Why a segment on its own does not count; null if it does."""
    return (
        F.when(T.is_known_hallucination(T.normalize_heard(text)), "knownHallucination")
        .when(ratio > limit, "highCompressionRatio")
        .when(T.is_sound_description(text) | ((no_speech > 0.6) & (logprob < -1.0)), "noSpeech")
    )


def mark(segments: DataFrame, keys: list[str], order: list[str], ratio: Column | None = None) -> DataFrame:
    """filtered of each segment: a reason given before, its own, or that it repeats the last one with any letters."""
    norm = T.normalize_heard(F.coalesce(F.col("text"), F.lit("")))
    before = F.last(F.nullif(F.col("_norm"), F.lit("")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    own = own_reason(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"), ratio if ratio is not None else compression_ratio(F.trim("text")))
    repeat = F.when((F.col("_norm") != "") & (F.col("_norm") == F.col("_prev")), "repeated")
    return segments.withColumn("_norm", norm).withColumn("_prev", before).withColumn("filtered", F.coalesce("filtered", own, repeat)).drop("_norm", "_prev")


def matching_text(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """text of each file: its segments that count, trimmed, in order, space-joined. A file's segments are bounded by its length."""
    kept = segments.filter(F.col("filtered").isNull()).withColumn("_t", F.trim("text")).filter("_t != ''")
    listed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col("_t").alias("t")))).alias("l"))
    return listed.select(*keys, F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def mostly_music(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Whether more than half of a file's segments are no speech or carry a note."""
    music = (F.col("filtered") == "noSpeech") | F.contains(F.col("text"), F.lit("♪"))
    return segments.groupBy(*keys).agg((2 * F.count_if(F.coalesce(music, F.lit(False))) > F.count("*")).alias("mostly_music"))


def add_window(segments: DataFrame, fresh: DataFrame, windows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All segments marked anew in order, and all windows merged."""
    every = segments.unionByName(fresh).withColumn("filtered", F.lit(None).cast("string"))
    return mark(every, keys, ["start_s", "end_s", "text"]), intervals.merge_windows(windows, keys)


def heard_srt(segments: DataFrame, keys: list[str]) -> DataFrame:
    """srt of each file: its segments that count, numbered from 1."""
    kept = segments.filter(F.col("filtered").isNull()).withColumn("_t", F.trim("text")).filter("_t != ''")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "end_s", "_t"))
    cue = F.concat(F.col("_n").cast("string"), F.lit("\n"), T.srt_time(F.col("start_s")), F.lit(" --> "), T.srt_time(F.greatest("start_s", "end_s")), F.lit("\n"), F.col("_t"), F.lit("\n"))
    numbered = kept.withColumn("_n", n).withColumn("_c", cue)
    return numbered.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_c"))), lambda x: x["_c"]), "\n").alias("srt"))


def finish(cues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cues with a letter or digit, runs that differ in case alone once."""
    worded = cues.filter(F.col("cue").rlike(r"[\p{L}\p{N}]"))
    before = F.lag(F.lower("cue")).over(Window.partitionBy(*keys).orderBy(*order))
    return worded.withColumn("_p", before).filter("_p is null or _p != lower(cue)").drop("_p")


def unusable(failed: Column, embedded: Column, n_segments: Column) -> Column:
    """A file of which nothing is known: it failed, and neither embedded text nor segments are there."""
    return failed & (F.coalesce(F.trim(embedded), F.lit("")) == "") & (F.coalesce(n_segments, F.lit(0)) == 0)


def sampled_windows(duration: Column, covered: Column, n_windows: Column) -> Column:
    """How many windows a long file was sampled by; null if it was heard whole."""
    return F.when((duration > 360) & (covered + 1 < duration), n_windows)


def heard_text(embedded: Column, transcript: Column) -> Column:
    """What a file says: its embedded subtitles where they aren't blank, else what was heard."""
    return F.coalesce(F.when(F.trim(embedded) != "", embedded), transcript)


def average_logprob(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """avg_logprob of each segment over its text tokens; 0 without any. tokens: logprob, is_text."""
    return tokens.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("is_text"), F.col("logprob"))), F.lit(0.0)).alias("avg_logprob"))
