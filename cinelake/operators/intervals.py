"""Intervals of listening: merging, gaps, planning and cost. All native; a file's intervals are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.config import SAMPLING, Sampling


def finite(*columns: str) -> Column:
    """Neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return out


def merge_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (start_s, end_s) that overlap or touch become one; those with bounds that are not finite go."""
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start_s") > reach), 1).otherwise(0)
    island = windows.filter(finite("start_s", "end_s")).withColumn("_new", opened).withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(*keys, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_island")


def covered_seconds(windows: DataFrame, keys: list[str]) -> DataFrame:
    """covered_s: the length of all merged intervals."""
    return merge_windows(windows, keys).groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("covered_s"))


def gaps(files: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches of [0, duration_s] that no interval of `done` covers, clamped, of positive length."""
    clamped = (
        done.join(files.select(*keys, "duration_s"), keys)
        .select(*keys, F.greatest(F.col("start_s"), F.lit(0.0)).alias("start_s"), F.least("end_s", "duration_s").alias("end_s"))
        .filter("end_s > start_s")
    )
    # a sentinel of no length at either end turns the two outer gaps into inner ones
    edges = files.select(*keys, F.explode(F.array(F.lit(0.0), F.col("duration_s"))).alias("start_s")).withColumn("end_s", F.col("start_s"))
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    whole = merge_windows(clamped.unionByName(edges), keys)
    return whole.select(*keys, F.lag("end_s").over(order).alias("gap_start"), F.col("start_s").alias("gap_end")).filter("gap_end > gap_start").select(*keys, F.col("gap_start").alias("start_s"), F.col("gap_end").alias("end_s"))


def plan_windows(files: DataFrame, keys: list[str], cfg: Sampling = SAMPLING) -> DataFrame:
    """What to listen to first: a short file whole, else windows centred at set shares of it, shifted inside and merged."""
    d = F.col("duration_s")
    usable = files.filter(finite("duration_s") & (d > 0)).select(*keys, "duration_s")
    whole = usable.filter(d <= cfg.whole_s).select(*keys, F.lit(0.0).alias("start_s"), d.alias("end_s"))
    centre = F.explode(F.array(*[F.lit(p) for p in cfg.positions]))
    start = F.greatest(F.lit(0.0), F.least(F.col("share") * d - cfg.window_s / 2, d - cfg.window_s))
    some = usable.filter(d > cfg.whole_s).withColumn("share", centre).select(*keys, start.alias("start_s"), (start + cfg.window_s).alias("end_s"))
    return whole.unionByName(merge_windows(some, keys))


def escalation_windows(files: DataFrame, done: DataFrame, keys: list[str], whole_file: bool = False, cfg: Sampling = SAMPLING) -> DataFrame:
    """What to listen to next. whole_file: every gap. Else a window in the middle of each inner gap worth it, or of the
    outer ones where there is no such gap; a file not yet listened to is planned afresh."""
    usable = files.filter(finite("duration_s") & (F.col("duration_s") > 0)).select(*keys, "duration_s")
    g = gaps(usable, done, keys).join(usable, keys).withColumn("length", F.col("end_s") - F.col("start_s"))
    if whole_file:
        return g.filter(F.col("length") >= cfg.whole_gap_s).select(*keys, "start_s", "end_s")
    begun = usable.join(done.select(*keys).distinct(), keys, "left_semi").select(*keys)
    inner = (F.col("start_s") > 0) & (F.col("end_s") < F.col("duration_s"))
    some = g.join(begun, keys, "left_semi").filter(F.col("length") >= cfg.min_gap_s).withColumn("_inner", inner)
    chosen = some.withColumn("_any", F.max("_inner").over(Window.partitionBy(*keys))).filter(F.col("_inner") == F.col("_any"))
    middle, half = (F.col("start_s") + F.col("end_s")) / 2, F.least("length", F.lit(cfg.window_s)) / 2
    fresh = plan_windows(usable.join(begun, keys, "left_anti"), keys, cfg)
    return chosen.select(*keys, (middle - half).alias("start_s"), (middle + half).alias("end_s")).unionByName(fresh)


def audio_cost(windows: DataFrame, keys: list[str], least_s: float = 30.0) -> DataFrame:
    """cost_s: transcription work of the intervals; each of positive length counts as `least_s` at least."""
    length = F.col("end_s") - F.col("start_s")
    return windows.groupBy(*keys).agg(F.sum(F.when(length > 0, F.greatest(length, F.lit(least_s))).otherwise(0.0)).alias("cost_s"))


def speed(runs: DataFrame, keys: list[str], prior: float, weight_s: float = 60.0) -> DataFrame:
    """Audio seconds a second after all runs (audio_s, compute_s), starting from a prior of `weight_s` of audio."""
    return runs.groupBy(*keys).agg(((F.lit(weight_s) + F.sum("audio_s")) / (F.lit(weight_s / prior) + F.sum("compute_s"))).alias("speed"))


def prior_speed(accelerated: Column, model: Column) -> Column:
    """Audio seconds a second that a job starts from, until its own runs tell."""
    # By processor and model.
    fast = model == "fast"
    return F.when(accelerated, F.when(fast, 40.0).otherwise(15.0)).otherwise(F.when(fast, 4.0).otherwise(1.0))


def use_vad(duration: Column, mostly_music: Column, cfg: Sampling = SAMPLING) -> Column:
    """Whether speech detection pays: a long file that is not music."""
    return F.coalesce(~mostly_music & ~F.isnan(duration) & (F.abs(duration) != float("inf")) & (duration > cfg.whole_s), F.lit(False))


def speech_layout(regions: DataFrame, keys: list[str], join_s: float = 0.3, separator_s: float = 0.2) -> DataFrame:
    """Speech regions joined where less than `join_s` parts them, each with its place in the speech-only audio."""
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_s") - reach >= join_s), 1).otherwise(0)
    joined = regions.filter(finite("start_s", "end_s") & (F.col("end_s") > F.col("start_s"))).withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    merged = joined.groupBy(*keys, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_island")
    before = F.sum(F.col("end_s") - F.col("start_s") + separator_s).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return merged.withColumn("joined_start_s", F.coalesce(before, F.lit(0.0)))


def to_original(times: DataFrame, layout: DataFrame, keys: list[str]) -> DataFrame:
    """original_s of each time (at_s) in the speech-only audio: an as-of lookup; a separator maps to the end before it."""
    marks = layout.select(*keys, F.col("joined_start_s").alias("at_s"), F.struct("start_s", "end_s", "joined_start_s").alias("region"), F.lit(0).alias("kind"))
    asked = times.select(*keys, "at_s", F.lit(None).cast(marks.schema["region"].dataType).alias("region"), F.lit(1).alias("kind"))
    order = Window.partitionBy(*keys).orderBy("at_s", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("region", F.last("region", ignorenulls=True).over(order)).filter("kind = 1")
    inside = F.col("region.start_s") + F.greatest(F.lit(0.0), F.col("at_s") - F.col("region.joined_start_s"))
    return found.select(*keys, "at_s", F.least(inside, F.col("region.end_s")).alias("original_s"))
