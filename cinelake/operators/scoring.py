"""Signals, their combination, ranking and verdicts, as columns and windows. A null signal was not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.config import MATCHING, Matching


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def duration_fit(file_s: Column, runtime_s: Column) -> Column:
    """How well a file's length fits a runtime: within a minute or a tenth, shorter than a broadcast slot, or fading off."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    diff = F.abs(file_s - runtime_s)
    excess = diff - F.greatest(F.lit(60.0), 0.1 * runtime_s)
    slot = (runtime_s >= 1800) & (runtime_s % 1800 < 1) & (file_s >= 0.6 * runtime_s) & (file_s < runtime_s)
    return (
        F.when(~good(runtime_s) | (runtime_s <= 0), None)
        .when(~good(file_s) | (file_s <= 0), 0.0)
        .when(excess <= 0, 1.0)
        .when(slot, 0.9)
        .otherwise(F.exp(-F.pow(excess / (0.2 * runtime_s + 30), 2)))
    )


def combine(dialogue: Column, title: Column, duration: Column, order: Column, gate: Column, music: Column, cfg: Matching = MATCHING) -> Column:
    """Weighted mean of the measured signals. Where the gate holds, a weak identity (dialogue or title) scales it down."""
    title_weight = F.when(music, cfg.weight_title * cfg.music_title_factor).otherwise(cfg.weight_title)
    parts = [(dialogue, F.lit(cfg.weight_dialogue)), (title, title_weight), (duration, F.lit(cfg.weight_duration)), (order, F.lit(cfg.weight_order))]
    total = sum((F.coalesce(w * s, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    mean = F.when(weight > 0, total / weight).otherwise(0.0)
    named = F.when(title >= cfg.identity_title, title).otherwise(0.0)
    identity = F.least(F.lit(1.0), F.greatest(dialogue, F.coalesce(named, F.lit(0.0))) / cfg.identity_dialogue)
    return _clamp(mean * F.when(gate & dialogue.isNotNull(), identity).otherwise(1.0))


def heard_gate(n_words: Column, n_content: Column, best_title: Column, dialogue: Column, title: Column, cfg: Matching = MATCHING) -> tuple[Column, Column]:
    """(dialogue, title) as far as enough was heard to measure them. best_title: the file's best title score over all episodes; where one
    was heard, the others' count as 0 even if little else was. Without any word a title is not measured."""
    enough = n_content >= cfg.min_content_words
    told = F.when((n_words > 0) & (enough | (F.coalesce(best_title, F.lit(0.0)) > 0)), F.coalesce(title, F.lit(0.0)))
    return F.when(enough, dialogue), told


def input_problems(files: DataFrame, positions: DataFrame, job: str = "job_id") -> DataFrame:
    """problem, file_id of what a job cannot be matched with: files listed twice, and places on the disc of files not listed."""
    twice = files.groupBy(job, "file_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(job, F.lit("listedTwice").alias("problem"), "file_id")
    unknown = positions.select(job, "file_id").distinct().join(files.select(job, "file_id"), [job, "file_id"], "left_anti")
    return twice.unionByName(unknown.select(job, F.lit("unknownInOrder").alias("problem"), "file_id"))


def play_all_match(found: DataFrame, keys: list[str]) -> DataFrame:
    """The result row of each play-all file: certain, and without candidates."""
    return found.filter("is_play_all").select(*keys, "file_id", F.lit("PlayAll").alias("verdict"), F.lit(1.0).alias("score"), F.lit(1.0).alias("margin"))


def missing_titles(scans: DataFrame) -> DataFrame:
    """Adds `warning` to scans (n_candidates, n_chapters, matched): the disc's play-all has more chapters than there are files, though half of these are its chapters."""
    few = (F.col("n_chapters") > F.col("n_candidates")) & (2 * F.col("matched") >= F.col("n_candidates"))
    return scans.withColumn("warning", F.when(few, "missingShortTitles"))


def chapter_pairs(chapters: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters and files of like length (within 2 s or 1 %), with how far they are off.

    A band join by buckets of the logarithm of the length: a file meets the chapters of the few buckets that its band touches."""
    # lengths below a minute share a bucket
    bucket = lambda c: F.floor(F.log(F.greatest(c, F.lit(60.0))) / F.log(F.lit(1.05))).cast("int")
    band = F.greatest(F.lit(2.0), 0.01 * F.col("duration_s"))
    near = files.withColumn("_b", F.explode(F.sequence(bucket(F.col("duration_s") - band), bucket(F.col("duration_s") + band))))
    met = chapters.withColumn("_b", bucket(F.col("chapter_s"))).join(near, [*keys, "_b"]).withColumn("off", F.abs(F.col("chapter_s") - F.col("duration_s")))
    return met.filter(F.col("off") <= F.greatest(F.lit(2.0), 0.01 * F.col("duration_s"))).drop("_b")


def matching_count(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """matched: how many chapters (chapter_no) and files (other_id) pair off one to one, the closest lengths (off) first. A disc's pairs are few:
    they are walked within its row."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    listed = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("off", "chapter_no", "other_id", name("c", "chapter_no").alias("c"), name("f", "other_id").alias("f")))).alias("_pairs"))
    none = F.array().cast("array<string>")
    taken = F.aggregate("_pairs", none, lambda seen, x: F.when(F.array_contains(seen, x["c"]) | F.array_contains(seen, x["f"]), seen).otherwise(F.concat(seen, F.array(x["c"], x["f"]))))
    return listed.select(*keys, (F.size(taken) / 2).cast("int").alias("matched"))


def identity_support(dialogue: Column, title: Column, cfg: Matching = MATCHING) -> Column:
    return F.coalesce(dialogue >= cfg.identity_dialogue, F.lit(False)) | F.coalesce(title >= cfg.identity_title, F.lit(False))


def ranked(scores: DataFrame, file_keys: list[str], episode: str, cfg: Matching = MATCHING) -> DataFrame:
    """place of each candidate (from 1), and runner_up: the best other score, or that of no episode."""
    best = Window.partitionBy(*file_keys).orderBy(F.desc("score"), episode)
    every = Window.partitionBy(*file_keys)
    top = scores.withColumn("place", F.row_number().over(best))
    first, second = (F.max(F.when(F.col("place") == k, F.col("score"))).over(every) for k in (1, 2))
    other = F.when(F.col("place") == 1, second).otherwise(first)
    return top.withColumn("runner_up", F.greatest(F.coalesce(other, F.lit(cfg.no_episode)), F.lit(cfg.no_episode)))


def verdict(score: Column, runner_up: Column, dialogue: Column, title: Column, cfg: Matching = MATCHING) -> Column:
    """Of a chosen episode: Confident with margin and identity, else Check."""
    return F.when((score - runner_up >= cfg.confident_margin) & identity_support(dialogue, title, cfg), "Confident").otherwise("Check")


def verdict_of_none(best: Column, cfg: Matching = MATCHING) -> Column:
    return F.when(best < cfg.no_episode, "Extra").otherwise("Check")


def needs_listening(verdict_: Column, margin: Column, cfg: Matching = MATCHING) -> Column:
    return (verdict_ == "Check") | ((verdict_ == "Extra") & (margin < cfg.confident_margin))


def top_candidates(ranks: DataFrame, file_keys: list[str], episode: str, assigned: str, cfg: Matching = MATCHING) -> DataFrame:
    """The best five; an assigned episode beyond them takes the last one's place."""
    k = cfg.kept_candidates
    far = F.max(F.when(F.col(episode) == F.col(assigned), F.col("place"))).over(Window.partitionBy(*file_keys))
    keep = (F.col("place") < k) | ((F.col("place") == k) & (F.coalesce("_far", F.lit(0)) <= k)) | (F.col(episode) == F.col(assigned))
    return ranks.withColumn("_far", far).filter(keep).drop("_far")


def disc_slots(positions: DataFrame, job: str = "job_id") -> DataFrame:
    """slot of each located file in play-all order: its rank, plus what chapters or gaps say is missing before it.

    Chapters count where all are known and rise, and every pair of touching files is one chapter apart; a skipped
    chapter is a missing title if the gap holds half an upper-median length for each.
    """
    order = Window.partitionBy(job).orderBy("order_index")
    every = Window.partitionBy(job)
    step = positions.withColumn("_pc", F.lag("chapter").over(order)).withColumn("_pe", F.lag("end_s").over(order)).withColumn("_rank", F.row_number().over(order) - 1)
    first = F.col("_rank") == 0
    jump = F.col("chapter") - F.col("_pc")
    gap = F.col("start_s") - F.col("_pe")
    fits = F.col("chapter").isNotNull() & (first | (F.coalesce(jump > 0, F.lit(False)) & F.coalesce((gap > 3) | (jump == 1), F.lit(False))))
    lengths = F.sort_array(F.collect_list(F.col("end_s") - F.col("start_s")).over(every))
    marked = step.withColumn("_marks", F.min(fits).over(every)).withColumn("_median", F.element_at(lengths, (F.floor(F.size(lengths) / 2) + 1).cast("int")))
    missing = F.when(F.col("_marks") & ~first & (jump > 1) & (gap / (jump - 1) >= F.col("_median") / 2), jump - 1).otherwise(0)
    return marked.withColumn("_missing", missing).withColumn("slot", (F.col("_rank") + F.sum("_missing").over(order)).cast("int")).drop("_pc", "_pe", "_rank", "_marks", "_median", "_missing")


def nearest_anchors(files: DataFrame, job: str = "job_id") -> DataFrame:
    """before, after: the nearest anchors on either side of each file, itself excluded. files: rank, slot, anchor (nullable episode)."""
    order = Window.partitionBy(job).orderBy("rank")
    anchor = F.when(F.col("anchor").isNotNull(), F.struct("anchor", "slot"))
    earlier = F.last(anchor, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(anchor, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return files.withColumn("before", earlier).withColumn("after", later)


def order_signal(episode: Column, slot: Column, before: Column, after: Column) -> Column:
    """Null without anchors; 0 beyond them; 1 if it continues one by the slots between; else 0.6."""
    outside = F.coalesce(episode <= before["anchor"], F.lit(False)) | F.coalesce(episode >= after["anchor"], F.lit(False))
    onward = F.coalesce(episode - before["anchor"] == slot - before["slot"], F.lit(False)) | F.coalesce(after["anchor"] - episode == after["slot"] - slot, F.lit(False))
    return F.when(before.isNull() & after.isNull(), None).when(outside, 0.0).when(onward, 1.0).otherwise(0.6)


def play_all(files: DataFrame, keys: list[str], chapters: DataFrame | None = None) -> DataFrame:
    """The file that holds all others, judged by lengths and, where known, by its chapters (chapter_s; keys, file_id).

    difference: |longest - others| / others; ratio: longest over second; matched: chapters that pair off with other
    files within 2 s or 1 %, closest first.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("duration_s"), "file_id")
    placed = files.withColumn("_n", F.row_number().over(order))
    top = placed.groupBy(*keys).agg(
        F.count("*").alias("candidates"),
        F.max(F.when(F.col("_n") == 1, F.col("file_id"))).alias("file_id"),
        F.max(F.when(F.col("_n") == 1, F.col("duration_s"))).alias("longest_s"),
        F.max(F.when(F.col("_n") == 2, F.col("duration_s"))).alias("second_s"),
        F.sum(F.when(F.col("_n") > 1, F.col("duration_s"))).alias("others_s"),
    )
    top = top.filter("candidates >= 3 and second_s > 0").withColumn("difference", F.abs(F.col("longest_s") - F.col("others_s")) / F.col("others_s")).withColumn("ratio", F.col("longest_s") / F.col("second_s"))
    if chapters is None:
        top = top.withColumn("n_chapters", F.lit(0)).withColumn("matched", F.lit(0))
    else:
        own = chapters.filter("chapter_s > 0").join(top.select(*keys, "file_id"), [*keys, "file_id"]).withColumn("chapter_no", F.row_number().over(Window.partitionBy(*keys).orderBy("chapter_s")))
        pairs = chapter_pairs(own.drop("file_id"), placed.filter("_n > 1").select(*keys, F.col("file_id").alias("other_id"), "duration_s"), keys)
        matched = matching_count(pairs, keys)
        top = top.join(own.groupBy(*keys).agg(F.count("*").cast("int").alias("n_chapters")), keys, "left").join(matched, keys, "left").fillna(0, ["n_chapters", "matched"])
    fraction = F.col("matched") / (F.col("candidates") - 1)
    by_length = F.col("difference") <= 0.25
    by_chapters = (F.col("n_chapters") >= 2) & (fraction >= 0.5) & (F.col("matched") >= 2)
    accepted = ((F.col("ratio") >= 3.0) & (by_length | by_chapters)) | ((F.col("ratio") >= 1.5) & by_length & by_chapters)
    d = _clamp(1 - F.col("difference") / 0.25)
    c = _clamp(fraction)
    confidence = F.when(F.col("n_chapters") >= 2, 0.6 * F.greatest(d, c) + 0.4 * F.least(d, c)).otherwise(0.7 * d)
    return top.withColumn("is_play_all", accepted).withColumn("confidence", confidence)
