"""Rename plans: placement, conflicts, review and export rows. Nothing here touches a disk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cinelake.functions import naming
from cinelake.functions import text as T


def review(verdict: Column) -> tuple[Column, Column]:
    """(kind, approved) that a file starts with: confident ones approved, extras not an episode, the rest pending."""
    kind = F.when(verdict == "Confident", "approved").when(verdict == "Extra", "notAnEpisode").otherwise("pending")
    return kind, verdict.isin("Confident", "Extra")


def category(matched: Column, suggestion: Column, choice: Column, approved: Column) -> Column:
    """How a file shows in the review: waiting, playAll, skipped, check, extra or approved."""
    return (
        F.when(~matched, "waiting")
        .when(suggestion == "playAll", "playAll")
        .when(choice.isNull(), "waiting")
        .when(choice == "skip", "skipped")
        .when(~approved, "check")
        .when(choice == "notAnEpisode", "extra")
        .otherwise("approved")
    )


def in_filter(category_: Column, chosen: str) -> Column:
    return F.lit(True) if chosen == "all" else category_ == {"extras": "extra"}.get(chosen, chosen)


def category_counts(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Files of each category, none as 0."""
    kinds = ["approved", "check", "extra", "skipped", "playAll", "waiting"]
    return reviews.groupBy(*keys).agg(*(F.count_if(F.col("category") == k).alias(k) for k in kinds))


def with_initial(reviews: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews of all matches: the user's where there is one, else what the verdict starts with. The play-all has none."""
    kind, approved = review(F.col("verdict"))
    fresh = matches.filter("verdict != 'PlayAll'").select(*keys, kind.alias("_c"), approved.alias("_a"))
    return fresh.join(reviews, keys, "full").select(*keys, F.coalesce("choice", "_c").alias("choice"), F.coalesce("approved", "_a").alias("approved"))


def placements(files: DataFrame, decisions: DataFrame, matches: DataFrame, episodes: DataFrame, job: str = "job_id") -> DataFrame:
    """outcome of each file: item (with its episode) or why it stays: playAll, skipped or extra. An unknown approved episode raises."""
    told = (
        files.join(decisions.select(job, "file_id", "decision", "season", "number"), [job, "file_id"], "left")
        .join(matches.select(job, "file_id", "verdict"), [job, "file_id"], "left")
        .join(episodes.select(job, "season", "number", "title"), [job, "season", "number"], "left")
    )
    outcome = (
        F.when((F.col("role") == "playAll") | F.coalesce(F.col("verdict") == "PlayAll", F.lit(False)), "playAll")
        .when(F.col("role") == "ignored", "skipped")
        .when(F.col("decision") == "approved", F.when(F.col("title").isNull(), F.raise_error(F.lit("an approved episode is not in the list"))).otherwise("item"))
        .when(F.col("decision") == "notAnEpisode", "extra")
        .when(F.col("decision").isNotNull(), "skipped")
        .when(F.col("verdict") == "Extra", "extra")
        .otherwise("skipped")
    )
    return told.withColumn("outcome", outcome)


def conflicts(items: DataFrame, disk: DataFrame, move: bool, job: str = "job_id") -> DataFrame:
    """ord, kind, path, file_ids: sources that changed, targets that coincide (case aside), targets there already.

    items: file_id, from, to, size_bytes; disk: path, size_bytes. With `move` a target that is another item's source is free.
    """
    fold = lambda c: F.lower(F.col(c))
    sizes = disk.select(job, F.col("path").alias("from"), F.col("size_bytes").alias("now"))
    changed = items.join(sizes, [job, "from"], "left").filter(~F.col("now").eqNullSafe(F.col("size_bytes"))).select(job, F.lit(0).alias("ord"), F.lit("sourceChanged").alias("kind"), F.col("from").alias("path"), F.array("file_id").alias("file_ids"))
    keyed = items.withColumn("_to", fold("to")).withColumn("_from", fold("from"))
    same = keyed.groupBy(job, "_to").agg(F.count("*").alias("n"), F.min("to").alias("path"), F.sort_array(F.collect_list("file_id")).alias("file_ids")).filter("n > 1")
    doubled = same.select(job, F.lit(1).alias("ord"), F.lit("duplicateTarget").alias("kind"), "path", "file_ids")
    there = keyed.filter("_from != _to").join(same.select(job, "_to"), [job, "_to"], "left_anti").join(disk.select(job, F.lower("path").alias("_to")).distinct(), [job, "_to"], "left_semi")
    if move:
        there = there.join(keyed.select(job, F.col("_from").alias("_to")).distinct(), [job, "_to"], "left_anti")
    taken = there.select(job, F.lit(2).alias("ord"), F.lit("targetExists").alias("kind"), F.col("to").alias("path"), F.array("file_id").alias("file_ids"))
    return changed.unionByName(doubled).unionByName(taken)


def csv_rows(placed: DataFrame, job: str = "job_id") -> DataFrame:
    """The six text columns of an exported list, cells made safe for spreadsheets. placed: outcome, new_name."""
    item = F.col("outcome") == "item"
    status = F.when(item, "episode").when(F.col("outcome") == "playAll", "play-all").otherwise(F.col("outcome"))
    cell = lambda c: F.coalesce(F.when(item, F.col(c).cast("string")), F.lit(""))
    rows = {"file": F.col("file_id").cast("string"), "status": status, "season": cell("season"), "episode": cell("number"), "title": cell("title"), "new_name": cell("new_name")}
    return placed.select(job, *(T.as_text(v).alias(k) for k, v in rows.items()))


def plan_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one of two plans has more often than the other, with `change`: gone or new."""
    return old.exceptAll(new).withColumn("change", F.lit("gone")).unionByName(new.exceptAll(old).withColumn("change", F.lit("new")))


def same_plan(old: DataFrame, new: DataFrame) -> bool:
    """Whether a plan still is what it was: no row of either lacks in the other."""
    return plan_changes(old, new).isEmpty()


def shared_episodes(decisions: DataFrame, job: str = "job_id") -> DataFrame:
    """For each file, the others that chose its episode."""
    chosen = decisions.filter("decision = 'approved'").select(job, "season", "number", "file_id")
    groups = chosen.groupBy(job, "season", "number").agg(F.collect_set("file_id").alias("all"))
    return chosen.join(groups, [job, "season", "number"]).select(job, "file_id", F.sort_array(F.array_except("all", F.array("file_id"))).alias("others"))


def preview_tree(items: DataFrame, job: str = "job_id") -> DataFrame:
    """line rows of a preview: a folder when it differs from the row before, then the file. items: to (relative)."""
    from pyspark.sql import Window

    rows = items.withColumn("folder", F.regexp_extract("to", "^(.*)/[^/]*$", 1)).withColumn("name", T.base_name(F.col("to")))
    before = F.lag("folder").over(Window.partitionBy(job).orderBy("to"))
    new = before.isNull() | (before != F.col("folder"))
    lines = rows.withColumn("_l", F.when(new & (F.col("folder") != ""), F.array(F.struct(F.lit(0).alias("depth"), F.col("folder").alias("line")), F.struct(F.lit(1).alias("depth"), F.col("name").alias("line")))).otherwise(F.array(F.struct(F.lit(1).alias("depth"), F.col("name").alias("line")))))
    return lines.select(job, "to", F.posexplode("_l").alias("pos", "l")).select(job, "to", "pos", "l.depth", "l.line")


def next_to_review(items: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The next index that needs a check after `at`, going round; else the next one."""
    pending = F.col("category") == "check"
    after, before = F.min(F.when(pending & (F.col("idx") > at), F.col("idx"))), F.min(F.when(pending & (F.col("idx") < at), F.col("idx")))
    return items.groupBy(*keys).agg(F.coalesce(after, before, F.least(F.max(at) + 1, F.max("idx"))).alias("next_idx"))


def recent_jobs(jobs: DataFrame, matches: DataFrame, limit: int = 20) -> DataFrame:
    """The jobs that finished last: files but the play-all, and those to review unless the job was saved.

    jobs: job_id, finished_ms (null while it runs), saved; matches: job_id, verdict. Only the last are joined with their matches."""
    last = jobs.filter("finished_ms is not null").orderBy(F.desc("finished_ms"), F.desc("job_id")).limit(limit)
    files = matches.join(F.broadcast(last.select("job_id")), "job_id", "left_semi").groupBy("job_id").agg(F.count_if(F.col("verdict") != "PlayAll").alias("file_count"), F.count_if(F.col("verdict") == "Check").alias("_check"))
    told = last.join(files, "job_id", "left")
    return told.select("job_id", "finished_ms", "saved", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.when(F.col("saved"), 0).otherwise(F.coalesce("_check", F.lit(0))).cast("bigint").alias("to_review"))


def build_plan(files: DataFrame, decisions: DataFrame, matches: DataFrame, episodes: DataFrame, show: tuple[str, int | None], scheme: str, root: str, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """(items by target path, files that stay with the reason) of a rename. files: file_id, path, role, size_bytes."""
    name, year = show

    @F.pandas_udf(StringType())
    def rendered(season: pd.Series, number: pd.Series, title: pd.Series, ext: pd.Series) -> pd.Series:
        rows = zip(season, number, title, ext, strict=True)
        return pd.Series([None if pd.isna(s) or pd.isna(n) else naming.render(scheme, name, year, int(s), int(n), t, e) for s, n, t, e in rows])

    placed = placements(files, decisions, matches, episodes, job)
    item = F.col("outcome") == "item"
    to = F.concat(F.lit(root.rstrip("/") + "/"), rendered(F.when(item, F.col("season")), F.col("number"), F.col("title"), T.extension(F.col("path"))))
    items = placed.filter(item).select(job, "file_id", F.col("path").alias("from"), to.alias("to"), "season", "number", "title", "size_bytes").orderBy(job, "to")
    return items, placed.filter(~item).select(job, "file_id", "path", F.col("outcome").alias("reason"))


def file_progress(matches: DataFrame, keys: list[str]) -> DataFrame:
    """How many files but the play-all there are, and how many are done."""
    counted = F.col("verdict").isNull() | (F.col("verdict") != "PlayAll")
    return matches.groupBy(*keys).agg(F.count_if(counted & F.col("status").isin("done", "failed")).alias("done"), F.count_if(counted).alias("total"))
