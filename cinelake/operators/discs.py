"""Where files lie in their disc's play-all: overlaps, chapters and the order they tell, by job.

located: job, file_id, offset_s, length_s, score; chapters: job, chapter, start_s, end_s.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import audio


def overlapping(located: DataFrame, job: str = "job_id", more_than_s: float = 2.0) -> DataFrame:
    """a, b, shared_s: files (a < b) that share more than `more_than_s` of the play-all. A job's files are few; its pairs are made within it."""
    side = lambda n: located.select(job, F.col("file_id").alias(n), F.col("offset_s").alias(f"_{n}0"), (F.col("offset_s") + F.col("length_s")).alias(f"_{n}1"))
    shared = F.least("_a1", "_b1") - F.greatest("_a0", "_b0")
    return side("a").join(side("b"), job).filter("a < b").withColumn("shared_s", shared).filter(F.col("shared_s") > more_than_s).select(job, "a", "b", "shared_s")


def on_chapters(located: DataFrame, chapters: DataFrame, job: str = "job_id") -> DataFrame:
    """Files that start where a chapter starts, within 3 s or 2 % of their length."""
    starts = chapters.select(job, F.col("start_s").alias("_start"))
    near = F.abs(F.col("offset_s") - F.col("_start")) <= F.greatest(F.lit(3.0), 0.02 * F.col("length_s"))
    return located.join(starts, (located[job] == starts[job]) & near, "left_semi")


def containing_chapter(located: DataFrame, chapters: DataFrame, job: str = "job_id") -> DataFrame:
    """Adds `chapter`: the first that holds a point a second (or half its length) into the file; null in none.

    An as-of lookup where chapters lie one after another: of a job's points and starts in order, the last start is the candidate."""
    probe = F.col("offset_s") + F.least(F.col("length_s") / 2, F.lit(1.0))
    marks = chapters.select(job, F.col("start_s").alias("_at"), F.lit(0).alias("_kind"), F.struct("chapter", "end_s").alias("_held"), F.lit(None).cast(located.schema["file_id"].dataType).alias("file_id"))
    points = located.select(job, probe.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_held"].dataType).alias("_held"), "file_id")
    order = Window.partitionBy(job).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(points).withColumn("_held", F.last("_held", ignorenulls=True).over(order)).filter("_kind = 1")
    told = found.select(job, "file_id", F.when(F.col("_at") < F.col("_held.end_s"), F.col("_held.chapter")).alias("chapter"))
    return located.join(told, [job, "file_id"], "left")


def derive_order(located: DataFrame, chapters: DataFrame, given: DataFrame, job: str = "job_id") -> DataFrame:
    """job, file_id, offset_s, length_s, score, order_index, chapter, problem: the files that keep a place, in order, and what is wrong with a job's order, if
    anything. given: job, n_files. Which of two files keeps a place depends on those before; a job's files and chapters meet in one kernel call."""
    kinds = dict(located.dtypes)
    marks = chapters.groupBy(job).agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("_chapters"))
    rows = located.join(given.select(job, F.col("n_files").alias("_given")), job).join(marks, job, "left")

    columns = [job, "file_id", "offset_s", "length_s", "score", "_given", "_chapters"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition's jobs lie one after another; a job is small and is held until its last row
        at, held, out = None, [], []

        def solve() -> None:
            if held:
                chapters = [(c["start_s"], c["end_s"]) for c in (held[0][6] if held[0][6] is not None else [])]
                kept, problem = audio.kept_in_order([audio.Placed(*r[1:5]) for r in held], chapters, int(held[0][5]))
                out.extend((at, *r, problem) for r in kept)

        frame = lambda: pd.DataFrame(out, columns=[job, "file_id", "offset_s", "length_s", "score", "order_index", "chapter", "problem"]).astype({"chapter": "Int64"})
        for b in batches:
            for row in b[columns].itertuples(index=False, name=None):
                if row[0] != at:
                    solve()
                    at, held = row[0], []
                held.append(row)
            if out:
                yield frame()
                out = []
        solve()
        if out:
            yield frame()

    schema = f"{job} {kinds[job]}, file_id {kinds['file_id']}, offset_s double, length_s double, score double, order_index int, chapter int, problem string"
    return rows.repartition(job).sortWithinPartitions(job, "file_id").mapInPandas(run, schema)
