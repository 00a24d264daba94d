"""State folds of event logs, as batch aggregates and as streams, and journal replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_events(events: DataFrame, keys: list[str], state: list[str], seq: str) -> DataFrame:
    """The last known value of each state column by key: the latest event that carries one wins."""
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in state]
    return events.groupBy(*keys).agg(*last, F.max(seq).alias(seq))


def fold_stream(events: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The same fold of one column over a stream: the latest value of each key, emitted when it changes."""
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {value} {kinds[value]}, {seq} bigint"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for rows in batches:
            known = rows[rows[value].notna()]
            if len(known):
                top = known.loc[known[seq].idxmax()]
                if best is None or top[seq] > best[1]:
                    best = (top[value], int(top[seq]))
        if best is not None and best != held:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], value: [best[0]], seq: [best[1]]})

    return events.groupBy(key).applyInPandasWithState(update, schema, f"{value} {kinds[value]}, {seq} bigint", "update", "NoTimeout")


JOURNAL = """kind string, entry string, op int, phase string, action string, item string, `from` string, `to` string, createdMs bigint, modifiedNs bigint, error string, rootName string, atMs bigint"""


def read_journal(lines: DataFrame) -> DataFrame:
    """Typed records of journal lines (line_no, value); lines that aren't JSON records are skipped, order is the line's."""
    typed = lines.select("line_no", F.from_json("value", JOURNAL).alias("r")).select("line_no", "r.*")
    return typed.filter(F.col("kind").isin("begin", "intent", "done", "failed", "undone") & F.col("entry").isNotNull())


def operations(records: DataFrame, exists: DataFrame | None = None) -> DataFrame:
    """Each intent of a known entry with its status: the last word on its operation, else what the disk shows, else unknown."""
    begun = records.filter("kind = 'begin'").groupBy("entry").agg(F.min("line_no").alias("begun"))
    told = records.join(begun, "entry").filter("line_no >= begun")
    first = told.filter("kind = 'intent'").groupBy("entry", "op").agg(F.min_by(F.struct("line_no", "action", "item", "from", "to", "phase"), "line_no").alias("i")).select("entry", "op", "i.*")
    word = told.filter("kind in ('done', 'failed')").groupBy("entry", "op").agg(F.max_by("kind", "line_no").alias("status"))
    known = first.join(word, ["entry", "op"], "left")
    if exists is not None:
        there = exists.select(F.col("path").alias("to"), F.lit(True).alias("_there")).distinct()
        known = known.join(there, "to", "left").withColumn("status", F.coalesce("status", F.when(F.col("_there"), "done"))).drop("_there")
    return known.withColumn("status", F.coalesce("status", F.lit("unknown")))


def moves(ops: DataFrame) -> DataFrame:
    """Where each item of an entry started and where it is now, by its operations that happened."""
    happened = ops.filter("status = 'done' and action in ('move', 'rename')")
    return happened.groupBy("entry", "item").agg(F.min_by("from", "line_no").alias("original"), F.max_by("to", "line_no").alias("current")).withColumn("moved", F.col("original") != F.col("current"))


def history(records: DataFrame, ops: DataFrame) -> DataFrame:
    """Entries newest first in order; without items and not undone they don't show."""
    begun = records.filter("kind = 'begin'").groupBy("entry").agg(F.max("createdMs").alias("created_ms"), F.min("line_no").alias("pos"))
    undone = records.filter("kind = 'undone'").groupBy("entry").agg(F.max("atMs").alias("undone_ms"))
    items = moves(ops).filter("moved").groupBy("entry").agg(F.count("*").alias("items"))
    shown = begun.join(undone, "entry", "left").join(items, "entry", "left").fillna(0, ["items"]).filter("items > 0 or undone_ms is not null")
    return shown.orderBy(F.desc("created_ms"), F.desc("pos"))


def retained(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """What an entry left behind that is still there: its files and folders less those deleted since. Both: entry, path."""
    return files.join(deleted.select("entry", "path").distinct(), ["entry", "path"], "left_anti")


def undo_plan(ops: DataFrame, disk: DataFrame) -> DataFrame:
    """What undoing would do to each moved item: back to where it started if the file is as it was left, else why not.

    ops: of `operations`; disk: path, size_bytes, written_bytes (as left by the operation). The last operation of an entry is undone first."""
    at = disk.select(F.col("path").alias("current"), "size_bytes", "written_bytes")
    taken = disk.select(F.col("path").alias("original"), F.lit(True).alias("_taken")).distinct()
    last = ops.filter("status = 'done'").groupBy("entry", "item").agg(F.max("line_no").alias("line_no"))
    back = moves(ops).filter("moved").join(last, ["entry", "item"]).join(at, "current", "left").join(taken, "original", "left")
    why = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") != F.col("written_bytes"), "changed").when(F.col("_taken"), "taken").otherwise("back")
    return back.select("entry", "item", F.col("current").alias("from"), F.col("original").alias("to"), why.alias("action"), F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("line_no"))).alias("turn"))
