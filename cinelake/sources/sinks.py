"""Driver-side writers: lists, job records, the journal and file moves. Tasks are retried; none of this runs in one."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

COLUMNS = ["file", "status", "season", "episode", "title", "new_name"]


def _place(temp: str, target: Path, replace: bool) -> None:
    if replace:
        os.replace(temp, target)
        return
    try:
        os.link(temp, target)  # fails if the target is there
    finally:
        os.unlink(temp)


def _write(target: Path, raw: Iterator[bytes], replace: bool) -> None:
    """Through a temporary file beside the target, which is never half-written."""
    handle, temp = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(handle, "wb") as f:
        for part in raw:
            f.write(part)
        f.flush()
        os.fsync(f.fileno())
    _place(temp, target, replace)


def export_csv(rows: DataFrame, target: str, replace: bool = False) -> None:
    """The list of one job as a CSV file with a byte order mark, by file name; streamed, not collected."""

    def lines() -> Iterator[bytes]:
        yield b"\xef\xbb\xbf"
        yield _line(COLUMNS)
        for r in rows.select(*COLUMNS).orderBy("file").toLocalIterator():
            yield _line(list(r))

    _write(Path(target), lines(), replace)


def _line(row: list) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(row)
    return out.getvalue().encode()


def save_job(folder: str, job_id: str, record: dict) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", job_id):
        raise ValueError("a job's id is letters, digits, _ and -")
    _write(Path(folder) / f"{job_id}.json", iter([json.dumps(record).encode()]), True)


def load_job(folder: str, job_id: str) -> dict | None:
    path = Path(folder) / f"{job_id}.json"
    return json.loads(path.read_text()) if re.fullmatch(r"[A-Za-z0-9_-]+", job_id) and path.exists() else None


class Journal:
    """An append-only log of JSON lines, on disk before what it announces happens. A torn last line is ended first."""

    def __init__(self, path: str):
        self.path = Path(path)
        torn = self.path.exists() and self.path.stat().st_size and not self.path.read_bytes().endswith(b"\n")
        self.file = self.path.open("ab")
        if torn:
            self.file.write(b"\n")

    def add(self, kind: str, entry: str, **rest) -> None:
        self.file.write(json.dumps({"kind": kind, "entry": entry, **rest}).encode() + b"\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Move:
    item: str
    source: str
    target: str
    size: int


def apply_moves(moves: list[Move], journal: Journal, entry: str, copy: bool = False) -> list[tuple[Move, str | None]]:
    """Moves (or copies) files in two steps, so that they may swap names; returns each with its error, if any.

    A source whose size changed, or a target that is there, is left alone; every step is announced first and settled after.
    """
    journal.add("begin", entry)
    op, out, staged = 0, [], []

    def step(action: str, m: Move, a: str, b: str) -> str | None:
        nonlocal op
        op += 1
        journal.add("intent", entry, op=op, action=action, item=m.item, **{"from": a, "to": b})
        try:
            if os.path.exists(b):
                raise FileExistsError(b)
            os.makedirs(os.path.dirname(b), exist_ok=True)
            shutil.copy2(a, b) if action == "copy" else os.rename(a, b)
        except OSError as e:
            journal.add("failed", entry, op=op, error=str(e))
            return str(e)
        journal.add("done", entry, op=op)
        return None

    for m in moves:
        if not os.path.exists(m.source) or os.path.getsize(m.source) != m.size:
            out.append((m, "the source changed"))
        elif copy:
            out.append((m, step("copy", m, m.source, m.target)))
        else:
            temp = f"{m.source}.moving"
            error = step("move", m, m.source, temp)
            out.append((m, error)) if error else staged.append((m, temp))
    for m, temp in staged:
        error = step("move", m, temp, m.target)
        if error:
            step("move", m, temp, m.source)
        out.append((m, error))
    return out
