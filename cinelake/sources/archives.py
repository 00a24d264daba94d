"""Subtitle archives and local reference files as rows of texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import subtitles

# Limits of an archive, preference and kinds of files.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 500, 5 << 20, 100 << 20
PREFERENCE = ["srt", "ass", "ssa", "vtt"]
KINDS = {**dict.fromkeys(("srt", "vtt", "ass", "ssa"), "subtitles"), **dict.fromkeys(("lrc", "txt"), "lyrics")}


def entries(payload: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's subtitle files, preferred kinds first; anything else is one unnamed file. Too much raises."""
    if not payload.startswith(b"PK"):
        return [("", payload)]
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MAX_ENTRIES:
            raise ValueError("too many files in the archive")
        for i in infos:
            base = i.filename.rpartition("/")[2]
            kind = base.lower().rpartition(".")[2]
            if i.filename.startswith("__MACOSX/") or base.startswith("._") or kind not in PREFERENCE:
                continue
            with z.open(i) as f:
                raw = f.read(MAX_ENTRY + 1)
            total += len(raw)
            if len(raw) > MAX_ENTRY or total > MAX_TOTAL:
                raise ValueError("the archive holds too much")
            out.append((PREFERENCE.index(kind), i.filename, raw))
    return [(name, raw) for _, name, raw in sorted(out, key=lambda e: e[0])]


def extract(archives: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """pos, name, text (dialogue), error of every entry of every archive."""
    kinds = dict(archives.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                own = [r[k] for k in keys]
                try:
                    rows += [[*own, i, name, subtitles.to_dialogue(subtitles.decode_bytes(raw)), None] for i, (name, raw) in enumerate(entries(bytes(r[payload] or b"")))]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append([*own, 0, None, None, str(e)])
            yield pd.DataFrame(rows, columns=[*keys, "pos", "name", "text", "error"])

    return archives.select(*keys, payload).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pos int, name string, text string, error string")


def local_references(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, text of reference files in a folder and its immediate subfolders."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{srt,vtt,ass,ssa,lrc,txt,SRT,VTT,ASS,SSA,LRC,TXT}").load(root)
    relative = F.regexp_extract("path", ".*?" + root.rpartition("/")[2] + "/(.*)$", 1)
    near = files.withColumn("rel", relative).filter(F.size(F.split("rel", "/")) <= 2)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["rel"], "text": [subtitles.to_dialogue(subtitles.decode_bytes(bytes(c))) for c in b["content"]]})

    texts = near.select("rel", "content").mapInPandas(run, "path string, text string")
    return texts.withColumn("kind", F.try_element_at(kind, F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))).select("path", "kind", "text")
