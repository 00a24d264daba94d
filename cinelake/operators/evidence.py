"""What speaks for a match: notes, quotes with matched words marked, and sentences for people."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from cinelake.functions import phonetic, similarity, words
from cinelake.functions import text as T

# Thresholds of the notes, and words of context around a quote.
ORDER_AGREES, TITLE_HEARD, LENGTH_MISMATCH, WORD_MATCH, CONTEXT = 0.5, 0.5, 0.3, 0.8, 6


def notes(order: Column, title: Column, duration: Column, n_words: Column, heard_titles: Column, music: Column, has_reference: Column, order_ignored: Column, windows: Column) -> Column:
    """The notes that apply, in their order."""
    return F.array_compact(
        F.array(
            F.when(order >= ORDER_AGREES, "discOrderAgrees").when(order.isNotNull(), "discOrderDisagrees"),
            F.when(order_ignored, "playAllIgnored"),
            F.when(title >= TITLE_HEARD, "titleHeard"),
            F.when(duration < LENGTH_MISMATCH, "lengthMismatch"),
            F.when((n_words == 0) & heard_titles.isNull(), "noSpeech"),
            F.when(music, "mostlyMusic"),
            F.when(~has_reference, "noReferenceText"),
            F.when(windows.isNotNull(), F.concat(F.lit("sampled:"), windows.cast("string"))),
        )
    )


def play_all_reason(name: Column, duration: Column, total: Column, others: Column, difference: Column, matched: Column, n_chapters: Column) -> Column:
    """Why a file is taken for the play-all, in words."""
    percent = F.round(difference * 100).cast("int")
    than = F.when(percent < 1, "about the same as").otherwise(F.format_string("%d%% %s than", percent, F.when(duration >= total, "longer").otherwise("shorter")))
    told = F.format_string("%s is %s long, %s the other %d files together (%s).", name, T.clock(duration), than, others, T.clock(total))
    chapters = F.when(n_chapters >= 2, F.format_string(" %d of the %d files have the length of one of its %d chapters.", matched, others, n_chapters)).otherwise("")
    return F.concat(told, chapters)


def conflict_text(kind: Column, path: Column, file_ids: Column) -> Column:
    return (
        F.when(kind == "sourceChanged", F.concat(T.base_name(path), F.lit(" has changed since the scan.")))
        .when(kind == "duplicateTarget", F.concat(F.array_join(file_ids, ", "), F.lit(" would all be named "), T.base_name(path), F.lit(".")))
        .otherwise(F.concat(T.base_name(path), F.lit(" already exists.")))
    )


def untouched_summary(reasons: Column, verb: str = "renamed") -> Column:
    """What stays as it is, in a sentence; null if nothing does. reasons: struct(path, reason) in order."""
    of = lambda kind: F.filter(reasons, lambda r: r["reason"] == kind)
    names = lambda rows: F.transform(rows, lambda r: T.base_name(r["path"]))
    extras, skipped = names(of("extra")), F.size(of("skipped"))
    few = F.when(F.size(extras) > 3, F.concat(F.array_join(F.slice(extras, 1, 3), ", "), F.lit(", …"))).otherwise(F.array_join(extras, ", "))
    extra = F.when(F.size(extras) == 1, F.concat(F.element_at(extras, 1), F.lit(" (extra)"))).when(F.size(extras) > 1, F.concat(F.size(extras).cast("string"), F.lit(" extras ("), few, F.lit(")")))
    parts = F.concat(F.transform(names(of("playAll")), lambda n: F.concat(n, F.lit(" (play all)"))), F.array_compact(F.array(extra, F.when(skipped > 0, T.plural(skipped, "skipped or unchecked file")))))
    listed = F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ", "), F.lit(" and "), F.element_at(parts, -1))).otherwise(F.try_element_at(parts, F.lit(1)))
    return F.when(F.size(reasons) > 0, F.concat(F.lit(f"Not {verb}: "), listed, F.when(F.size(reasons) == 1, " stays as it is.").otherwise(" stay as they are.")))


def align(a: list[str], b: list[str]) -> tuple[list[bool], list[bool]]:
    """Which words of two runs pair off in order: equal, sounding alike, or nearly so."""
    codes = {w: phonetic.phonetic_code(w) for w in {*a, *b}}
    same = [[x == y or codes[x] == codes[y] or similarity.ratio(x, y) >= WORD_MATCH for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if same[i][j] else max(best[i + 1][j], best[i][j + 1])
    left, right, i, j = [False] * len(a), [False] * len(b), 0, 0
    while i < len(a) and j < len(b):
        if same[i][j]:
            left[i] = right[j] = True
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return left, right


def quote(text: str, start: int, stop: int, matched: list[bool]) -> list[tuple[str, bool]]:
    """The original text of tokens [start, stop), as parts that match or don't; neighbours that match take the gap between them."""
    tokens = words.tokenize(text)
    units: list[list] = []
    for (_, a, b), m in zip(tokens[start:stop], matched, strict=True):
        if units and units[-1][0] == a:
            units[-1][2] |= m
        else:
            units.append([a, b, m])
    if not units:
        return []
    raw = [("… ", False)] if start else []
    for k, (a, b, m) in enumerate(units):
        if k:
            raw.append((re.sub(r"\s+", " ", text[units[k - 1][1] : a]), units[k - 1][2] and m))
        raw.append((text[a:b], m))
    raw.append((re.match(r"[^\s\w]*", text[units[-1][1] :])[0], False))
    if stop < len(tokens):
        raw.append((" …", False))
    out: list[tuple[str, bool]] = []
    for part, m in raw:
        if part and out and out[-1][1] == m:
            out[-1] = (out[-1][0] + part, m)
        elif part:
            out.append((part, m))
    return out


def overlap_quotes(heard: str, heard_at: int, reference: str, reference_at: int, n: int) -> tuple[list, list]:
    """Quotes of a phrase of n words and where it was found, each with context, matching words marked."""
    sides = []
    for text, at in ((heard, heard_at), (reference, reference_at)):
        own = words.words(text)
        sides.append((own, max(0, at - CONTEXT), min(len(own), at + n + CONTEXT)))
    (a, a0, a1), (b, b0, b1) = sides
    left, right = align(a[a0:a1], b[b0:b1])
    return quote(heard, a0, a1, left), quote(reference, b0, b1, right)


_PARTS = ArrayType(StructType([StructField("text", StringType()), StructField("matched", BooleanType())]))


@F.pandas_udf(_PARTS)
def heard_quote_udf(heard: pd.Series, heard_at: pd.Series, reference: pd.Series, reference_at: pd.Series, n: pd.Series) -> pd.Series:
    """The heard side's quote, for the few candidates that are kept."""
    rows = zip(heard, heard_at, reference, reference_at, n, strict=True)
    return pd.Series([[{"text": t, "matched": m} for t, m in overlap_quotes(a, int(i), b, int(j), int(k))[0]] for a, i, b, j, k in rows])
