"""Subtitle and lyrics texts: kernels of one text, and UDFs over columns of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fields of an event line, label characters, notes and the named references that are decoded.
EVENT_FIELDS = "layer start end style name marginl marginr marginv effect text".split()
NOTES = "♪♫♬♩"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"'}

_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-z]+);")
_DASHES = re.compile(r"^[-–—]+\s*")
_LRC_STAMP = re.compile(r"\[([^\]]*)\]\s*")


def decode_bytes(raw: bytes | None) -> str | None:
    """By byte order mark, else as UTF-8 if valid, else as Windows-1252."""
    if raw is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        # the five unassigned bytes stand for their own code points
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


def decode_entities(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if len(m[0]) > 12:
            return m[0]
        if name[0] != "#":
            return NAMED.get(name, m[0])
        n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


def remove_delimited(text: str, pair: str, by: str) -> str:
    """Without what stands between balanced delimiters, nested ones too; from an opener that never closes on, the text stays."""
    inner = re.compile(rf"[{re.escape(pair)}]")
    out, depth, since, last = [], 0, 0, 0
    for m in inner.finditer(text):
        if m[0] == pair[0]:
            if not depth:
                out.append(text[last : m.start()])
                since = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(by)
                last = m.end()
    return "".join(out) + (text[since:] if depth else text[last:])


def collapse(text: str) -> str:
    return " ".join(text.split())


def tidy(text: str) -> str:
    return re.sub(r" (?=[,.!?;:)])", "", collapse(text))


def strip_prefixes(line: str) -> str:
    """Without leading dashes and an upper-case speaker label."""
    s = _DASHES.sub("", line.strip())
    label, colon, rest = s.partition(":")
    letters = sum(c.isalpha() for c in label)
    if colon and letters >= 2 and len(label) <= 30 and not rest.startswith("//") and all(c.isupper() or c in "0123456789 .'-()#&" for c in label):
        return rest.lstrip()
    return s


def clean_cue(cue: str) -> str:
    s = remove_delimited(remove_delimited(decode_entities(cue), "[]", " "), "()", " ")
    return tidy(strip_prefixes(s.translate(dict.fromkeys(map(ord, NOTES), " "))))


def finish(cues: list[str]) -> str:
    """Cues with a letter or digit, one a line; a cue that repeats the last kept one, case aside, goes."""
    out: list[str] = []
    for cue in cues:
        if any(c.isalnum() for c in cue) and not (out and out[-1].lower() == cue.lower()):
            out.append(cue)
    return "\n".join(out)


def timed_cues(content: str) -> list[str]:
    """Texts of timed cues. A line of digits just before the next time line is that cue's number."""
    lines = [x.strip() for x in content.lstrip("﻿").splitlines()]
    at = [i for i, x in enumerate(lines) if "-->" in x]
    cues = []
    for start, stop in zip(at, [*at[1:], len(lines)], strict=True):
        own = lines[start + 1 : stop]
        blank = own.index("") if "" in own else None
        cue = own if blank is None else own[:blank]
        if blank is None and stop < len(lines) and cue and cue[-1].isascii() and cue[-1].isdigit():
            cue = cue[:-1]
        cues.append(" ".join(strip_prefixes(remove_delimited(remove_delimited(x, "<>", ""), "{}", "")) for x in cue))
    return cues


def srt_to_dialogue(content: str) -> str:
    return finish([clean_cue(c) for c in timed_cues(content)])


def seconds(text: str) -> float | None:
    """h:m:s or m:s."""
    try:
        total = 0.0
        for part in text.split(":"):
            total = total * 60 + float(part)
        return total
    except ValueError:
        return None


def ass_to_dialogue(content: str) -> str:
    """Dialogue lines of the events section, by start; lines without a time last."""
    fields, inside, found = EVENT_FIELDS, False, []
    for line in map(str.strip, content.lstrip("﻿").splitlines()):
        kind, _, rest = line.partition(":")
        if line.startswith("["):
            inside = line.lower() == "[events]"
        elif inside and kind == "Format":
            fields = [f.strip().lower() for f in rest.split(",")]
        elif inside and kind == "Dialogue":
            parts = rest.split(",", len(fields) - 1)
            if len(parts) == len(fields):
                at = parts[fields.index("start")].strip() if "start" in fields else ""
                time = seconds(at) if at.count(":") >= 2 else None
                text = re.sub(r"\\[Nnh]", " ", parts[-1])
                found.append((float("inf") if time is None else time, len(found), remove_delimited(text, "{}", "")))
    return finish([clean_cue(t) for _, _, t in sorted(found)])


def plain_lyrics(text: str) -> str:
    lines = (collapse(remove_delimited(x, "[]", " ")) for x in text.splitlines())
    return "\n".join(x for x in lines if any(c.isalnum() for c in x))


def _stamps(line: str) -> tuple[list[str], str]:
    """Leading bracketed tags of a line, and the rest."""
    line, tags = line.strip(), []
    while m := _LRC_STAMP.match(line):
        tags.append(m[1])
        line = line[m.end() :]
    return tags, line


def _lrc_time(tag: str) -> float | None:
    return seconds(tag) if tag.count(":") == 1 else None


def lrc_to_lyrics(text: str) -> str:
    return plain_lyrics("\n".join(remove_delimited(_stamps(x)[1], "<>", "") for x in text.splitlines()))


def lrc_lines(text: str) -> list[tuple[float, str]]:
    """A row for each time stamp of a line, by time."""
    rows = []
    for line in text.splitlines():
        tags, rest = _stamps(line)
        words = collapse(remove_delimited(rest, "<>", ""))
        rows += [(t, words) for tag in tags if (t := _lrc_time(tag)) is not None]
    return sorted(rows, key=lambda r: r[0])


def to_dialogue(content: str | None) -> str | None:
    """Dialogue of a subtitle or lyrics text, whose kind its content tells."""
    if content is None:
        return None
    content = content.lstrip("﻿")
    if content.lstrip().startswith("WEBVTT"):
        return srt_to_dialogue(content)
    if "[Events]" in content or "\nDialogue:" in content:
        return ass_to_dialogue(content)
    if "-->" in content:
        return srt_to_dialogue(content)
    stamped = 0
    for line in content.splitlines():
        tags = _stamps(line)[0]
        stamped += bool(tags and _lrc_time(tags[0]) is not None)
    return lrc_to_lyrics(content) if stamped >= 2 else finish([clean_cue(x) for x in content.splitlines()])


def strip_html_full(text: str | None) -> str | None:
    """HTML's text with every character reference decoded."""
    if text is None:
        return None
    blocks = re.sub(r"(?i)</*(?:p|br|div|li|ul|ol|h1|h2|h3)(?![a-z0-9])[^>]*>", " ", text)
    return tidy(decode_entities(re.sub(r"<[^>]*>", "", blocks)))


def column_udf(kernel):
    """A vectorised UDF of a function of one text; equal texts of a batch are worked out once."""

    def run(text: pd.Series) -> pd.Series:
        known = {x: kernel(x) for x in text.dropna().unique()}
        return text.map(known).astype(object).where(text.notna(), None)

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


dialogue_udf = column_udf(to_dialogue)
strip_html_udf = column_udf(strip_html_full)
