"""Native text functions: names, titles, markers, times, HTML, formatting. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Video extensions, block tags, entities, hallucinated phrases and credits, language codes.
VIDEO_EXTENSIONS = "mkv mp4 m4v mov avi ts m2ts mts mpg mpeg vob".split()
BLOCK_TAGS = "p br div li ul ol h1 h2 h3".split()
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–",
    "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"',
}
HEARD_PHRASES = (
    "thank you", "thank you very much", "thanks for watching", "thank you for watching", "thank you so much for watching",
    "please subscribe", "like and subscribe", "subscribe to my channel", "you", "bye",
)
CREDIT_PREFIXES = (
    "subtitles by", "subtitled by", "captions by", "captioning by", "closed captioning by", "captioned by", "transcribed by",
    "transcription by", "translated by", "translation by", "sync and corrections by", "subtitles made by", "amara org",
)
LANGUAGES = {
    "en": "eng", "fr": "fre fra", "de": "ger deu", "es": "spa", "it": "ita", "pt": "por", "nl": "dut nld", "sv": "swe", "no": "nor nob nno",
    "da": "dan", "fi": "fin", "pl": "pol", "ru": "rus", "ja": "jpn", "zh": "chi zho", "ko": "kor",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def has_video_extension(name: Column) -> Column:
    return extension(name).isin(VIDEO_EXTENSIONS)


def normalize_name(text: Column) -> Column:
    """`&` as "and", no apostrophes, lower-case letters and digits, single spaces. Accents stay."""
    spelt = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), "['’]", "")
    return F.trim(F.regexp_replace(F.lower(spelt), r"[^\p{L}\p{N}]+", " "))


def squash(text: Column) -> Column:
    return F.replace(normalize_name(text), F.lit(" "), F.lit(""))


def same_title(a: Column, b: Column) -> Column:
    return (squash(a) != "") & (squash(a) == squash(b))


def contains_words(haystack: Column, needle: Column) -> Column:
    n = normalize_name(needle)
    return (n != "") & F.contains(F.concat(F.lit(" "), normalize_name(haystack), F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def refers_to(name: Column, show: Column) -> Column:
    return (squash(show) != "") & F.contains(squash(name), squash(show))


_SE = r"(?:^|[^a-z])s([0-9]{1,3})(?![0-9])[._ -]?e([0-9]{1,3})(?![0-9])"
_X = r"(?:^|[^a-z0-9])([0-9]{1,3})x([0-9]{2,3})(?![a-z0-9])"
_LONG = r"(?:^|[^\p{L}\p{N}])season[^\p{L}\p{N}]+([0-9]+)[^\p{L}\p{N}]+(?:episode|ep)[^\p{L}\p{N}]+([0-9]+)(?![\p{L}\p{N}])"


def episode_marker(name: Column) -> Column:
    """struct(season, episode) of S01E02, 1x02 (the one further left) or "Season 1 Episode 2"; null without."""
    low = F.lower(name)
    got = lambda p: F.struct(F.regexp_extract(low, p, 1).try_cast("int").alias("season"), F.regexp_extract(low, p, 2).try_cast("int").alias("episode"))
    # where each form starts: the text before its first match
    place = lambda p: F.length(F.element_at(F.split(low, p, 2), 1))
    has = lambda p: low.rlike(p)
    short = F.when(has(_SE) & (~has(_X) | (place(_SE) <= place(_X))), got(_SE)).when(has(_X), got(_X))
    return F.coalesce(short, F.when(has(_LONG), got(_LONG)))


def season_from_folder(path: Column) -> Column:
    """The season that a path's last component names, as S3 or Season 2 standing apart; one or two digits, not 0."""
    last = F.regexp_extract(F.lower(path), r"([^/\\]+)[/\\]*$", 1)
    n = F.regexp_extract(last, r"(?:^|[^a-z0-9])(?:s|season[ ._-]*)([0-9]{1,2})(?![a-z0-9])", 1).try_cast("int")
    return F.when(n > 0, n)


def normalize_heard(text: Column) -> Column:
    """Lower-case letters and digits, apostrophes dropped, all else one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "['’]", "")), r"[^\p{L}\p{N}]+", " "))


def is_repeated_phrase(norm: Column, phrase: str) -> Column:
    return norm.rlike(f"^{phrase}( {phrase})*$")


def is_known_hallucination(norm: Column) -> Column:
    """The whole text is a phrase that recognisers invent, once or more, or starts like a subtitler's credit."""
    phrases = "|".join(f"{p}( {p})*" for p in HEARD_PHRASES)
    return norm.rlike(f"^({phrases})$") | norm.rlike(f"^({'|'.join(CREDIT_PREFIXES)})( |$)")


def is_sound_description(text: Column) -> Column:
    """Some letter, digit or note, and no letter or digit outside brackets, at any depth, and asterisks. One pass over the marks and words."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\[(]|[\])]|\*|[♪♫♬♩]|[\p{L}\p{N}]+)"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("starred"), F.lit(False).alias("some"), F.lit(False).alias("outside"))
    word = lambda t: t.rlike(r"^[\p{L}\p{N}]")

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t.isin("[", "("), s["depth"] + 1).when(t.isin("]", ")"), F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (s["starred"] != (t == "*")).alias("starred"), (s["some"] | ~t.isin("[", "(", "]", ")", "*")).alias("some"), (s["outside"] | (word(t) & (s["depth"] == 0) & ~s["starred"])).alias("outside"))

    return F.aggregate(parts, start, step, lambda s: s["some"] & ~s["outside"])


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def language_code(tag: Column) -> Column:
    return F.when(F.lower(tag) == "pt-br", "BR_PT").otherwise(F.upper(F.element_at(F.split(tag, "[-_]"), 1)))


def languages_match(a: Column, b: Column) -> Column:
    """Equal codes, or a two-letter code and one of its three-letter ones; case aside; blank never matches."""
    groups = F.create_map(*[F.lit(x) for two, three in LANGUAGES.items() for code in (two, *three.split()) for x in (code, two)])
    low = lambda c: F.lower(F.trim(c))
    root = lambda c: F.coalesce(F.try_element_at(groups, low(c)), low(c))
    return F.coalesce((low(a) != "") & (root(a) == root(b)), F.lit(False))


def parse_clock(text: Column) -> Column:
    """Seconds of h:m:s, m:s or s; null unless every part is a number and none negative."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: F.trim(x).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when((total >= 0) & (total < float("inf")), total)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, the ampersand last so that nothing is decoded twice."""
    out = text
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tidy(text: Column) -> Column:
    """Single spaces, none before closing punctuation."""
    return F.regexp_replace(collapse_spaces(text), r" ([,.!?;:)])", "$1")


def strip_html(html: Column) -> Column:
    """The text of HTML: block tags part words, others vanish; a `<` that never closes stays."""
    blocks = F.regexp_replace(html, rf"(?i)</*({'|'.join(BLOCK_TAGS)})(?![a-z0-9])[^>]*>", " ")
    return tidy(decode_entities(F.regexp_replace(blocks, r"<[^>]*>", "")))


def as_text(cell: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on, of the nearest second."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5).cast("bigint")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def episode_code(season: Column, number: Column) -> Column:
    return F.format_string("S%02dE%02d", season, number)


def megabytes(size: Column) -> Column:
    return F.concat(F.format_number(F.floor(size / 1_000_000 + 0.5), 0), F.lit(" MB"))


def percent(share: Column) -> Column:
    return F.concat(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100 + 0.5).cast("string"), F.lit("%"))


def plural(count: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(count, 0), F.lit(" "), F.when(count == 1, one).otherwise(many or f"{one}s"))


def time_left(seconds: Column) -> Column:
    """An estimate in words."""
    whole = lambda c: F.floor(c + 0.5).cast("bigint")
    hours = F.concat(F.lit("About "), F.floor(seconds / 3600).cast("string"), F.lit(" h "), whole((seconds % 3600) / 60).cast("string"), F.lit(" min left"))
    minutes = F.concat(F.lit("About "), plural(whole(seconds / 60), "minute"), F.lit(" left"))
    return F.when(seconds < 60, "Less than a minute left").when(seconds < 3600, minutes).otherwise(hours)


def day(at_ms: Column, now_ms: Column) -> Column:
    """Today, Yesterday, or the date, with its year if it's another."""
    date = lambda c: F.to_date(F.timestamp_millis(c))
    ago = F.datediff(date(now_ms), date(at_ms))
    named = F.concat(F.date_format(date(at_ms), "MMM d"), F.when(F.year(date(at_ms)) == F.year(date(now_ms)), "").otherwise(F.date_format(date(at_ms), ", yyyy")))
    return F.when(ago == 0, "Today").when(ago == 1, "Yesterday").otherwise(named)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)[/\\]+[^/\\]*[/\\]*$", 1)


def scan_root(path: Column, file_id: Column) -> Column:
    """The folder that was scanned: a file's path less the components of its id."""
    return F.regexp_replace(F.substring(path, F.lit(1), F.greatest(F.lit(0), F.length(path) - F.length(file_id))), r"[/\\]+$", "")


def is_plain_absolute(path: Column) -> Column:
    """Absolute, with no `.` or `..` component."""
    return path.rlike(r"^(/|[A-Za-z]:[/\\])") & ~path.rlike(r"(^|[/\\])\.{1,2}([/\\]|$)")
