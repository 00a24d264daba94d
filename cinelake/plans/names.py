"""Queries of the name, path, format and sentence functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import naming, phonetic, similarity, subtitles, words
from cinelake.functions import text as T
from cinelake.operators import evidence

from .tables import table

_EXTENSIONS = ["mkv", "MKV", "txt", "m2ts", "", "Mp4", "avi.bak", "VOB", "ts", "srt", "mpeg", "jpg"]


def _pick(options: list, at: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))


def _pick_sql(options: list[str], at: str) -> str:
    return "(list_value(" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f")[({at}) % {len(options)} + 1])"


def src03_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under folders of every form: video extension, base and directory name, whether the path is plain, its season."""
    folder = _pick(["/media/{h}/S3", r"C:\media\Season 2", "clips/{h}", "/media/../{h}/season_07_x", "/media/Season 12/./extras", "/{h}/Seasons/s00e1"], F.col("page_id"))
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    extension = _pick(_EXTENSIONS, F.floor(F.col("page_id") / 7))
    path = F.concat(F.replace(folder, F.lit("{h}"), host), F.when(F.col("page_id") % 6 == 1, "\\").otherwise("/"), F.lit("Clip "), "page_id", F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select(
        "page_id", T.has_video_extension(F.col("path")).alias("is_video"), T.base_name(F.col("path")).alias("name"), T.dir_name(F.col("path")).alias("folder"),
        T.is_plain_absolute(F.col("path")).alias("is_plain"), T.season_from_folder(T.dir_name(F.col("path"))).alias("season"),
    )


_PATHS_SQL = (
    "WITH p AS (SELECT page_id, replace(" + _pick_sql(["/media/{h}/S3", r"C:\media\Season 2", "clips/{h}", "/media/../{h}/season_07_x", "/media/Season 12/./extras", "/{h}/Seasons/s00e1"], "page_id")
    + r", '{h}', split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) AS folder, CASE WHEN page_id % 6 = 1 THEN '\' ELSE '/' END AS sep, "
    + _pick_sql(_EXTENSIONS, "page_id // 7") + " AS ext FROM pages) "
    "SELECT page_id, list_contains(['mkv', 'mp4', 'm4v', 'mov', 'avi', 'ts', 'm2ts', 'mts', 'mpg', 'mpeg', 'vob'], lower(ext)) AS is_video, 'Clip ' || page_id || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END AS name, folder, "
    "page_id % 6 IN (0, 1, 5) AS is_plain, CASE page_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 7 END::INTEGER AS season FROM p"
)


def sca17_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the same name written otherwise, and against their type: the same title, or its words within."""
    name, other = F.col("p_name"), _pick(["{n}", "The {n}!", "{n} & co", "{n}'s", "", "pre{n}"], F.col("p_partkey"))
    written = F.replace(other, F.lit("{n}"), F.upper(F.replace(name, F.lit(" "), F.lit("-"))))
    return table(spark, sf_dir, "part").select("p_partkey", T.same_title(name, written).alias("same"), T.contains_words(written, name).alias("holds"), T.refers_to(written, name).alias("refers"))


_TITLES_SQL = "SELECT p_partkey, p_partkey % 6 = 0 AS same, p_partkey % 6 IN (0, 1, 2) AS holds, p_partkey % 6 <> 4 AS refers FROM part"

_CODES = ["en", "ENG", "fr", "fra", "fre", " de ", "ger", "pt", "xx", ""]


def fil07_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language codes of two and three letters against each other, and as a provider's code."""
    a, b = _pick(_CODES, F.col("l_partkey")), _pick(_CODES, F.col("l_suppkey"))
    tag = _pick(["pt-BR", "pt-PT", "en", "de_AT", "Zh-hans"], F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.languages_match(a, b).alias("matches"), T.language_code(tag).alias("code"))


_LANGUAGES_SQL = (
    "WITH c AS (SELECT *, " + _pick_sql(["en", "en", "fr", "fr", "fr", "de", "de", "pt", "xx", ""], "l_partkey") + " AS a, " + _pick_sql(["en", "en", "fr", "fr", "fr", "de", "de", "pt", "xx", ""], "l_suppkey") + " AS b, "
    + _pick_sql(["BR_PT", "PT", "EN", "DE", "ZH"], "l_partkey") + " AS code FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a = b AND a <> '' AS matches, code FROM c"
)


def sca28_dates_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of dates, seconds of clock texts, and times as subtitles write them."""
    date = F.when(F.col("l_partkey") % 5 == 0, "soon").when(F.col("l_partkey") % 7 == 0, None).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    s = F.col("l_extendedprice") / 3
    text = _pick(["{h}:{m}:{s}", "{m}:{s}", "{s}", " {m} : {s} ", "{h}:x:{s}", "-{s}", ""], F.col("l_suppkey"))
    for hole, value in (("h", F.col("l_linenumber").cast("string")), ("m", F.floor("l_quantity").cast("bigint").cast("string")), ("s", F.format_string("%.2f", F.col("l_tax") * 100))):
        text = F.replace(text, F.lit("{" + hole + "}"), value)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.year_of(date).alias("year"), F.round(T.parse_clock(text), 6).alias("seconds"), T.srt_time(s).alias("stamp"))


_TIMES_SQL = """
WITH l AS (SELECT *, floor(l_quantity) AS m, round(l_tax * 100, 2) AS s, round(l_extendedprice / 3 * 1000)::BIGINT AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 = 0 THEN NULL ELSE year(l_shipdate) END::INTEGER AS year,
  round(CASE l_suppkey % 7 WHEN 0 THEN l_linenumber * 3600 + m * 60 + s WHEN 1 THEN m * 60 + s WHEN 2 THEN s WHEN 3 THEN m * 60 + s WHEN 5 THEN CASE WHEN s = 0 THEN 0 END END, 6)::DOUBLE AS seconds,
  printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM l
"""


def sca30_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a response's headers ask to wait, by what they give."""
    from cinelake.sources import cache

    now, id_ = F.lit(1_700_000_000_000), F.col("event_id")
    reset = F.when(id_ % 4 == 0, F.lit(1_700_000_000_000) + id_ * 10).when(id_ % 4 == 1, F.lit(1_700_000_000) + id_ % 90).when(id_ % 4 == 2, id_ % 60)
    pairs = F.array(F.struct(F.lit("x-ratelimit-remaining").alias("k"), (id_ % 3).cast("string").alias("v")), F.struct(F.lit("x-ratelimit-reset").alias("k"), reset.cast("string").alias("v")), F.struct(F.when(id_ % 11 == 0, "retry-after").otherwise("server").alias("k"), F.floor("value").cast("bigint").cast("string").alias("v")))
    return table(spark, sf_dir, "events").select("event_id", cache.retry_after_ms(F.map_from_entries(pairs), now).alias("wait_ms"))


_WAITS_SQL = """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN floor(value) * 1000 WHEN event_id % 3 > 0 THEN NULL
  ELSE CASE event_id % 4 WHEN 0 THEN event_id * 10 WHEN 1 THEN event_id % 90 * 1000 WHEN 2 THEN event_id % 60 * 1000 ELSE 1000 END END::DOUBLE AS wait_ms FROM events
"""


def sca50_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, shares, counts, estimates and days as people read them."""
    price, n = F.col("l_extendedprice"), F.col("l_linenumber")
    at = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    now = at + (n.cast("bigint") - 1) * 86_400_000 * F.when(F.col("l_partkey") % 3 == 0, 200).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", T.megabytes(price * 100_000).alias("size"), T.percent(F.col("l_discount") * 12 - 0.1).alias("share"),
        T.plural(n, "file").alias("files"), T.plural(F.floor("l_quantity").cast("bigint") * 100, "entry", "entries").alias("entries"), T.time_left(price / 5).alias("left"), T.day(at, now).alias("day"),
    )


_DISPLAY_SQL = """
WITH l AS (SELECT *, l_extendedprice / 5 AS t, greatest(0.0, least(1.0, l_discount * 12 - 0.1)) AS p, (l_linenumber - 1) * CASE WHEN l_partkey % 3 = 0 THEN 200 ELSE 1 END AS days FROM lineitem),
g AS (SELECT *, floor(l_extendedprice * 100000 / 1000000 + 0.5)::BIGINT AS mb, floor(l_quantity)::BIGINT * 100 AS e, floor(t / 60 + 0.5)::BIGINT AS mins, l_shipdate + to_days(days::INTEGER) AS later FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, format('{:,}', mb) || ' MB' AS size, floor(p * 100 + 0.5)::BIGINT || '%' AS share, CASE l_linenumber WHEN 1 THEN '1 file' ELSE l_linenumber || ' files' END AS files,
  format('{:,}', e) || ' entries' AS entries, CASE WHEN t < 60 THEN 'Less than a minute left' WHEN t < 3600 THEN 'About ' || CASE mins WHEN 1 THEN '1 minute' ELSE mins || ' minutes' END || ' left'
  ELSE 'About ' || floor(t / 3600)::BIGINT || ' h ' || floor((t % 3600) / 60 + 0.5)::BIGINT || ' min left' END AS left,
  CASE days WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(l_shipdate, '%b %-d') || CASE WHEN year(l_shipdate) = year(later) THEN '' ELSE strftime(l_shipdate, ', %Y') END END AS day FROM g
"""


def sca53_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a match, why a file is the play-all, and what a conflict says."""
    l, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    known = lambda c, k: F.when(F.col("l_partkey") % k > 0, c)
    notes = evidence.notes(known(F.col("l_tax") * 12, 3), known(F.col("l_discount") * 10, 4), known(F.col("l_quantity") / 50, 5), n - 1, known(n, 2), F.col("l_returnflag") == "A", F.col("l_linestatus") == "O", n == 7, known(n, 6))
    reason = evidence.play_all_reason(F.concat(F.lit("file "), n), F.col("l_quantity") * 60, F.col("l_quantity") * 50 + 600, n + 1, F.abs(F.col("l_quantity") * 10 - 600) / (F.col("l_quantity") * 50 + 600), n, n % 4)
    kind = _pick(["sourceChanged", "duplicateTarget", "targetExists"], F.col("l_partkey"))
    conflict = evidence.conflict_text(kind, F.concat(F.lit("/out/x/"), "l_partkey", F.lit(".mkv")), F.array(F.col("l_suppkey").cast("string"), n.cast("string")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(notes, " ").alias("notes"), reason.alias("reason"), conflict.alias("conflict"))


_SENTENCES_SQL = """
WITH l AS (SELECT *, l_quantity * 60 AS d, l_quantity * 50 + 600 AS t, round(abs(l_quantity * 10 - 600) / (l_quantity * 50 + 600) * 100)::INTEGER AS pc, floor(l_quantity * 60 + 0.5)::BIGINT AS ds, floor(l_quantity * 50 + 600.5)::BIGINT AS ts FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string(list_filter([
    CASE WHEN l_partkey % 3 > 0 THEN CASE WHEN l_tax * 12 >= 0.5 THEN 'discOrderAgrees' ELSE 'discOrderDisagrees' END END, CASE WHEN l_linenumber = 7 THEN 'playAllIgnored' END,
    CASE WHEN l_partkey % 4 > 0 AND l_discount * 10 >= 0.5 THEN 'titleHeard' END, CASE WHEN l_partkey % 5 > 0 AND l_quantity / 50 < 0.3 THEN 'lengthMismatch' END, CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN 'noSpeech' END,
    CASE WHEN l_returnflag = 'A' THEN 'mostlyMusic' END, CASE WHEN l_linestatus <> 'O' THEN 'noReferenceText' END, CASE WHEN l_partkey % 6 > 0 THEN 'sampled:' || l_linenumber END], lambda x: x IS NOT NULL), ' ') AS notes,
  'file ' || l_linenumber || ' is ' || CASE WHEN ds >= 3600 THEN printf('%d:%02d:%02d', ds // 3600, ds // 60 % 60, ds % 60) ELSE printf('%d:%02d', ds // 60, ds % 60) END || ' long, '
  || CASE WHEN pc < 1 THEN 'about the same as' ELSE pc || '% ' || CASE WHEN d >= t THEN 'longer' ELSE 'shorter' END || ' than' END || ' the other ' || (l_linenumber + 1) || ' files together ('
  || CASE WHEN ts >= 3600 THEN printf('%d:%02d:%02d', ts // 3600, ts // 60 % 60, ts % 60) ELSE printf('%d:%02d', ts // 60, ts % 60) END || ').'
  || CASE WHEN l_linenumber % 4 >= 2 THEN ' ' || l_linenumber || ' of the ' || (l_linenumber + 1) || ' files have the length of one of its ' || (l_linenumber % 4) || ' chapters.' ELSE '' END AS reason,
  CASE l_partkey % 3 WHEN 0 THEN l_partkey || '.mkv has changed since the scan.' WHEN 1 THEN l_suppkey || ', ' || l_linenumber || ' would all be named ' || l_partkey || '.mkv.' ELSE l_partkey || '.mkv already exists.' END AS conflict FROM l
"""


def sca45_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no disk refuses, from names with everything that some do; and the key under which paths coincide."""
    form = _pick(["{n}: {t}", '.."{n}"/{t}\\', "<{n}|{t}>?*. .", "con", "com1.{n}", "  {n}\t{t}  ", "...", "{n}:{t}", "NUL.txt", "Lpt¹"], F.col("p_partkey"))
    name = F.replace(F.replace(form, F.lit("{n}"), F.col("p_name")), F.lit("{t}"), F.col("p_type"))
    long = F.repeat(F.concat("p_name", F.lit(" é ")), (F.col("p_size") + 1).cast("int"))
    safe, fold = subtitles.column_udf(naming.sanitize), subtitles.column_udf(naming.fold)
    fitted = subtitles.column_udf(lambda stem: naming.fit_name(stem, "m.k/v"))
    return table(spark, sf_dir, "part").select("p_partkey", safe(name).alias("safe"), fold(F.concat(F.upper("p_name"), F.lit("E\u0301"))).alias("folded"), (F.octet_length(fitted(long)) <= 200).alias("fits"), F.md5(fitted(F.substring(long, 1, 60))).alias("fitted_md5"))


_SAFE_SQL = r"""
WITH p AS (SELECT p_partkey, p_name AS n, p_type AS t, substr(repeat(p_name || ' é ', p_size + 1), 1, 60) AS l FROM part)
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN n || ' - ' || t WHEN 1 THEN '''' || n || '''-' || t || '-' WHEN 2 THEN n || t WHEN 3 THEN 'con_' WHEN 4 THEN 'com1_.' || n WHEN 5 THEN n || ' ' || t WHEN 6 THEN '_' WHEN 7 THEN n || '-' || t
  WHEN 8 THEN 'NUL_.txt' ELSE 'Lpt¹_' END AS safe, lower(n) || 'é' AS folded, true AS fits, md5(rtrim(regexp_replace(l, '\s+', ' ', 'g'), '. ') || '.mkv') AS fitted_md5 FROM p
"""

_SOUNDS = [("{w}", 0), ("[{w}]", 1), ("((((((({w}) {w}))))))", 1), ("[door] {w}", 0), ("*{w}* (sighs)", 1), ("*{w}* {w}", 0), ("♪ ♫", 1), ("...", 0), ("({w}", 1), ("[a [b (c] d) e] {w}", 0), (")) {w}", 0), ("[[{w}]", 1)]


def sca25_sound_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is heard is a sound and no speech: words within brackets at any depth, or asterisks. And why it does not count."""
    from cinelake.operators import segments

    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"(\p{L}+)", 1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(_pick([f for f, _ in _SOUNDS], F.col("conv_id") + F.col("turn")), F.lit("{w}"), F.concat(F.lit("x"), word)).alias("text"))
    reason = segments.own_reason(F.col("text"), F.when(F.col("turn") % 5 == 0, 0.7).otherwise(0.1), F.lit(-1.5), F.when(F.col("turn") % 7 == 3, 2.5).otherwise(1.0))
    return rows.select("conv_id", "turn", T.is_sound_description(F.col("text")).alias("is_sound"), reason.alias("reason"))


_SOUNDS_SQL = (
    f"WITH s AS (SELECT conv_id, turn, {[v for _, v in _SOUNDS]}[(conv_id + turn) % {len(_SOUNDS)} + 1] = 1 AS is_sound FROM conversations) "
    "SELECT *, CASE WHEN turn % 7 = 3 THEN 'highCompressionRatio' WHEN is_sound OR turn % 5 = 0 THEN 'noSpeech' END AS reason FROM s"
)

_ACCENTED = "".join(c for chars in words.ACCENTS.values() for c in chars if len(chars) > 1 or chars in "łř")
_BASES = "".join(base for base, chars in words.ACCENTS.items() for c in chars if len(chars) > 1 or chars in "łř")


def sca04_folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each conversation turn's tokens carry content, and what all of them are, accents folded."""

    def run(batches):
        for b in batches:
            told = [words.words(t) for t in b.text]
            b["n_words"], b["n_content"], b["words"] = [len(w) for w in told], [sum(map(words.is_content, w)) for w in told], [" ".join(w) for w in told]
            yield b[["conv_id", "turn", "n_words", "n_content", "words"]]

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id bigint, turn bigint, n_words bigint, n_content bigint, words string")
    return turns.select("conv_id", "turn", "n_words", "n_content", F.md5("words").alias("words_md5"))


_FOLDED_SQL = (
    "WITH t AS (SELECT conv_id, turn, regexp_extract_all(replace(replace(replace(translate(lower(coalesce(text, '')), '" + _ACCENTED + "', '" + _BASES + "'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '\\pL+') AS w FROM conversations) "
    "SELECT conv_id, turn, len(w)::BIGINT AS n_words, len(list_filter(w, lambda x: NOT list_contains(string_split('" + " ".join(sorted(words.STOPWORDS | words.FILLERS)) + "', ' '), x)))::BIGINT AS n_content, md5(array_to_string(w, ' ')) AS words_md5 FROM t"
)


def sca02_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys, years and ordinals spelt out."""

    def run(batches):
        for b in batches:
            b["key"] = [" ".join(words.number_words(str(k))) for k in b.o_orderkey]
            b["ordinal"] = [" ".join(words.words(f"{k % 100 + 1}th")) for k in b.o_orderkey]
            b["padded"] = [" ".join(words.words(f"0{k % 1000} {k % 100}.{k % 10}")) for k in b.o_orderkey]
            yield b[["o_orderkey", "key", "ordinal", "padded"]]

    return table(spark, sf_dir, "orders").select("o_orderkey").mapInPandas(run, "o_orderkey bigint, key string, ordinal string, padded string")


def _numbers_sql() -> str:
    ones, tens = "string_split('" + " ".join(words.ONES) + "', ' ')", "string_split('" + " ".join(words.TENS) + "', ' ')"
    below100 = lambda n: f"CASE WHEN {n} < 20 THEN {ones}[{n} + 1] ELSE {tens}[{n} // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || {ones}[{n} % 10 + 1] ELSE '' END END"
    below1000 = lambda n: f"CASE WHEN {n} < 100 THEN {below100(n)} ELSE {ones}[{n} // 100 + 1] || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' ' || {below100(f'({n} % 100)')} ELSE '' END END"
    year = f"{below100('(n // 100)')} || CASE WHEN n % 100 = 0 THEN ' hundred' WHEN n % 100 < 10 THEN ' oh ' || {ones}[n % 100 + 1] ELSE ' ' || {below100('(n % 100)')} END"
    cardinal = f"CASE WHEN n < 1000 THEN {below1000('n')} WHEN n BETWEEN 1100 AND 1999 OR n BETWEEN 2010 AND 2099 THEN {year} ELSE {below1000('(n // 1000)')} || ' thousand' || CASE WHEN n % 1000 > 0 THEN ' ' || {below1000('(n % 1000)')} ELSE '' END END"
    last = "list_extract(string_split(c, ' '), -1)"
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.ORDINALS.items())
    ordinal = f"array_to_string(string_split(c, ' ')[:-2], ' ') || CASE WHEN contains(c, ' ') THEN ' ' ELSE '' END || CASE {last} {irregular} ELSE CASE WHEN ends_with({last}, 'y') THEN {last}[:-2] || 'ieth' ELSE {last} || 'th' END END"
    return (
        f"WITH o AS (SELECT o_orderkey, o_orderkey AS n FROM orders), k AS (SELECT *, {cardinal} AS key FROM o), "
        f"d AS (SELECT o_orderkey, key, {below100('(n % 100)')} AS small, (n % 100 + 1) AS n, n AS whole FROM k), e AS (SELECT *, {below1000('n')} AS c FROM d) "
        f"SELECT o_orderkey, key, {ordinal} AS ordinal, 'zero ' || array_to_string(list_transform(string_split((whole % 1000)::VARCHAR, ''), lambda x: {ones}[x::INTEGER + 1]), ' ') || ' ' || small || ' point ' || {ones}[whole % 10 + 1] AS padded FROM e"
    )


def sca09_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity by common subsequence, of parts' names and types and of their word codes."""

    def run(batches):
        for b in batches:
            b["ratio"] = [similarity.ratio(x, y) for x, y in zip(b.p_name, b.p_type, strict=True)]
            b["codes"] = [similarity.code_overlap([f"{x} {n % 3}" for x in "abcd"[: n % 5]], [f"{x} {n % 2}" for x in "bdca"[: n % 4]]) for n in b.p_partkey]
            b["part"] = [similarity.partial_ratio(x, f"{y} {x[: n % 9]}") for x, y, n in zip(b.p_name, b.p_type, b.p_partkey, strict=True)]
            yield b[["p_partkey", "ratio", "codes", "part"]]

    made = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("p_name"), F.lower("p_type").alias("p_type")).mapInPandas(run, "p_partkey bigint, ratio double, codes double, part double")
    return made.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("ratio", "codes", "part")))


def _lcs_sql(a: str, b: str) -> str:
    """Length of the common subsequence of two short lists: rows of the table as lists, each a running maximum."""
    row = f"list_transform(range(len({a})), lambda i: CASE WHEN {a}[i + 1] = y[1] THEN coalesce(acc[i], 0) + 1 ELSE acc[i + 1] END)"
    run = f"list_transform(range(len({a})), lambda k: list_max({row}[1:k + 1]))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_extract(list_reduce(list_prepend(list_transform({a}, lambda z: 0), list_transform({b}, lambda z: [z])), lambda acc, y: {run}), -1) END"


def _ratios_sql() -> str:
    chars = lambda c: f"list_transform(string_split({c}, ''), lambda z: unicode(z)::BIGINT)"
    return (
        "WITH p AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS t FROM part), q AS (SELECT *, t || ' ' || substr(n, 1, (p_partkey % 9)::INTEGER) AS h FROM p), "
        "s AS (SELECT *, CASE WHEN length(n) <= length(h) THEN n ELSE h END AS needle, CASE WHEN length(n) <= length(h) THEN h ELSE n END AS hay FROM q), "
        "w AS (SELECT p_partkey, needle, unnest(list_concat(list_transform(range(length(hay) - length(needle) + 1), lambda i: substr(hay, (i + 1)::INTEGER, length(needle))), "
        "list_transform(range((length(needle) + 1) // 2, length(needle)), lambda k: substr(hay, 1, k::INTEGER)), list_transform(range((length(needle) + 1) // 2, length(needle)), lambda k: right(hay, k::INTEGER)))) AS v FROM s), "
        f"l AS (SELECT p_partkey, needle, v, {chars('needle')} AS a, {chars('v')} AS b FROM w), "
        f"m AS (SELECT p_partkey, max(2 * ({_lcs_sql('a', 'b')}) / (length(needle) + length(v))) AS part FROM l GROUP BY p_partkey), "
        f"r AS (SELECT p_partkey, {chars('n')} AS a, {chars('t')} AS b, list_transform(range(p_partkey % 5), lambda i: [10, 20, 30, 40][i + 1] + p_partkey % 3) AS c, list_transform(range(p_partkey % 4), lambda i: [20, 40, 30, 10][i + 1] + p_partkey % 2) AS d FROM p) "
        f"SELECT p_partkey, round(2 * ({_lcs_sql('a', 'b')}) / (len(a) + len(b)), 6) AS ratio, round(CASE WHEN len(c) + len(d) = 0 THEN 1 ELSE 2 * ({_lcs_sql('c', 'd')}) / (len(c) + len(d)) END, 6)::DOUBLE AS codes, round(part, 6) AS part FROM r JOIN m USING (p_partkey)"
    )


_TITLE_FORMS = [("The {a} ({b} [old]) {c}", "the {a} {c}"), ("Mr. {a} vs. Dr. {c}", "mister {a} versus doctor {c}"), ("{a}'s TV & [x] {c}", "{a}s t v and {c}"), ("({a})", ""), ("{a}) {c}", "{a} {c}"), ("Ok, {c}: 50%", "okay {c} fifty percent")]


def sca13_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of titles outside brackets with abbreviations spelt out, how telling they are, and runs of three of them."""

    def run(batches):
        for b in batches:
            own = [words.title_words(t) for t in b.title]
            b["words"], b["telling"] = [" ".join(w) for w in own], [words.title_specificity(w) for w in own]
            b["runs"] = ["|".join(phonetic.shingles(w, 3)) for w in own]
            yield b[["p_partkey", "words", "telling", "runs"]]

    title = _pick([f for f, _ in _TITLE_FORMS], F.col("p_partkey"))
    for hole, value in (("a", F.split("p_name", " ")[0]), ("b", F.lower("p_type")), ("c", F.split("p_name", " ")[1])):
        title = F.replace(title, F.lit("{" + hole + "}"), value)
    made = table(spark, sf_dir, "part").select("p_partkey", title.alias("title")).mapInPandas(run, "p_partkey bigint, words string, telling double, runs string")
    return made.withColumn("telling", F.round("telling", 6))


_TITLE_WORDS_SQL = (
    "WITH t AS (SELECT p_partkey, replace(replace(" + _pick_sql([w for _, w in _TITLE_FORMS], "p_partkey") + ", '{a}', split_part(p_name, ' ', 1)), '{c}', split_part(p_name, ' ', 2)) AS words FROM part), "
    "w AS (SELECT *, CASE WHEN words = '' THEN [] ELSE string_split(words, ' ') END AS w FROM t), "
    "n AS (SELECT *, list_sum(list_transform(list_filter(w, lambda x: NOT list_contains(string_split('" + " ".join(sorted(words.STOPWORDS | words.FILLERS)) + "', ' '), x)), lambda x: length(x))) AS n FROM w) "
    "SELECT p_partkey, words, round(CASE WHEN coalesce(n, 0) = 0 THEN 0.15 ELSE least(1.0, greatest(0.25, n / 10)) END, 6)::DOUBLE AS telling, "
    "CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_transform(range(greatest(1, len(w) - 2)), lambda i: array_to_string(w[i + 1:i + 3], ' ')), '|') END AS runs FROM n"
)

_FOLDER_FORMS = [
    ("/rips/{n} Season {k} Disc 2", "{n}"), ("/rips/{n}/season_{k}/BD1", "{n}"), ("C:\\m\\{N}_D{k}", "{T}"), ("/r/{n} (19{k}0) DVD", "{n}"), ("/r/{n} Volume {k}", "{n} Volume {k}"),
    ("/S{k}D9", ""), ("/{n}/makemkv/s0{k}", "{n}"), ("/r/{n}.and.the.{n}", "{n} and the {n}"), ("/x/THE_{N}_OF_{N}", "The {T} of {T}"),
]


def sca21_show_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows told by the names of folders that discs are kept in."""
    folder = _pick([f for f, _ in _FOLDER_FORMS], F.col("p_partkey"))
    first = F.split("p_name", " ")[0]
    for hole, value in (("{n}", F.initcap(first)), ("{N}", F.upper(first)), ("{k}", (F.col("p_size") % 9 + 1).cast("string"))):
        folder = F.replace(folder, F.lit(hole), value)
    return table(spark, sf_dir, "part").select("p_partkey", subtitles.column_udf(naming.guess_show)(folder).alias("show"))


_FOLDERS_SQL = (
    "WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, (p_size % 9 + 1)::VARCHAR AS k FROM part), n AS (SELECT *, upper(w[1]) || lower(w[2:]) AS t FROM p) "
    "SELECT p_partkey, nullif(replace(replace(replace(" + _pick_sql([w for _, w in _FOLDER_FORMS], "p_partkey") + ", '{n}', t), '{T}', t), '{k}', k), '') AS \"show\" FROM n"
)


QUERIES = {f.__name__: f for f in (src03_paths, sca17_titles, fil07_languages, sca28_dates_and_times, sca30_rate_limits, sca50_display, sca53_sentences, sca45_safe_names, sca25_sound_descriptions, sca04_folded_words, sca02_number_words, sca09_ratios, sca13_title_words, sca21_show_names)}
ORACLE_SQL = {
    "src03_paths": _PATHS_SQL,
    "sca17_titles": _TITLES_SQL,
    "fil07_languages": _LANGUAGES_SQL,
    "sca28_dates_and_times": _TIMES_SQL,
    "sca30_rate_limits": _WAITS_SQL,
    "sca50_display": _DISPLAY_SQL,
    "sca53_sentences": _SENTENCES_SQL,
    "sca45_safe_names": _SAFE_SQL,
    "sca25_sound_descriptions": _SOUNDS_SQL,
    "sca04_folded_words": _FOLDED_SQL,
    "sca02_number_words": _numbers_sql(),
    "sca09_ratios": _ratios_sql(),
    "sca13_title_words": _TITLE_WORDS_SQL,
    "sca21_show_names": _FOLDERS_SQL,
}
