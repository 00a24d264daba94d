"""Operators over small tables."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cinelake.functions import text as T
from cinelake.operators import assignment, audio, intervals, library, renames, scoring, segments, tfidf
from cinelake.sources import cache, probe
from cinelake.streaming import folds


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_windows_merge_where_they_touch(spark):
    w = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 20.0), (1, 21.0, 22.0), (1, 5.0, 6.0), (1, float("nan"), 9.0), (2, 3.0, 4.0)], "f int, start_s double, end_s double")
    assert sorted(map(tuple, intervals.merge_windows(w, ["f"]).collect())) == [(1, 0.0, 20.0), (1, 21.0, 22.0), (2, 3.0, 4.0)]
    files = spark.createDataFrame([(1, 30.0), (3, 5.0)], "f int, duration_s double")
    assert sorted(map(tuple, intervals.gaps(files, w, ["f"]).collect())) == [(1, 20.0, 21.0), (1, 22.0, 30.0), (3, 0.0, 5.0)]


def test_planned_and_next_windows(spark):
    files = spark.createDataFrame([(1, 300.0), (2, 1200.0), (3, None), (4, -1.0)], "f int, duration_s double")
    plan = intervals.plan_windows(files, ["f"])
    got = sorted(map(tuple, plan.collect()))
    assert got[0] == (1, 0.0, 300.0) and [g[1:] for g in got[1:]] == [(127.5, 232.5), (427.5, 532.5), (727.5, 832.5), (967.5, 1072.5)]
    more = sorted(map(tuple, intervals.escalation_windows(files, plan, ["f"]).collect()))
    assert [m[0] for m in more] == [2, 2, 2] and more[0][1:] == (277.5, 382.5)
    assert len(intervals.escalation_windows(files, plan, ["f"], whole_file=True).filter("f = 2").collect()) == 5


def test_speech_layout_maps_back(spark):
    r = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.2, 3.0), (1, 5.0, 6.0)], "f int, start_s double, end_s double")
    layout = intervals.speech_layout(r, ["f"])
    assert [tuple(x)[1:] for x in layout.orderBy("start_s").collect()] == [(1.0, 3.0, 0.0), (5.0, 6.0, 2.2)]
    times = spark.createDataFrame([(1, 0.5), (1, 2.1), (1, 2.7)], "f int, at_s double")
    assert [round(x.original_s, 6) for x in intervals.to_original(times, layout, ["f"]).orderBy("at_s").collect()] == [1.5, 3.0, 5.5]


@pytest.mark.parametrize("file_s, runtime_s, want", [(600.0, None, None), (600.0, float("nan"), None), (float("nan"), 600.0, 0.0), (0.0, 600.0, 0.0), (650.0, 600.0, 1.0), (1300.0, 1800.0, 0.9), (900.0, 600.0, math.exp(-(240 / 150) ** 2))])
def test_duration_fit(spark, file_s, runtime_s, want):
    got = one(spark, scoring.duration_fit(F.lit(file_s).cast("double"), F.lit(runtime_s).cast("double")))
    assert got == want if want is None else abs(got - want) < 1e-9


def test_unmeasured_signals_are_left_out(spark):
    c = lambda d=None, t=None, u=None, o=None, gate=False, music=False: one(spark, scoring.combine(*(F.lit(x).cast("double") for x in (d, t, u, o)), F.lit(gate), F.lit(music)))
    assert c(u=1.0) == 1.0 and c(t=0.0, u=1.0) < 1.0 and c() == 0.0
    assert c(d=0.05, t=0.0, u=1.0, gate=True) < 0.25 < c(d=0.05, t=0.9, u=1.0, gate=True)
    assert c(d=0.3, t=1.0, gate=True, music=True) > c(d=0.3, t=1.0, gate=True)


def test_disc_slots_and_order(spark):
    def slots(rows):
        df = spark.createDataFrame([(1, i, c, s, e) for i, (c, s, e) in enumerate(rows)], "job_id int, order_index int, chapter int, start_s double, end_s double")
        return [r.slot for r in scoring.disc_slots(df).orderBy("order_index").collect()]

    assert slots([(0, 0.0, 600.0), (1, 600.0, 1200.0), (3, 1800.0, 2400.0), (4, 2400.0, 3000.0)]) == [0, 1, 3, 4]
    assert slots([(0, 0.0, 600.0), (2, 630.0, 1230.0)]) == [0, 1] and slots([(None, 0.0, 600.0), (None, 1200.0, 1800.0)]) == [0, 1]
    assert slots([(0, 0.0, 600.0), (5, 600.0, 1200.0), (10, 1200.0, 1800.0)]) == [0, 1, 2]
    df = spark.createDataFrame([(1, 0, 0, 2, 2), (1, 1, 1, 3, None), (1, 2, 2, 5, None), (1, 3, 3, 6, 6), (2, 0, 0, 5, 5)], "job_id int, rank int, slot int, episode int, anchor int")
    near = scoring.nearest_anchors(df)
    got = {(r.job_id, r.rank): r.s for r in near.select("*", scoring.order_signal(F.col("episode"), F.col("slot"), F.col("before"), F.col("after")).alias("s")).collect()}
    assert got[1, 1] == 1.0 and got[1, 2] == 1.0 and got[2, 0] is None


def test_play_all_by_chapters(spark):
    files = spark.createDataFrame([(1, "all", 1800.0), (1, "a", 600.0), (1, "b", 610.0), (1, "c", 590.0), (2, "x", 5.0), (2, "y", 4.0)], "disc int, file_id string, duration_s double")
    chapters = spark.createDataFrame([(1, "all", 600.0), (1, "all", 609.0), (1, "all", 20.0)], "disc int, file_id string, chapter_s double")
    plain, told = (scoring.play_all(files, ["disc"], c).collect() for c in (None, chapters))
    assert len(plain) == 1 and not plain[0].is_play_all  # 1800 / 610 is below 3
    assert told[0].is_play_all and told[0].matched == 2 and told[0].file_id == "all"


def test_assignment_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(150):
        f, e = rng.integers(1, 5, 2)
        s, skip = rng.random((f, e)).round(3), rng.random(f) * 0.4
        choices = [p for p in itertools.product([None, *range(e)], repeat=f) if len(q := [c for c in p if c is not None]) == len(set(q))]
        total = lambda p, none: sum(s[i, c] if c is not None else none[i] for i, c in enumerate(p))
        flat = np.full(f, 0.25)
        assert abs(total(assignment.hungarian(s, 0.25), flat) - max(total(p, flat) for p in choices)) < 1e-5
        rising = [p for p in choices if (q := [c for c in p if c is not None]) == sorted(q)]
        assert abs(total(assignment.in_order(s, skip), skip) - max(total(p, skip) for p in rising)) < 1e-9
    assert assignment.hungarian(np.array([[np.nan, 0.9]]), 0.25) == [1] and assignment.hungarian(np.array([[-np.inf]]), 0.25) == [None]
    assert assignment.longest_increasing([3, 1, 2, 2, 5]) == 3 and assignment.longest_increasing([]) == 0


def test_assignment_by_job(spark):
    rows = [(j, f, e, s, s, True, None, False) for j in (1, 2) for f, e, s in [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.1 * j), (2, 0, 0.0), (2, 1, 0.0)]]
    df = spark.createDataFrame(rows, "job int, file int, episode int, content double, final double, heard boolean, rank int, special boolean")
    got = {(r.job, r.file): r.episode for r in assignment.assign(df, "job", "file", "episode").collect()}
    assert got == {(j, f): e for j in (1, 2) for f, e in ((0, 1), (1, 0), (2, None))}


def test_fingerprints_locate():
    x = np.random.default_rng(0).standard_normal(16000 * 40)
    hay, s = audio.fingerprint([x])
    again, _ = audio.fingerprint(x[i : i + 16000] for i in range(0, len(x), 16000))
    assert (hay == again).all() and hay.dtype == np.int8
    needle, _ = audio.fingerprint([0.5 * x[16000 * 20 + 100 : 16000 * 30]])
    offset, length, score = audio.locate(needle, hay, s, s)
    assert abs(offset - 20) < 0.07 and score > 0.5 and audio.locate(needle[:50], hay, s, s) is None and audio.locate(needle, hay, s, 0.1) is None
    a = pd.DataFrame({"file_id": ["a", "b", "c"], "offset_s": [0.0, 600.0, 610.0], "length_s": [600.0, 600.0, 600.0], "score": [0.9, 0.8, 0.5]})
    kept, problem = audio.disc_order(a, [(0.0, 600.0), (600.0, 1200.0)], 3)
    assert kept.file_id.tolist() == ["a", "b"] and kept.chapter.tolist() == [0, 1] and problem is None


def test_numbering(spark):
    e = spark.createDataFrame([(1, 10, 1, 1, "2001"), (1, 11, 1, None, ""), (1, 12, None, None, "2000"), (1, 13, None, 4, None)], "show int, id int, season int, number int, airdate string")
    assert {r.id: (r.season, r.number) for r in library.aired_numbering(e, ["show"]).collect()} == {10: (1, 1), 11: (0, 2), 12: (0, 1), 13: (0, 3)}
    g = spark.createDataFrame([(1, 1, "Specials 9"), (1, 2, "Book Three"), (1, 3, "Season 7"), (1, 4, "x")], "show int, order int, name string")
    assert [r.season for r in library.group_numbering(g, ["show"]).orderBy("order").collect()] == [0, 1, 7, 3]


def test_cascade_and_summaries(spark):
    eps = spark.createDataFrame([(1, "s"), (2, "s"), (3, " "), (4, None)], "number int, summary string")
    a = spark.createDataFrame([(1, "subtitles", "a")], "number int, kind string, text string")
    b = spark.createDataFrame([(1, "lyrics", "b"), (2, "lyrics", "b")], "number int, kind string, text string")
    found = library.cascade(eps, [a, b], ["number"])
    assert sorted((r.number, r.text, r.provider_rank) for r in found.collect()) == [(1, "a", 0), (2, "b", 1)]
    eps2 = eps.union(spark.createDataFrame([(5, "five")], eps.schema))
    assert sorted(r.number for r in library.with_summaries(eps2, found, ["number"]).collect()) == [1, 2, 5]


def test_files_by_marker_or_title(spark):
    eps = spark.createDataFrame([(1, 1, 1, "Pilot"), (1, 1, 2, "The Pilot Returns"), (1, 2, 5, "End")], "show int, season int, number int, title string")
    files = spark.createDataFrame([(1, "s02e05 pilot.srt"), (1, "the pilot returns.srt"), (1, "other.srt")], "show int, name string")
    got = {r.name: (r.season, r.number) for r in library.file_for(files, eps, ["show"]).collect()}
    assert got == {"s02e05 pilot.srt": (2, 5), "the pilot returns.srt": (1, 2)}


@pytest.mark.parametrize("name, want", [
    ("Show.S01E02.mkv", (1, 2)), ("show 1x02", (1, 2)), ("1x2", None), ("Season 3 Episode 4", (3, 4)), ("season 3, ep. 12", (3, 12)), ("s1-e7", (1, 7)), ("1x03 s02e04", (1, 3)), ("bones1e2", None),
    ("s0001e2", None), ("a1x02", None), ("S1 E05", (1, 5)),
])
def test_markers(spark, name, want):
    got = one(spark, T.episode_marker(F.lit(name)))
    assert (tuple(got) if got else None) == want


def test_scalars(spark):
    v = lambda c: one(spark, c)
    L = F.lit
    assert v(T.squash(L("Tom & Jerry's É"))) == "tomandjerrysé" and v(T.contains_words(L("The Train Job"), L("train job"))) and not v(T.contains_words(L("x"), L("!")))
    assert v(T.parse_clock(L("1:02:03.5"))) == 3723.5 and v(T.parse_clock(L("x"))) is None and v(T.clock(L(3725.4))) == "1:02:05" and v(T.clock(L(65.0))) == "1:05"
    assert v(T.srt_time(L(3723.0456))) == "01:02:03,046" and v(T.as_text(L("=1+1"))) == "'=1+1" and v(T.as_text(L("a"))) == "a"
    assert v(T.strip_html(L("<p>A<i>b</i>c</p><br/>d &amp; e , f<"))) == "Abc d & e, f<" and v(T.season_from_folder(L("/x/Season 2"))) == 2 and v(T.season_from_folder(L("/x/Discs2"))) is None
    assert v(T.is_sound_description(L("[door (slams)] ♪"))) and not v(T.is_sound_description(L("[door] hi"))) and not v(T.is_sound_description(L("...")))
    assert v(T.is_known_hallucination(L("thank you thank you"))) and v(T.is_known_hallucination(L("subtitles by me"))) and not v(T.is_known_hallucination(L("thank you all")))
    assert v(T.languages_match(L("EN"), L("eng"))) and v(T.languages_match(L("ger"), L("deu"))) and not v(T.languages_match(L(""), L(""))) and v(T.language_code(L("pt-br"))) == "BR_PT" and v(T.language_code(L("en-US"))) == "EN"
    assert v(T.has_video_extension(L("a.b.MKV"))) and not v(T.has_video_extension(L("mkv"))) and v(T.is_plain_absolute(L("/a/b"))) and not v(T.is_plain_absolute(L("/a/../b")))


def test_segments(spark):
    rows = [(1, 0.0, "So it goes.", 0.1, -0.2), (1, 1.0, "so it goes", 0.1, -0.2), (1, 2.0, "[bang]", 0.1, -0.2), (1, 3.0, "So it goes!", 0.1, -0.2), (1, 4.0, "la " * 200, 0.1, -0.2), (1, 5.0, "mumble", 0.9, -2.0), (1, 6.0, "Thank you.", 0.1, -0.1), (1, 7.0, "Real words", 0.1, -0.1)]
    df = spark.createDataFrame([(*r, None) for r in rows], "f int, start_s double, text string, no_speech_prob double, avg_logprob double, filtered string").withColumn("end_s", F.col("start_s") + 1)
    marked = segments.mark(df, ["f"], ["start_s"])
    got = [r.filtered for r in marked.orderBy("start_s").collect()]
    assert got == [None, "repeated", "noSpeech", None, "highCompressionRatio", "noSpeech", "knownHallucination", None]
    assert segments.matching_text(marked, ["f"], ["start_s"]).first().text == "So it goes. So it goes! Real words"
    srt = segments.heard_srt(marked, ["f"]).first().srt
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,000\nSo it goes.\n\n2\n") and srt.count("-->") == 3


def test_cache(spark):
    old = spark.createDataFrame([("a", 1, 10, "x"), ("b", 1, 10, "y")], "provider string, key int, fetched_at_ms bigint, body string")
    new = spark.createDataFrame([("a", 1, 10, "z"), ("c", 1, 5, "w")], old.schema)
    assert sorted((r.provider, r.body) for r in cache.upsert(old, new, ["provider", "key"]).collect()) == [("a", "z"), ("b", "y"), ("c", "w")]
    age = lambda d: one(spark, cache.freshness(F.lit(int(d * cache.DAY_MS)), 7, 30))
    assert [age(1), age(8), age(31)] == ["fresh", "stale", "expired"]
    headers = lambda **h: one(spark, cache.retry_after_ms(F.create_map(*[F.lit(x) for k, v in h.items() for x in (k.replace("_", "-"), v)]), F.lit(1_700_000_000_000)))
    assert headers(retry_after="3") == 3000 and headers(x_ratelimit_remaining="0") == 1000 and headers(x_ratelimit_remaining="0", x_ratelimit_reset="1700000002") == 2000 and headers(x="1") is None


def test_probe(spark):
    raw = '{"format":{"format_name":"mkv"},"streams":[{"index":0,"codec_type":"video","width":9,"height":9,"disposition":{"attached_pic":1}},{"index":1,"codec_type":"video","width":16,"height":9},{"index":2,"codec_type":"audio","codec_name":"aac","channels":2,"duration":"bad","tags":{"LANGUAGE":"und","Duration":"00:10:00.5"}},{"index":3,"codec_type":"audio","tags":{"language":"eng"},"disposition":{"default":1}}],"chapters":[{"start_time":"5","end_time":"9","tags":{"title":" "}},{"start_time":"0","end_time":"5","tags":{"title":"One"}}]}'
    p = one(spark, probe.parse(F.lit(raw)))
    assert p.duration_s == 600.5 and (p.video.width, p.video.height) == (16, 9) and [a.language for a in p.audio_streams] == [None, "eng"]
    assert [(c["index"], c.start_s, c.title) for c in p.chapters] == [(0, 0.0, "One"), (1, 5.0, None)]
    assert one(spark, probe.parse(F.lit("{}"))).duration_s is None
    assert one(spark, probe.choose_audio(probe.parse(F.lit(raw))["audio_streams"], F.lit("fr"))) == 3
    files = spark.createDataFrame([("a.mkv",), (".b.mkv",), ("VIDEO_TS/c.vob",), ("sub/d.avi",), ("e.txt",), ("x/index.bdmv",)], "path string")
    assert [r.path for r in probe.listed(files).collect()] == ["a.mkv"] and sorted(r.path for r in probe.listed(files, True).collect()) == ["a.mkv", "sub/d.avi"]
    assert sorted(map(tuple, probe.disc_folders(files).collect())) == [("VIDEO_TS", "dvd"), ("x", "bluRay")]


def test_plans(spark):
    files = spark.createDataFrame([(1, "a", "candidate"), (1, "b", "playAll"), (1, "c", "ignored"), (1, "d", "candidate"), (1, "e", "candidate")], "job_id int, file_id string, role string")
    decisions = spark.createDataFrame([(1, "a", "approved", 1, 1), (1, "d", "notAnEpisode", None, None)], "job_id int, file_id string, decision string, season int, number int")
    matches = spark.createDataFrame([(1, "e", "Extra")], "job_id int, file_id string, verdict string")
    eps = spark.createDataFrame([(1, 1, 1, "Pilot")], "job_id int, season int, number int, title string")
    got = {r.file_id: r.outcome for r in renames.placements(files, decisions, matches, eps).collect()}
    assert got == {"a": "item", "b": "playAll", "c": "skipped", "d": "extra", "e": "extra"}
    items = spark.createDataFrame([(1, "a", "/i/1", "/o/X", 5), (1, "b", "/i/2", "/o/x", 5), (1, "c", "/i/3", "/o/z", 5), (1, "d", "/o/Z", "/o/q", 9), (1, "e", "/i/5", "/o/t", 5)], "job_id int, file_id string, `from` string, `to` string, size_bytes bigint")
    disk = spark.createDataFrame([(1, p, 5) for p in ("/i/1", "/i/2", "/i/3", "/i/5", "/O/T")] + [(1, "/o/Z", 9)], "job_id int, path string, size_bytes bigint")
    found = lambda move: sorted((r.kind, ",".join(r.file_ids)) for r in renames.conflicts(items, disk, move).collect())
    assert found(True) == [("duplicateTarget", "a,b"), ("targetExists", "e")] and found(False) == [("duplicateTarget", "a,b"), ("targetExists", "c"), ("targetExists", "e")]
    assert renames.same_plan(items, items) and not renames.same_plan(items, items.limit(2))
    tree = renames.preview_tree(spark.createDataFrame([(1, "S/1/a"), (1, "S/1/b"), (1, "S/2/c")], "job_id int, `to` string")).orderBy("to", "pos").collect()
    assert [r.line for r in tree] == ["S/1", "a", "b", "S/2", "c"]


def test_journal(spark):
    lines = ['{"kind":"intent","entry":"e","op":0,"item":"x"}', '{"kind":"begin","entry":"e","createdMs":5}', '{"kind":"intent","entry":"e","op":1,"action":"move","item":"x","from":"/a","to":"/t"}', "{torn", '{"kind":"done","entry":"e","op":1}', '{"kind":"intent","entry":"e","op":2,"action":"move","item":"x","from":"/t","to":"/b"}', '{"kind":"failed","entry":"e","op":2}', '{"kind":"done","entry":"e","op":2}', '{"kind":"intent","entry":"e","op":3,"action":"move","item":"y","from":"/c","to":"/d"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")
    ops = folds.operations(folds.read_journal(df))
    assert {(r.op, r.status) for r in ops.collect()} == {(1, "done"), (2, "done"), (3, "unknown")}
    assert [(r.item, r.original, r.current) for r in folds.moves(ops).collect()] == [("x", "/a", "/b")]
    there = folds.operations(folds.read_journal(df), spark.createDataFrame([("/d",)], "path string"))
    assert {r.status for r in there.collect()} == {"done"}
    assert [(r.entry, r["items"]) for r in folds.history(folds.read_journal(df), ops).collect()] == [("e", 1)]


def test_stream_fold_equals_the_batch(spark, tmp_path):
    rows = [(k % 3, k, None if k % 4 == 0 else f"v{k}") for k in range(20)]
    schema = "job int, seq bigint, stage string"
    for part in range(2):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = folds.fold_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "job", "stage", "seq")
    q = stream.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.job: r.stage for r in spark.sql("select job, max_by(stage, seq) as stage from folded group by job").collect()}
    batch = folds.fold_events(spark.createDataFrame(rows, schema), ["job"], ["stage"], "seq")
    assert last == {r.job: r.stage for r in batch.collect()}


def test_phrases_split_evenly(spark):
    df = spark.range(1, 60).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("pos")).select("n", "pos", tfidf.phrase_no(F.col("pos"), F.col("n")).alias("p"))
    for n, rows in itertools.groupby(sorted(map(tuple, df.collect())), key=lambda r: r[0]):
        sizes = [len(list(g)) for _, g in itertools.groupby(r[2] for r in rows)]
        assert all(s == 6 for s in sizes[:-1]) and (n < 6 or 3 <= sizes[-1] <= 8)


def test_keywords_are_heard_by_word_or_sound(spark):
    from cinelake.operators import coverage

    items = spark.createDataFrame([(1, "the knight rides a lamp"), (2, "a smith")], "id int, text string")
    heard = spark.createDataFrame([(7, "one night with a lamp"), (8, "mister smyth")], "doc int, text string")
    k = coverage.tokens(items, ["id"]).filter("length(word) >= 4").select("id", "word", "code", F.lit(1.0).alias("w"))
    hits = coverage.keyword_hits(k, coverage.tokens(heard, ["doc"]), "id", "doc")
    assert sorted((r.id, r.doc, r.word) for r in hits.collect()) == [(1, 7, "lamp"), (2, 8, "smith")]  # the code of "night" is too short
    scores = {(r.id, r.doc): round(r.score, 6) for r in coverage.summary_scores(k, coverage.tokens(heard, ["doc"]), "id", "doc").collect()}
    assert scores[2, 8] == 0.8 and scores[1, 7] == round(0.8 * (1 / 3 - 0.1) / 0.5, 6)


def test_phrases_survive_misheard_words(spark):
    from cinelake.operators import coverage

    text = "the old lamp went out over the quiet harbour while nobody was looking at the shore"
    docs = spark.createDataFrame([(1, text), (2, "entirely different matters were discussed at great length by the committee of elders")], "doc int, text string")
    heard = spark.createDataFrame([(9, text.replace("lamp", "lamb").replace("harbour", "harber"))], "q int, text string")
    d, h = coverage.tokens(docs, ["doc"]), coverage.tokens(heard, ["q"])
    df = d.select("doc", F.col("word").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    rows = coverage.phrase_coverage(h, d, coverage.phrases(h, df, F.lit(2), ["q"]), "q", "doc").collect()
    got = {r.doc: r.coverage for r in rows}
    assert got[1] > 0.9 and got.get(2, 0) < 0.1


def test_formats_and_reviews(spark):
    v = lambda c: one(spark, c)
    L = F.lit
    assert v(T.megabytes(L(1_234_567_890))) == "1,235 MB" and v(T.percent(L(1.2))) == "100%" and v(T.plural(L(1), "file")) == "1 file" and v(T.plural(L(1200), "file")) == "1,200 files"
    assert [v(T.time_left(L(float(s)))) for s in (59, 60, 150, 3700)] == ["Less than a minute left", "About 1 minute left", "About 3 minutes left", "About 1 h 2 min left"]
    now = 1_700_000_000_000
    assert [v(T.day(L(now - d * 86_400_000), L(now))) for d in (0, 1, 2, 400)] == ["Today", "Yesterday", "Nov 12", "Oct 10, 2022"]
    m = spark.createDataFrame([(1, "a", "Confident"), (1, "b", "Check"), (1, "c", "Extra"), (1, "d", "PlayAll")], "job int, file string, verdict string")
    r = spark.createDataFrame([(1, "a", "skip", False)], "job int, file string, choice string, approved boolean")
    both = renames.with_initial(r, m, ["job", "file"])
    got = {x.file: (x.choice, x.approved) for x in both.collect()}
    assert got == {"a": ("skip", False), "b": ("pending", False), "c": ("notAnEpisode", True)}
    shown = both.withColumn("category", renames.category(L(True), L("episode"), F.col("choice"), F.col("approved")))
    assert renames.category_counts(shown, ["job"]).drop("job").first().asDict() == {"approved": 0, "check": 1, "extra": 1, "skipped": 1, "playAll": 0, "waiting": 0}
    assert [x.file for x in shown.filter(renames.in_filter(F.col("category"), "extras")).collect()] == ["c"]


def test_correlations_at_offsets(spark):
    """All vectors divisible by 20 against all others, by hand."""
    from cinelake.plans import matching

    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {(r.query_id, r.vec_id, r.offset): r for r in matching.agg26_offset_correlation(spark, sf).collect()}
    want = [(q, v, o) for q in vectors if q % 20 == 0 for v in vectors if v != q for o in (-1, 0, 1)]
    assert sorted(got) == sorted(want)
    for q, v, o in want[:: max(1, len(want) // 3000)]:
        shared = [(x, vectors[v][i + o]) for i, x in enumerate(vectors[q]) if 0 <= i + o < len(vectors[v])]
        norm = sum(x * x for x, _ in shared) ** 0.5 * sum(y * y for _, y in shared) ** 0.5
        assert got[q, v, o].rows_inside == len(shared) and abs(got[q, v, o].correlation - (sum(x * y for x, y in shared) / norm if norm else 0)) < 1e-6


def invented(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice("tamber kestrel oblin farrow quist melder osk brindle havel sorrow the and of to".split()) for _ in range(n))


def plain_coverage(query, doc, n_docs, df):
    """Phrase by phrase: the rarest codes' places in the document, each window around them, the best ratio."""
    from cinelake.functions import phonetic, similarity, words

    asked, told = words.words(query), words.words(doc)
    codes, held = [phonetic.phonetic_code(w) for w in asked], [phonetic.phonetic_code(w) for w in told]
    last = max(0, (len(asked) + 3) // 6 - 1)
    hit = total = 0.0
    for k in range(last + 1):
        at = [i for i in range(len(asked)) if min(i // 6, last) == k]
        if not at:
            continue
        weight = sum(math.log(1 + (n_docs - df.get(asked[i], 1) + 0.5) / (df.get(asked[i], 1) + 0.5)) for i in at)
        places = sorted((held.count(codes[i]), i - at[0], p) for i in at for p, c in enumerate(held) if c == codes[i])[:12]
        starts = {p - off + s for _, off, p in places for s in (-1, 0, 1)}
        found = [similarity.ratio(" ".join(asked[i] for i in at), " ".join(told[s : s + len(at)])) for s in starts if 0 <= s and s + len(at) <= len(told)]
        hit += weight * min(1.0, max(0.0, (max(found, default=0.0) - 0.6) / 0.28))
        total += weight
    return hit / total if total else 0.0


def test_phrase_coverage_of_all_pairs(spark):
    from cinelake.functions import words
    from cinelake.operators import coverage

    queries = {k: invented(k, 5 + 4 * k) for k in range(6)} | {6: "", 7: None}
    docs = {k: (queries[k % 6] or "") + " " + invented(40 + k, 30) if k % 2 else invented(60 + k, 50) for k in range(7)}
    frame = lambda texts, key: spark.createDataFrame(list(texts.items()), f"{key} int, text string")
    heard = coverage.tokens(frame(queries, "q"), ["q"])
    frequency = heard.select("q", F.col("word").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    phrases = coverage.phrases(heard, frequency, F.lit(8), ["q"])
    got = {(r.q, r.d): r.coverage for r in coverage.phrase_coverage(heard, coverage.tokens(frame(docs, "d"), ["d"]), phrases, "q", "d").collect()}
    df = {}
    for t in queries.values():
        for w in set(words.words(t)):
            df[w] = df.get(w, 0) + 1
    for q, text in queries.items():
        for d, doc in docs.items():
            assert abs(got.get((q, d), 0.0) - plain_coverage(text, doc, 8, df)) < 1e-9
    assert any(v == 1 for v in got.values()) and any(0 < v < 0.9 for v in got.values())


def test_title_hook_against_every_window():
    from cinelake.functions import phonetic, similarity, words
    from cinelake.operators import coverage

    for seed in range(200):
        title, heard = invented(seed, 1 + seed % 4), invented(500 + seed, 12)
        if seed % 3 == 0:
            heard += " " + title
        own, text = words.words(title), words.words(heard)
        codes, told = [phonetic.phonetic_code(w) for w in own], [phonetic.phonetic_code(w) for w in text]
        best = 0.0
        for n in range(max(1, len(own) - 1), len(own) + 2):
            for s in range(len(text) - n + 1):
                if any(c in told[max(0, s - 1) : s + n + 1] for c in codes):
                    best = max(best, similarity.ratio(" ".join(own), " ".join(text[s : s + n])), 0.95 * similarity.ratio(codes, told[s : s + n]))
        most = min(1.0, max(0.0, (best - 0.7) / 0.25)) * words.title_specificity(own)
        got = coverage.title_hook(title, heard) or 0.0
        assert got <= most + 1e-9 and (seed % 3 or abs(got - words.title_specificity(own)) < 1e-9)
    assert coverage.title_hook("", "x") is None and coverage.title_hook("[gone]", "gone") is None and coverage.title_hook("x", "") is None


def test_scans_summarise_a_folder(spark):
    from cinelake.sources import probe

    files = spark.createDataFrame([("a.mkv",), ("b.mkv",), ("c.mkv",), ("d.mkv",), ("all.mkv",), ("x.txt",), ("bad.mkv",)], "path string")
    raw = lambda s: f'{{"format": {{"duration": "{s}"}}, "streams": [{{"index": 0, "codec_type": "audio"}}]}}'
    probes = spark.createDataFrame([(p, raw(s)) for p, s in (("a.mkv", 600), ("b.mkv", 610), ("c.mkv", 590), ("d.mkv", 600), ("all.mkv", 2400))] + [("bad.mkv", None)], "path string, raw string")
    found, summary = probe.scan(files, probes, "/rips/Salt Harbour Disc 2")
    assert {r.file_id: r.role for r in found.collect()} == {"a.mkv": "candidate", "b.mkv": "candidate", "c.mkv": "candidate", "d.mkv": "candidate", "all.mkv": "playAll", "bad.mkv": "ignored"}
    assert summary.first().asDict() == {"play_all": "all.mkv", "n_candidates": 4, "n_warnings": 1, "show_guess": "Salt Harbour"}


def test_assignment_of_many_jobs_at_once(spark):
    """Jobs of one shape are solved together, with each job's own result, wherever batches cut them; and not a job at a time."""
    import time

    rng = np.random.default_rng(7)
    for _ in range(60):
        b, n, m = (int(x) for x in rng.integers(1, 8, 3))
        content, final = (np.where(rng.random((b, n, m)) < 0.1, np.nan, rng.random((b, n, m)).round(1)) for _ in "ab")
        heard, rank, special = rng.random((b, n)) < 0.6, np.where(rng.random((b, n)) < 0.7, rng.integers(0, n, (b, n)), -1.0), rng.random((b, m)) < 0.2
        got, used = assignment.assign_jobs(content, final, heard, rank, special)
        for k in range(b):
            alone = assignment.assign_job(content[k], final[k], heard[k], rank[k], special[k])
            assert ([None if x < 0 else x for x in got[k].tolist()], bool(used[k])) == alone
    jobs, n = 4000, 4
    score = rng.random((jobs, n, n)).round(2)
    rows = pd.DataFrame({"job": np.repeat(np.arange(jobs), n * n), "file": np.tile(np.repeat(np.arange(n), n), jobs), "episode": np.tile(np.arange(n), jobs * n) * 10, "content": score.ravel(), "final": score.ravel(), "heard": True, "rank": np.nan, "special": False})
    df = spark.createDataFrame(rows.sample(frac=1, random_state=0)).withColumn("rank", F.lit(None).cast("int")).cache()
    df.count()
    start = time.perf_counter()
    got = {(r.job, r.file): r.episode for r in assignment.assign(df, "job", "file", "episode").collect()}
    took = time.perf_counter() - start
    assert len(got) == jobs * n
    start = time.perf_counter()
    want = {(k, f): e for k in range(jobs) for f, e in enumerate(assignment.assign_job(score[k], score[k], np.ones(n, bool), np.full(n, -1.0), np.zeros(n, bool))[0])}
    assert all((None if e is None else e * 10) == got[key] for key, e in want.items())
    assert took < 10 + 2 * (time.perf_counter() - start)


def test_correlations_of_all_are_those_of_each_pair(spark):
    """In blocks, of series of several lengths, as pair by pair; and half a million of them in no time."""
    import time

    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=(5, 8, 9)[k % 3]).round(2).tolist()) for k in range(40)] + [(40, [0.0] * 8), (41, [])]
    v = spark.createDataFrame(rows, "vec_id long, values array<float>")
    asked = v.filter("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = v.withColumnRenamed("values", "hay").crossJoin(asked.withColumnRenamed("values", "needle")).filter("query_id != vec_id")
    key = lambda r: (r.query_id, r.vec_id, r.offset, r.rows_inside)
    want = {key(r): r.correlation for r in audio.correlations(pairs, ["query_id", "vec_id"], 1).collect()}
    got = audio.correlations_of_all(asked, v, "query_id", "vec_id", 1, block=4).collect()
    assert len(got) == len(want) and all(abs(want[key(r)] - r.correlation) < 1e-9 for r in got)
    many = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("values")).cache()
    few = many.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    start = time.perf_counter()
    assert audio.correlations_of_all(few, many, "query_id", "vec_id", 1, digits=6).agg(F.sum("correlation")).count() == 1
    n = audio.correlations_of_all(few, many, "query_id", "vec_id", 1, digits=6).count()
    assert n == 150 * 2999 * 3 and time.perf_counter() - start < 20


def test_titles_of_a_list_are_heard_as_each_alone():
    """All windows of all titles at once, with the scores of each pair, odd titles and texts too; and not at a pair's price."""
    import time

    from cinelake.operators import coverage

    titles = [invented(k, 1 + k % 5) for k in range(150)] + ["", "[gone]", None, "of the and", "The " + "very " * 20 + "long title", "x " * 40]
    texts = [invented(900 + k, 80) for k in range(12)] + [None, "", "...", "the " * 700 + titles[3], "of the and a", titles[4] + " l'été " + titles[9], "x " * 50]
    ready = coverage.Titles(titles)
    start = time.perf_counter()
    got = [ready.scores(x) for x in texts]
    took = time.perf_counter() - start
    assert got == [[coverage.title_hook(t, x) for t in titles] for x in texts] and sum(x is not None for g in got for x in g) > 50
    assert time.perf_counter() - start > 4 * took


def test_dialogue_of_a_job_against_each_pair():
    """All files and references of a job at once: coverage, cosines and weights as pair by pair, long phrases and empty texts too."""
    from collections import Counter

    from cinelake.functions import words
    from cinelake.operators import dialogue

    told = [invented(k, 30 + 7 * k) for k in range(7)] + ["", "a " * 60, " ".join(w * 4 for w in invented(3, 20).split())]
    heard = [invented(40 + k, 25 + k) for k in range(5)] + [told[2], " ".join(told[5].split()[3:40]), None, "oblin", told[9]]
    word, code, covered, mean, typical = dialogue.of_job(heard, told)
    df = Counter(w for t in told for w in set(words.words(t)))
    for f, own in enumerate(heard):
        for d, text in enumerate(told):
            assert abs(covered[f, d] - plain_coverage(own, text, len(told), df)) < 1e-9
    assert abs(covered[5, 2] - 1) < 1e-9 and abs(covered[9, 9] - 1) < 1e-9 and not covered[7].any() and (covered > 0).sum() > 30

    made = [dialogue._terms(words.words(t)) for t in told]
    seen = Counter(t for own in made for t in own)
    weigh = lambda own: {t: (1 + math.log(k)) * math.log(1 + (len(told) - (seen[t] or 1) + 0.5) / ((seen[t] or 1) + 0.5)) for t, k in own.items()}
    for f, own in enumerate(heard):
        for d in range(len(told)):
            a, b = weigh(dialogue._terms(words.words(own))), weigh(made[d])
            norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            assert abs(word[f, d] - (min(1.0, sum(x * b.get(t, 0) for t, x in a.items()) / norm) if norm else 0)) < 1e-9
    assert (code >= 0).all() and code.max() <= 1 and mean[7] == 0 and typical > 0
