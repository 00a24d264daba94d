"""Providers' responses, archives, writers and evidence."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cinelake.operators import evidence, library
from cinelake.sources import archives, providers, sinks
from cinelake.streaming import folds


def landed(spark, *bodies):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "show int, body string")


def test_shows_and_episodes(spark):
    found = landed(spark, [{"score": 0.8, "show": {"id": 1, "name": "Lamps", "premiered": "1999-01-02"}}, {"score": 0.4, "show": {"id": 2, "name": "Lamp"}}])
    assert sorted((r.id, r.score, r.year) for r in providers.search_a(found, ["show"]).collect()) == [(1, 1.0, 1999), (2, 0.5, None)]
    placed = landed(spark, {"results": [{"id": 5, "name": "x", "first_air_date": ""}, {"id": 6, "name": "y"}]})
    assert sorted((r.id, r.score) for r in providers.search_b(placed, ["show"]).collect()) == [(5, 1.0), (6, 0.5)]
    eps = landed(spark, [{"id": 1, "name": "One", "season": 1, "number": 1, "runtime": 30, "summary": "<p>A <b>b</b>.</p>"}, {"id": 2, "name": "Extra", "season": 1, "number": None, "airdate": "2001"}])
    got = {r.id: (r.season, r.number, r.runtime_s, r.summary) for r in providers.episodes_a(eps, ["show"]).collect()}
    assert got == {1: (1, 1, 1800.0, "A b."), 2: (0, 1, None, None)}
    dvd = landed(spark, [{"name": "", "season": 1, "number": 2, "_embedded": {"episodes": [{"id": 7, "name": "Orig", "runtime": 20}]}}, {"name": "lost", "season": 1, "number": 3, "_embedded": {"episodes": []}}])
    alt = providers.dvd_a(dvd, ["show"])
    assert [(r.title, r.runtime, r.id) for r in alt.collect()] == [("Orig", 20.0, 7)]
    aired = providers.episodes_a(landed(spark, [{"id": 7, "name": "Orig", "season": 3, "number": 4}]), ["show"])
    assert [(r.aired_season, r.aired_number) for r in library.aired_keys(alt, aired, ["show"]).collect()] == [(3, 4)]
    groups = landed(spark, {"groups": [{"name": "Volume B", "order": 2, "episodes": [{"id": 3, "name": "c", "order": 1}, {"id": 4, "name": "d", "order": 0}]}, {"name": "Specials", "order": 1, "episodes": [{"id": 5, "name": "e"}]}]})
    assert {r.id: (r.season, r.number) for r in providers.groups_b(groups, ["show"]).collect()} == {3: (1, 2), 4: (1, 1), 5: (0, 1)}
    ids = spark.createDataFrame([(1, "search", 9), (1, "imdb", 8), (2, "search", 1), (2, "search", 2), (3, "search", 4)], "show int, how string, id int")
    assert {r.show: r.id for r in providers.find_show(ids, ["show"]).collect()} == {1: 8, 3: 4}


def test_packs_and_lyrics(spark):
    body = {"subtitles": [{"url": "/a", "season": "1", "full_season": True, "episode_from": 1, "episode_end": 3}, {"url": "/b", "season": 1, "episode": "2", "hi": True}, {"url": "/c", "season": 1, "unpack_files": [{"name": "x.srt", "episode": "5"}, {"name": "y.srt", "season": 2, "episode": 6}]}]}
    listed = providers.packs(landed(spark, body), ["show"])
    covers = listed.select("pos", "is_pack", library.pack_covers(F.col("files"), F.col("season"), F.col("episode_from"), F.col("episode_end"), F.col("episode"), F.lit(1)).alias("c"))
    assert {r.pos: (r.is_pack, r.c) for r in covers.collect()} == {0: (True, [1, 2, 3]), 1: (False, [2]), 2: (True, [5])}
    records = providers.lyrics(landed(spark, [{"id": 1, "trackName": "a", "duration": 601}, {"id": 2, "trackName": "b", "duration": 600, "plainLyrics": "x"}]), ["show"])
    assert [r.id for r in records.collect()] == [2]


def test_archives(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("d/b.vtt", "a.srt", "__MACOSX/a.srt", "._x.srt", "readme.nfo", "c.ass"):
            z.writestr(name, "1\n00:00:01,000 --> 00:00:02,000\nHi " + name)
    df = spark.createDataFrame([(1, bytearray(raw.getvalue())), (2, bytearray(b"plain words")), (3, bytearray(b"PKbroken"))], "id int, payload binary")
    got = [(r.id, r.name, r.text) for r in archives.extract(df, ["id"]).orderBy("id", "pos").collect()]
    assert got[:4] == [(1, "a.srt", "Hi a.srt"), (1, "c.ass", "Hi c.ass"), (1, "d/b.vtt", "Hi d/b.vtt"), (2, "", "plain words")] and got[4][:2] == (3, None)


def test_local_references(spark, tmp_path):
    (tmp_path / "refs/sub/deep").mkdir(parents=True)
    for name, text in (("a.srt", "1\n0 --> 1\nHello"), ("sub/b.LRC", "[00:01.00]la la\n[00:02.00]lo"), ("sub/deep/c.srt", "x"), ("d.doc", "x")):
        (tmp_path / "refs" / name).write_text(text)
    rows = archives.local_references(spark, str(tmp_path / "refs")).orderBy("path").collect()
    assert [(r.path, r.kind, r.text) for r in rows] == [("a.srt", "subtitles", "Hello"), ("sub/b.LRC", "lyrics", "la la\nlo")]


def test_lists_and_jobs(spark, tmp_path):
    rows = spark.createDataFrame([("b", "extra", "", "", "", ""), ("a", "episode", "1", "2", "x, y", "'=z")], ", ".join(f"{c} string" for c in sinks.COLUMNS))
    target = tmp_path / "list.csv"
    sinks.export_csv(rows, str(target))
    assert target.read_bytes() == b"\xef\xbb\xbffile,status,season,episode,title,new_name\n" + b"a,episode,1,2,\"x, y\",'=z\nb,extra,,,,\n"
    with pytest.raises(FileExistsError):
        sinks.export_csv(rows, str(target))
    sinks.export_csv(rows.limit(0), str(target), replace=True)
    assert target.read_bytes().count(b"\n") == 1 and [p.name for p in tmp_path.iterdir()] == ["list.csv"]
    sinks.save_job(str(tmp_path), "j-1", {"a": 1})
    assert sinks.load_job(str(tmp_path), "j-1") == {"a": 1} and sinks.load_job(str(tmp_path), "../x") is None
    with pytest.raises(ValueError):
        sinks.save_job(str(tmp_path), "../x", {})


def test_moves_are_journalled_and_replayed(spark, tmp_path):
    for name in ("a", "b", "c", "taken"):
        (tmp_path / name).write_text(name)
    at = lambda n: str(tmp_path / n)
    (tmp_path / "log").write_bytes(b'{"kind": "torn')
    log = sinks.Journal(at("log"))
    done = sinks.apply_moves([sinks.Move("a", at("a"), at("b"), 1), sinks.Move("b", at("b"), at("a"), 1), sinks.Move("c", at("c"), at("taken"), 1), sinks.Move("d", at("c"), at("x"), 9)], log, "e1")
    log.close()
    assert {m.item: e is None for m, e in done} == {"a": True, "b": True, "c": False, "d": False}
    assert [(tmp_path / n).read_text() for n in ("a", "b", "c", "taken")] == ["b", "a", "c", "taken"]
    lines = spark.createDataFrame(list(enumerate((tmp_path / "log").read_text().splitlines())), "line_no bigint, value string")
    moved = {r["item"]: (r.original, r.current) for r in folds.moves(folds.operations(folds.read_journal(lines))).filter("moved").collect()}
    assert moved == {"a": (at("a"), at("b")), "b": (at("b"), at("a"))}


def test_evidence(spark):
    a, b = evidence.overlap_quotes("so then the old lamp, quickly, went out", 3, "He said the old lamps quickly went away.", 3, 3)
    assert "".join(t for t, _ in a).startswith("so then") and ("the old lamp, quickly, went", True) in a and any(m and "lamps" in t for t, m in b)
    row = spark.range(1).select(
        evidence.notes(F.lit(0.6), F.lit(0.9), F.lit(0.1), F.lit(0), F.lit(None).cast("string"), F.lit(True), F.lit(False), F.lit(False), F.lit(4)).alias("n"),
        evidence.play_all_reason(F.lit("all.mkv"), F.lit(3700.0), F.lit(3600.0), F.lit(3), F.lit(0.028), F.lit(2), F.lit(3)).alias("r"),
    ).first()
    assert row.n == ["discOrderAgrees", "titleHeard", "lengthMismatch", "noSpeech", "mostlyMusic", "noReferenceText", "sampled:4"]
    assert row.r == "all.mkv is 1:01:40 long, 3% longer than the other 3 files together (1:00:00). 2 of the 3 files have the length of one of its 3 chapters."
