"""The matching run on small shows of our own making: scores, assignment, verdicts, order and gates."""

import random

import pytest

from cinelake.operators import discs, library, matching, renames, scoring, segments

SYLLABLES = "ba ko ri mu ten sal dor vi lan pe gru shi fo ma zel tor ni hask wy del".split()
FILES = "job_id string, file_id string, duration_s double, transcript string, embedded_text string, mostly_music boolean"
EPISODES = "job_id string, ord int, season int, number int, title string, runtime_s double, summary string"
TEXTS = "job_id string, season int, number int, kind string, pos int, text string"
PLACES = "job_id string, file_id string, order_index int, chapter int, start_s double, end_s double"


def told(seed, n=160):
    """Sentences of invented words, some of which all episodes share."""
    rng = random.Random(seed)
    own = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))) for _ in range(60)]
    return " ".join(rng.choice(own) if rng.random() < 0.7 else rng.choice(["the", "and", "water", "road", "friend"]) for _ in range(n))


def misheard(text, seed, share=0.15):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else w[:-1] + rng.choice("aeiou") if rng.random() < 0.6 else "" for w in text.split())


def match_files(files, episodes, texts, positions=None):
    return matching.match_files(files, episodes, texts, positions, keep=lambda df, _: df.cache())


def score_all(files, episodes, texts, positions=None):
    return matching.score_all(files, episodes, texts, positions, keep=lambda df, _: df.cache())


SHOW = [told(s) for s in range(6)]
TITLES = ["The Copper Lantern", "A Winter Crossing", "Nine Marbles", "The Quiet Harbour", "Borrowed Thunder", "Salt and Paper"]


@pytest.fixture
def show(spark):
    def made(files, texts=SHOW, places=None, runtime=600.0, season=1, kind="subtitles", titles=TITLES, job="j"):
        episodes = [(job, k, season if season is not None else int(k > 0), k + 1, titles[k], runtime, None) for k in range(len(texts))]
        rows = [(job, e[2], e[3], kind, 0, t) for e, t in zip(episodes, texts) if t]
        found = [(job, *f) for f in files]
        at = None if places is None else spark.createDataFrame([(job, *p) for p in places], PLACES)
        return spark.createDataFrame(found, FILES), spark.createDataFrame(episodes, EPISODES), spark.createDataFrame(rows, TEXTS), at

    return made


def by_file(df):
    return {r.file_id: r for r in df.collect()}


def test_files_find_their_episodes(show):
    order = [4, 1, 5, 0, 2]
    files = [(f"t{k}", 610.0, misheard(SHOW[e], 50 + k), None, False) for k, e in enumerate(order)]
    files += [("bonus", 300.0, told(99), None, False), ("silent", 600.0, "", None, False)]
    got = by_file(match_files(*show(files)))
    assert [got[f"t{k}"].number for k in range(5)] == [e + 1 for e in order]
    assert all(got[f"t{k}"].verdict == "Confident" for k in range(5))
    assert got["bonus"].season is None or got["bonus"].verdict != "Confident"
    assert got["silent"].verdict != "Confident"
    for r in got.values():
        scores = [c.score for c in r.candidates]
        assert len(scores) <= 5 and scores == sorted(scores, reverse=True)
        assert r.season is None or r.number - 1 in [c.ord for c in r.candidates]


def test_score_matrix_covers_every_pair(show):
    files = [(f"t{k}", 600.0, misheard(SHOW[k], k), None, False) for k in range(3)] + [("silent", 600.0, "  ", None, False)]
    rows = score_all(*show(files)).collect()
    assert len(rows) == 4 * 6 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.file_id == "silent":
            assert r.dialogue is None and r.title is None and not r.heard
    best = {f: max((r.score, -r.ord) for r in rows if r.file_id == f) for f in ("t0", "t1", "t2")}
    assert [-best[f][1] for f in ("t0", "t1", "t2")] == [0, 1, 2]


def test_embedded_text_is_heard_in_place_of_the_transcript(show):
    files = [("a", 600.0, told(77), SHOW[3], False), ("b", 600.0, SHOW[2], "   ", False)]
    got = by_file(match_files(*show(files)))
    assert got["a"].number == 4 and got["b"].number == 3


def test_a_title_names_an_episode_where_little_is_heard(show):
    files = [("a", 600.0, "nine marbles", None, False)]
    rows = {r.ord: r for r in score_all(*show(files)).collect()}
    assert rows[2].title > 0.5 and all(rows[k].title == 0 for k in rows if k != 2) and all(r.dialogue is None for r in rows.values())


def test_summaries_stand_in_for_dialogue(show, spark):
    files, episodes, texts, _ = show([("a", 600.0, SHOW[1], None, False)], texts=[None] * 6)
    from pyspark.sql import functions as F

    summaries = spark.createDataFrame([(k, " ".join(SHOW[k].split()[5:40])) for k in range(6)], "ord int, s string")
    episodes = episodes.join(summaries, "ord").withColumn("summary", F.col("s")).drop("s")
    rows = {r.ord: r for r in score_all(files, episodes, texts).collect()}
    assert max(rows, key=lambda k: rows[k].dialogue) == 1 and rows[1].dialogue <= 0.8 and not rows[1].has_dialogue


def places(order, chapter=True):
    return [(f"t{k}", i, i if chapter else None, 600.0 * i, 600.0 * i + 598) for i, k in enumerate(order)]


def test_order_fills_in_a_weak_file_but_is_no_proof(show):
    files = [(f"t{k}", 600.0, misheard(SHOW[k], k) if k != 2 else "mm hmm", None, False) for k in range(5)]
    got = by_file(match_files(*show(files, places=places(range(5)))))
    assert [got[f"t{k}"].number for k in range(5)] == [1, 2, 3, 4, 5] and all(r.used_order for r in got.values())
    assert got["t2"].verdict == "Check" and got["t1"].verdict == "Confident"


def test_order_against_the_content_is_not_used(show):
    files = [(f"t{k}", 600.0, misheard(SHOW[k], k), None, False) for k in range(5)]
    got = by_file(match_files(*show(files, places=places(reversed(range(5))))))
    assert [got[f"t{k}"].number for k in range(5)] == [1, 2, 3, 4, 5] and not any(r.used_order for r in got.values())


def test_a_special_keeps_its_number_at_the_end_of_a_disc(show, spark):
    from pyspark.sql import functions as F

    files, episodes, texts, at = show([(f"t{k}", 600.0, misheard(SHOW[k], k), None, False) for k in range(5)], places=places(range(5)))
    special = F.when(F.col("number") == 5, 0).otherwise(F.col("season"))
    got = by_file(match_files(files, episodes.withColumn("season", special), texts.withColumn("season", special), at))
    assert [(got[f"t{k}"].season, got[f"t{k}"].number) for k in range(5)] == [(1, 1), (1, 2), (1, 3), (1, 4), (0, 5)]


def test_jobs_are_apart(show):
    one, two = (show([("a", 600.0, SHOW[k], None, False)], job=f"j{k}") for k in (1, 3))
    files, episodes, texts = (x.unionByName(y) for x, y in zip(one[:3], two[:3]))
    got = {r.job_id: r.number for r in match_files(files, episodes, texts).collect()}
    assert got == {"j1": 2, "j3": 4}


def test_interim_matches_are_made_file_by_file(show):
    files = [("a", 600.0, SHOW[2], None, False), ("b", 600.0, SHOW[2], None, False)]
    assert {r.file_id: r.number for r in matching.interim(*show(files)[:3], keep=lambda df, _: df.cache()).collect()} == {"a": 3, "b": 3}
    together = by_file(match_files(*show(files)))
    assert sorted((r.number or 0) == 3 for r in together.values()) == [False, True]


def test_listening_on_stops_when_nothing_is_added(show, spark):
    files, episodes, texts, _ = show([("a", 600.0, "mm", None, False), ("b", 600.0, SHOW[0], None, False)])
    asked = []

    def listen(unsure):
        asked.append(sorted(r.file_id for r in unsure.collect()))
        more = [("j", "a", 600.0, SHOW[4], None, False)] if len(asked) == 1 else []
        return spark.createDataFrame(more, FILES)

    _, got = matching.escalate(listen, lambda f: match_files(f, episodes, texts), files)
    assert asked[0] == ["a"] and by_file(got)["a"].number == 5 and by_file(got)["a"].verdict == "Confident" and len(asked) <= 2


def test_input_problems(spark):
    files = spark.createDataFrame([("j", "a"), ("j", "a"), ("j", "b"), ("k", "a")], "job_id string, file_id string")
    at = spark.createDataFrame([("j", "b"), ("j", "x"), ("k", "b")], "job_id string, file_id string")
    assert sorted(tuple(r) for r in scoring.input_problems(files, at).collect()) == [("j", "listedTwice", "a"), ("j", "unknownInOrder", "x"), ("k", "unknownInOrder", "b")]


def test_seasons_are_chosen(spark):
    e = spark.createDataFrame([(1, 1), (2, 1)], "season int, number int")
    assert library.season_filter(e, [2]).count() == 1 and library.season_filter(e, []).count() == 2
    with pytest.raises(ValueError):
        library.season_filter(e, [3])


def test_what_was_heard(spark):
    df = spark.createDataFrame([("x", "t"), (" ", "t"), (None, "t"), (None, None)], "e string, t string")
    assert [r[0] for r in df.select(segments.heard_text(df.e, df.t)).collect()] == ["x", "t", "t", None]


def test_order_of_a_disc(spark):
    located = "job_id string, file_id string, offset_s double, length_s double, score double"
    chapters = spark.createDataFrame([("j", k, 600.0 * k, 600.0 * k + 600) for k in range(4)], "job_id string, chapter int, start_s double, end_s double")
    rows = [("j", "a", 0.0, 590.0, 0.9), ("j", "b", 1200.0, 590.0, 0.8), ("j", "c", 600.0, 590.0, 0.7), ("j", "again", 601.0, 589.0, 0.5), ("j", "theme", 610.0, 20.0, 0.6), ("j", "weak", 1800.0, 590.0, 0.2)]
    given = spark.createDataFrame([("j", 4)], "job_id string, n_files bigint")
    got = discs.derive_order(spark.createDataFrame(rows, located), chapters, given).orderBy("order_index").collect()
    assert [(r.file_id, r.order_index, r.chapter, r.problem) for r in got] == [("a", 0, 0, None), ("c", 1, 1, None), ("b", 2, 2, None)]
    few = discs.derive_order(spark.createDataFrame(rows, located), chapters, given.selectExpr("job_id", "n_files * 3 as n_files")).collect()
    assert {r.problem for r in few} == {"tooFewLocated"}


def test_plans_name_approved_files(spark):
    files = spark.createDataFrame([("j", "a", "/in/a.MKV", "candidate", 1), ("j", "b", "/in/b.mkv", "candidate", 1), ("j", "p", "/in/p.mkv", "playAll", 1)], "job_id string, file_id string, path string, role string, size_bytes int")
    decisions = spark.createDataFrame([("j", "a", "approved", 1, 2), ("j", "b", "notAnEpisode", None, None)], "job_id string, file_id string, decision string, season int, number int")
    matches = spark.createDataFrame([("j", "a", "Check")], "job_id string, file_id string, verdict string")
    episodes = spark.createDataFrame([("j", 1, 2, "Nine: Marbles")], "job_id string, season int, number int, title string")
    items, rest = renames.build_plan(files, decisions, matches, episodes, ("Harbour", None), "jellyfinPlex", "/out")
    assert [r.to for r in items.collect()] == ["/out/Harbour/Season 01/Harbour - S01E02 - Nine - Marbles.mkv"]
    assert {(r.file_id, r.reason) for r in rest.collect()} == {("b", "extra"), ("p", "playAll")}
    with pytest.raises(Exception, match="not in the list"):
        renames.build_plan(files, decisions, matches, episodes.limit(0), ("Harbour", None), "kodi", "/out")[0].collect()


def test_terms_of_pairs_are_not_shuffled(show):
    """The matching run compares texts within a job's row: no window over the pairs' places, as there was one for each phrase."""
    files = [(f"t{k}", 610.0, misheard(SHOW[e], 50 + k), None, False) for k, e in enumerate([2, 0])]
    asked, episodes, texts, _ = show(files)
    plan = matching.content(asked, episodes, texts)._jdf.queryExecution().analyzed().toString()
    assert "postings" not in plan and "mapInPandas" in plan.replace("MapInPandas", "mapInPandas")
