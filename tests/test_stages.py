"""Imports in stages, with failures and reruns; summaries; small functions of media; questions in the first person."""

import datetime as dt
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry, text, times
from sightline.operators import filters, identity, stages
from sightline.plans import ask


def test_a_failure_is_a_row_and_a_rerun_does_what_is_left(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def work(pdf):
        name = pdf["f"].iloc[0]
        with open(seen, "a") as out:
            out.write(f"{name} ")
        if name in ("b", "d") and not (tmp_path / "mended").exists():
            raise OSError(f"{name} is broken")
        return pdf.assign(size=len(pdf))[["f", "size"]]

    graph = stages.Import(
        str(tmp_path / "run"),
        "f",
        "string",
        [
            stages.Stage("last", lambda due, t: t["scan"].join(due, "f", "left_semi").select("f", (F.col("size") + 1).alias("m")), ("scan", "probe")),
            stages.Stage("scan", lambda due, _: stages.attempted(due, "f", work, "f string, size long"), ("probe",)),
            stages.Stage("probe", lambda due, _: due.select("f", F.when(F.col("f") == "z", "no stream").alias("error"))),
        ],
    )
    assert list(graph.stages) == ["probe", "scan", "last"]
    files = spark.createDataFrame([(x,) for x in "abcdz"], "f string")
    calls = lambda: sorted(open(seen).read().split())  # noqa: E731, SIM115
    graph.run(files)
    state = lambda fs=files: {r["stage"]: tuple(r)[1:] for r in graph.summary(fs).collect()}
    assert state() == {"probe": (4, 1, 0, 4, ["no stream"]), "scan": (2, 2, 1, 2, ["OSError: b is broken", "OSError: d is broken"]), "last": (2, 0, 3, 2, [])}
    assert calls() == ["a", "b", "c", "d"]
    graph.run(files)
    assert calls() == ["a", "b", "b", "c", "d", "d"] and state()["scan"][:4] == (2, 2, 1, 2)
    (tmp_path / "mended").touch()
    more = spark.createDataFrame([(x,) for x in "abcdez"], "f string")
    graph.run(more)
    assert calls() == sorted("abcd" + "bd" + "bde") and state(more) == {"probe": (5, 1, 0, 5, ["no stream"]), "scan": (5, 0, 1, 5, []), "last": (5, 0, 1, 5, [])}
    assert sorted(map(tuple, graph.table(spark, "last").collect())) == [(x, 2) for x in "abcde"]
    graph.run(more)
    assert len(calls()) == 9 and graph.table(spark, "scan").count() == 5


def test_stages_that_wait_for_each_other_are_an_error():
    with pytest.raises(ValueError, match="wait"):
        stages.Import("x", "f", "string", [stages.Stage("a", None, ("b",)), stages.Stage("b", None, ("a",))])


def test_summaries(spark):
    videos = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, None)], "id long, has_audio boolean")
    raw = spark.createDataFrame([(1, "a b", 0.0, 2.0, -0.1, 0.1), (1, " ", 2.0, 3.0, -0.1, 0.1), (2, "x", 0.0, 9.0, -2.0, 0.1), (4, "x", 0.0, 9.0, -0.1, 0.1)], "video_id long, text string, t_start double, t_end double, avg_logprob double, no_speech_prob double")
    assert stages.speech_summary(videos, raw, filters.spoken(raw)).first().asDict() == {"videos": 1, "utterances": 1, "seconds_of_speech": 2.0, "skipped_no_audio": 2, "skipped_silent": 1, "skipped_unclear": 1, "discarded": 2}
    tries = spark.createDataFrame([(1, "a", None), (None, None, None), (1, " ", None), (1, "b", "bad"), (1, None, None)], "crop int, caption string, error string")
    assert tuple(stages.caption_summary(tries).first()) == (5, 1, 1, 3)
    results = spark.createDataFrame([(1, "analyzed", 7), (2, "failed", None), (3, "skipped", 5)], "video_id long, status string, frames long")
    tracklets = spark.createDataFrame([(1, "dog"), (1, "cat"), (1, "cat"), (3, "cat")], "video_id long, label string")
    row, labels = stages.analysis_summary(results, tracklets)
    assert row.first().asDict() == {"analyzed": 1, "skipped": 1, "failed": 1, "frames": 7, "tracklets": 3} and [tuple(r) for r in labels.collect()] == [("cat", 2), ("dog", 1)]


def test_deleting_an_identity_unnames_its_sightings(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    examples = spark.createDataFrame([(1, 7), (2, 8)], "identity_id long, tracklet_id long")
    tracklets = spark.createDataFrame([(7, 1, 0.9, "auto"), (8, 2, 1.0, "manual"), (9, None, None, None)], "id long, identity_id long, identity_score double, identity_source string")
    p, e, t = identity.deleted(people, examples, tracklets, 1)
    assert [r.id for r in p.collect()] == [2] and [r.identity_id for r in e.collect()] == [2]
    assert sorted(map(tuple, t.collect())) == [(7, None, None, None), (8, 2, 1.0, "manual"), (9, None, None, None)]


def test_utterances_by_video_and_segment(spark):
    u = spark.createDataFrame([(i, i % 2, i % 3, 10.0 - i) for i in range(9)], "id long, video_id long, segment_id long, ts_start double")
    assert [r.id for r in filters.utterances_of(u, 1).collect()] == [7, 5, 3, 1] and [r.id for r in filters.utterances_of(u, 0, 0).collect()] == [6, 0]
    assert [r.id for r in filters.utterances_of(u, limit=2).collect()] == [8, 7]


def test_media_arithmetic(spark):
    rates = [(30000, 1001), (26996000, 1799749), (25, 1), (50, 2), (0, 1), (1, 0), (500, 1), (1001, 2000), (239999, 1002), (None, 1), (-30, -1)]
    df = spark.createDataFrame(rates, "a long, b long").select("a", "b", times.clean_rate(F.col("a"), F.col("b")).alias("r"))
    for a, b, r in df.collect():
        exact = Fraction(a, b) if a is not None and b else None
        want = Fraction(30) if exact is None or not 1 <= exact <= 240 else exact if exact.denominator <= 1001 else Fraction(round(float(exact), 3)).limit_denominator(1000)
        assert (r["num"], r["den"]) == (want.numerator, want.denominator), (a, b)
    clips = spark.createDataFrame([(10.0, 5.0), (1.0, 0.2), (3.0, 600.0)], "at double, s double").select(times.clip_bounds(F.col("at"), F.col("s")).alias("c")).select("c.*")
    assert [tuple(r) for r in clips.collect()] == [(8.0, 13.0), (0.0, 1.0), (1.0, 61.0)]
    boxes = spark.createDataFrame([(10.0, 10.0, 60.0, 110.0), (-5.0, 0.0, 300.0, 40.0), (5.0, 5.0, 7.0, 50.0)], "a double, b double, c double, d double")
    crops = boxes.select(geometry.thumb_crop(*[F.col(c) for c in "abcd"], F.lit(200), F.lit(100), 100).alias("c")).collect()
    assert [r.c and tuple(r.c) for r in crops] == [(6, 2, 64, 100, 58, 98), (0, 0, 200, 43, 100, 21), None]
    labels = spark.createDataFrame([('{"person": 2, "dog": 1}',), (None,), ("{}",)], "j string").select(text.shown_labels(F.col("j")))
    assert [r[0] for r in labels.collect()] == ["2xperson 1xdog", "", ""]


def test_whoever_asks_is_no_unknown_name():
    known, today = ask.Vocabulary(("Rafi",), (("front door", "line"),), ("cam1",), ("person",)), dt.date(2024, 5, 8)
    for question in ("when did I leave", "When did I go out the front door", "did I'm Rafi leave", "when did we and Rafi leave by us"):
        assert ask.parse(question, known, today).unknown_names == ()
    assert ask.parse("when did I leave", known, today).event_kind == "cross_out" and ask.parse("when did I leave", known, today).semantic_text == ""
    assert ask.parse("When did Bob and I leave with Rafi and O'Neil", known, today).unknown_names == ("Bob", "O", "Neil")
    assert ask.parse("Bob left when", known, today).unknown_names == ()
