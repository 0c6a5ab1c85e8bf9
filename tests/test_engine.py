"""Operators on small hand-made tables."""

import datetime as dt
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.config import Hysteresis, Matching, Tracker
from sightline.functions import geometry, text, times, vectors
from sightline.operators import catalog, filters, identity, ingest, intervals, search, segments, tracking, triage, zones
from sightline.plans import ask
from sightline.sources import files

RULES = Hysteresis(open=0.5, close=0.2, gap_s=1.0, least_s=0.5, roll_s=0.5)


def trace(spark, scores, step=0.5):
    return spark.createDataFrame([(1, i * step, float(s)) for i, s in enumerate(scores)], "v long, t double, score double")


def loop_runs(scores, p, step=0.5):
    out, on = [], None
    for i, s in enumerate(scores):
        if on is None and s >= p.open:
            on = i
        elif on is not None and s < p.close:
            out.append((on * step, (i - 1) * step + step))
            on = None
    return out + ([(on * step, (len(scores) - 1) * step + step)] if on is not None else [])


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_is_the_loop(spark, seed):
    scores = np.random.default_rng(seed).random(200)
    got = segments.hysteresis_runs(trace(spark, scores), ["v"], "t", "score", ["t"], RULES, 0.5).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == loop_runs(scores, RULES)


def test_wobble_stays_one_segment_and_peak_is_first_maximum(spark):
    s = segments.activity_segments(trace(spark, [0, 0, 0.6, 0.3, 0.9, 0.9, 0.3, 0.1, 0, 0]), ["v"], "t", "score", ["t"], RULES, 0.5).collect()
    assert [(r["start"], r["end"], r["peak"]) for r in s] == [(0.5, 4.0, 2.0)]


def test_even_windows_fold_a_sliver(spark):
    v = spark.createDataFrame([(1, 50.0), (2, 10.0), (3, 37.0)], "video_id long, duration double")
    got = [(r["video_id"], r["start"], r["end"]) for r in segments.even_windows(v, 15.0).orderBy("video_id", "start").collect()]
    assert got == [(1, 0.0, 15.0), (1, 15.0, 30.0), (1, 30.0, 50.0), (2, 0.0, 10.0), (3, 0.0, 15.0), (3, 15.0, 30.0), (3, 30.0, 37.0)]


def test_sampled_frames_are_greedy(spark):
    f = spark.createDataFrame([(1, t / 10) for t in (0, 1, 4, 5, 9, 10, 11, 16)], "w long, t double")
    got = [r["t"] for r in segments.sampled_frames(f, ["w"], 2.0).orderBy("t").collect()]
    assert got == [0.0, 0.5, 1.0, 1.6]


def test_rolling_level_matches_numpy(spark):
    rng = np.random.default_rng(5)
    value = rng.random(100) + np.linspace(0, 2, 100)
    b = spark.createDataFrame([(1, i, float(v), False, True) for i, v in enumerate(value)], "video_id long, bin int, value double, blind boolean, scorable boolean")
    got = np.array([r["base"] for r in triage.rolling_level(b, p=triage.Triage(window_s=10)).orderBy("bin").collect()])
    level = np.array([np.quantile(value[i : i + 10], 0.3) for i in range(0, 100, 10)])
    pad = np.r_[level[0], level, level[-1]]
    middle = np.median([pad[:-2], pad[1:-1], pad[2:]], axis=0)
    assert np.allclose(got, np.interp(np.arange(100), np.arange(10) * 10 + 4.5, middle))


def test_triage_finds_the_busy_stretch(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, i / 10, int((9000 if i % 20 == 0 else 1000) * rng.uniform(0.9, 1.1) * (4 if 60 <= i / 10 < 80 and i % 20 else 1)), i % 20 == 0) for i in range(3000)]
    p = spark.createDataFrame(rows, "video_id long, seq long, t double, size long, is_key boolean")
    v = spark.createDataFrame([(1, 300.0), (2, 5.0)], "video_id long, duration double")
    got = {(r["video_id"], r["start"], r["end"]) for r in triage.candidates(p, v).collect()}
    assert (2, 0.0, 5.0) in got
    busy = [g for g in got if g[0] == 1]
    assert any(a <= 60 and b >= 80 for _, a, b in busy) and sum(b - a for _, a, b in busy) < 120


def test_coalesce_touching_spans_and_first_overlap(spark):
    s = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 8.0), (1, 2.0, 3.0), (1, 9.0, 12.0)], "k long, start double, end double")
    got = sorted((r["start"], r["end"]) for r in intervals.coalesce_spans(s, ["k"]).collect())
    assert got == [(0.0, 8.0), (9.0, 12.0)]
    u = spark.createDataFrame([(1, 1, 8.5, 8.6), (1, 2, 4.0, 10.0), (1, 3, 100.0, 101.0)], "k long, u long, a double, b double")
    t = s.withColumnRenamed("start", "s0").withColumnRenamed("end", "s1").withColumn("sid", F.col("s0"))
    out = {r["u"]: r["sid"] for r in intervals.first_overlap(u, t, ["k"], "u", ("a", "b"), "sid", ("s0", "s1"), bucket=3.0).collect()}
    assert out == {1: None, 2: 0.0, 3: None}


def test_region_events_need_two_samples(spark):
    flags = [0, 1, 0, 1, 1, 1, 0, 1, 0, 0]
    p = spark.createDataFrame([(1, float(i), bool(f)) for i, f in enumerate(flags)], "k long, t double, inside boolean")
    got = sorted((r["t"], r["kind"], r["duration"]) for r in zones.region_events(p, ["k"], ["t"], "t", "inside", 2).collect())
    assert got == [(3.0, "dwell", 5.0), (3.0, "enter", 0.0), (8.0, "exit", 0.0)]


def test_zone_events_from_boxes(spark):
    det = spark.createDataFrame([(1, float(i), 0.1 * i, 0.4, 0.1 * i + 0.1, 0.5) for i in range(9)], "tracklet_id long, t double, x1 double, y1 double, x2 double, y2 double")
    tr = spark.createDataFrame([(1, 5, 6, 7, "person")], "id long, segment_id long, video_id long, camera_id long, label string")
    z = spark.createDataFrame([(1, 7, "gate", "line", "[[0.5,0],[0.5,1]]"), (2, 7, "yard", "region", "[[0.4,0],[1,0],[1,1],[0.4,1]]"), (3, 7, "bad", "line", "[[0.5,0]]")], "id long, camera_id long, name string, kind string, points string")
    v = spark.createDataFrame([(6, 1000.0)], "id long, start_ts double")
    got = sorted((r["zone_id"], r["kind"], r["ts"]) for r in zones.zone_events(det, tr, z, v).collect())
    assert [g[:2] for g in got] == [(1, "cross_out"), (2, "dwell"), (2, "enter")] and got[0][2] == 1005.0
    assert [(r["id"], r["problem"]) for r in zones.zone_problems(z).collect()] == [(3, "invalid")]


def test_polygon_and_iou(spark):
    d = spark.createDataFrame([(0.5, 0.5), (2.0, 0.5)], "x double, y double")
    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    assert [r[0] for r in d.select(geometry.in_polygon(F.col("x"), F.col("y"), ring)).collect()] == [True, False]
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert d.select(geometry.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))).first()[0] == pytest.approx(1 / 7)


def test_identity_margin_many_examples_and_models(spark):
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.9, 0.1]), ("b", [0.0, 1.0])], "identity string, vector array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.02]), (2, [0.69, 0.72]), (3, [-1.0, -1.0])], "id long, vector array<double>")
    got = {r["id"]: (r["identity"], r["reason"]) for r in identity.matches(c, known, "id", Matching()).collect()}
    assert got == {1: ("a", None), 2: (None, "too close to call"), 3: (None, "below threshold")}
    assert identity.matches(c, known.limit(0), "id").select("reason").distinct().first()[0] == "no gallery"
    t = spark.createDataFrame([(1, None, None, "person"), (2, 9, "manual", "person"), (3, 9, "auto", "person")], "id long, identity_id long, identity_source string, label string")
    e = spark.createDataFrame([(i, "face", [1.0, 0.0], "m") for i in (1, 2, 3)], "tracklet_id long, kind string, vector array<double>, model string")
    ids = lambda **k: sorted(r["id"] for r in identity.assigned(t, e, known, "face", **k).collect())
    assert ids() == [1] and ids(reassign=True) == [1, 3] and ids(model="other") == []


def test_unnaming_removes_an_empty_identity(spark):
    i = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    g = spark.createDataFrame([(1, 10, "face", [1.0], "m")], "identity_id long, tracklet_id long, kind string, vector array<double>, model string")
    t = spark.createDataFrame([(10, 1, 1.0, "manual"), (11, 2, 1.0, "auto")], "id long, identity_id long, identity_score double, identity_source string")
    people, examples, tracklets = identity.unnamed(i, g, t, 10)
    assert [r["name"] for r in people.collect()] == ["y"] and examples.count() == 0 and tracklets.where("identity_id is not null").count() == 1


def test_bm25_with_stems_is_sqlites(spark):
    docs = ["the runner was running fast", "ponies and cats running", "relational cats", "nothing at all", "a cat ran; the cats run"]
    d = spark.createDataFrame(list(enumerate(docs, 1)), "id long, body string")
    got = {r["id"]: r["score"] for r in search.bm25(d, "id", "body", "running cats cats", stems=True).collect()}
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(body, tokenize='porter unicode61')")
    c.executemany("insert into f(rowid, body) values (?, ?)", list(enumerate(docs, 1)))
    want = {i: -r for i, r in c.execute("select rowid, rank from f where f match '\"running\" OR \"cats\" OR \"cats\"'")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("controlling", "control"), ("adoption", "adopt"), ("rate", "rate"), ("sky", "sky")])
def test_stems(word, stem):
    assert text.stem(word) == stem


def test_fusion_keeps_the_first_lists_order(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "k long, score double")
    b = spark.createDataFrame([(3, 5.0), (1, 4.0)], "k long, score double")
    assert [r["k"] for r in search.fused([a, b], "k").collect()] == [1, 3, 2]
    assert search.hybrid(a.withColumn("t", F.lit("x")), "k", "t", a.select("k", F.array(F.lit(1.0)).alias("v")), "v", "zzz", None).count() == 0


def test_filters_are_independent_and_zero_is_a_value(spark):
    s = spark.createDataFrame([(1, 0, 0, 10.0, 20.0), (2, 1, 0, 10.0, 20.0)], "id long, camera_id long, video_id long, ts_start double, ts_end double")
    t = spark.createDataFrame([(1, 1, "person", None), (2, 1, "dog", 5)], "id long, segment_id long, label string, identity_id long")
    i = spark.createDataFrame([(5, "Rafi")], "id long, name string")
    e = spark.createDataFrame([], "segment_id long, zone_id long, kind string")
    z = spark.createDataFrame([], "id long, name string")
    f = lambda **k: [r["id"] for r in filters.allowed_segments(s, t, i, e, z, filters.SegmentFilter(**k)).orderBy("id").collect()]
    assert f(label="person", identity="Rafi") == [1] and f(camera_id=0) == [1] and f(zone="x") == [] and f() == [1, 2] and f(day="1970-01-01") == [1, 2]


def test_speech_gate_and_bands(spark):
    u = spark.createDataFrame([("hi", -0.5, 0.1), ("hm", -2.0, 0.1), ("  ", 0.0, 0.0), ("eh", None, 0.9)], "text string, avg_logprob double, no_speech_prob double")
    assert [r["text"] for r in filters.spoken(u).collect()] == ["hi"]
    h = spark.createDataFrame([(float(x * 3600),) for x in range(24)], "ts double")
    assert filters.in_hours(h, "ts", 22, 2).count() == 4
    assert h.select(times.hms(F.lit(3725.0))).first()[0] == "1:02:05"


@pytest.mark.parametrize("path,want,camera", [("/a/cam 03/2024-05-06_07-08-09.mp4", "2024-05-06 07:08:09", "cam 03"), ("/a/x/CAM_03 2024-01-15 - 08-30-00.mp4", "2024-01-15 08:30:00", "cam03"), ("/nvr/ch 3/rec_20240115__083000.mp4", "2024-01-15 08:30:00", "ch 3"), ("/Yard/x_20240506_070809.mkv", "2024-05-06 07:08:09", "yard"), ("/a/20241399_000000.avi", None, "a"), ("/a/ch1_19990101_000000.avi", None, "ch1"), ("v20240506070809.ts", "2024-05-06 07:08:09", "default")])
def test_file_names(spark, path, want, camera):
    r = spark.createDataFrame([(path,)], "p string").select(ingest.filename_time(F.col("p")).alias("t"), ingest.camera_name(F.col("p")).alias("c")).first()
    assert r["c"] == camera
    assert (None if r["t"] is None else dt.datetime.fromtimestamp(r["t"], dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")) == want


def test_statuses_upserts_and_cascade(spark):
    known = spark.createDataFrame([("/a", 1.0, 10, 5.0, "f1")], "path string, ingested_at double, size_bytes long, mtime double, fingerprint string")
    new = spark.createDataFrame([("/a", "f1", 10, 5.0), ("/b", "f1", 10, 6.0), ("/c", "f2", 1, 1.0), ("/d", "f2", 1, 1.0), ("/e", None, 2, 2.0)], "path string, fingerprint string, size long, mtime double")
    got = {r["path"]: (r["status"], r["duplicate_of"]) for r in ingest.statuses(new, known).collect()}
    assert got == {"/a": ("unchanged", None), "/b": ("duplicate", "/a"), "/c": ("new", None), "/d": ("duplicate", "/c"), "/e": ("new", None)}
    t = spark.createDataFrame([(1, "x")], "k long, v string")
    assert sorted(map(tuple, ingest.upserted(t, spark.createDataFrame([(1, "y"), (2, "z")], "k long, v string"), ["k"]).collect())) == [(1, "y"), (2, "z")]
    assert [tuple(r) for r in ingest.named_ids(spark.createDataFrame([(4, "a")], "id long, name string"), spark.createDataFrame([(" b ",), ("a",), ("",)], "name string")).orderBy("id").collect()] == [(4, "a"), (5, "b")]
    tabs = {"videos": spark.range(1, 3), "segments": spark.createDataFrame([(1, 1), (2, 2)], "id long, video_id long"), "tracklets": spark.createDataFrame([(1, 1), (2, 2)], "id long, video_id long"), "detections": spark.createDataFrame([(1,), (2,)], "tracklet_id long")}
    assert {k: v.count() for k, v in ingest.without_video(tabs, 1).items()} == dict.fromkeys(tabs, 1)


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 100)
    (tmp_path / "b.mp4").write_bytes(b"x" * 100)
    got = files.fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 2 and len({r["fingerprint"] for r in got}) == 1 and files.listing(spark, str(tmp_path)).count() == 2


def walker(n, x0, y, score=0.9, cls=0):
    return [(1, float(t), cls, x0 + 5.0 * t, y, x0 + 5.0 * t + 40, y + 90, score) for t in range(n)]


SCHEMA = "seg long, t double, cls int, x1 double, y1 double, x2 double, y2 double, score double"


def test_tracks_survive_a_gap_and_low_scores_start_none(spark):
    rows = [r for r in walker(20, 0.0, 0.0) if not 8 <= r[1] < 11] + walker(20, 0.0, 300.0, 0.3) + walker(1, 500.0, 0.0) + walker(12, 0.0, 600.0, 0.8, 2)
    got = tracking.tracks(spark.createDataFrame(rows, SCHEMA), ["seg"]).groupBy("track_id").agg(F.count("*").alias("n"), F.min("y1").alias("y")).collect()
    assert sorted((r["y"], r["n"]) for r in got) == [(0.0, 17), (600.0, 12)]


def test_tracks_age_in_empty_frames(spark):
    late = [(1, r[1] + 110, *r[2:]) for r in walker(10, 0.0, 0.0)]
    boxes, frames = spark.createDataFrame(walker(10, 0.0, 0.0) + late, SCHEMA), spark.range(120).select(F.lit(1).cast("long").alias("seg"), F.col("id").cast("double").alias("t"))
    n = lambda df: sorted(r["n"] for r in df.groupBy("track_id").agg(F.count("*").alias("n")).collect())
    assert n(tracking.tracks(boxes, ["seg"], frames=frames)) == [10, 10]
    two = spark.createDataFrame([(1, r[1] + 1, 0, *r[3:]) for r in walker(10, 0.0, 0.0)] + walker(10, 500.0, 500.0, 0.8, 7), SCHEMA)
    assert {r["cls"]: r["track_id"] for r in tracking.tracks(two, ["seg"]).collect()} == {7: 1, 0: 2}


def test_assignment_is_cheapest():
    rng = np.random.default_rng(2)
    import itertools

    for n, m in ((3, 5), (5, 3), (4, 4)):
        c = rng.random((n, m))
        r, k = tracking.assign(c)
        best = min(sum(c[i, j] for i, j in (zip(range(n), p) if n <= m else zip(p, range(m)))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert c[r, k].sum() == pytest.approx(best)


def test_nms(spark):
    rows = [(1, 0.0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0.0, 0, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 0.0, 1, 0.0, 0.0, 10.0, 10.0, 0.7), (1, 1.0, 0, 0.0, 0.0, 10.0, 10.0, 0.1)]
    assert sorted(r["score"] for r in tracking.nms(spark.createDataFrame(rows, SCHEMA), ["seg", "t"]).collect()) == [0.1, 0.7, 0.9]


KNOWN = ask.Vocabulary(("Rafi", "Mina"), (("front door", "line"), ("kitchen", "region")), ("cam1",), ("person", "dog"))
TODAY = dt.date(2024, 5, 8)


def test_questions():
    p = ask.parse("when did Rafi go out the front door yesterday", KNOWN, TODAY)
    assert (p.intent, p.identity, p.zone, p.event_kind, p.day, p.semantic_text) == ("when", "Rafi", "front door", "cross_out", "2024-05-07", "")
    assert ask.parse("how long did Mina stay in the kitchen on monday", KNOWN, TODAY).day == "2024-05-06"
    assert ask.parse("did a dog come in the kitchen last night", KNOWN, TODAY).event_kind == "enter"
    assert ask.parse("who was seen on wednesday", KNOWN, TODAY).day == "2024-05-01"
    assert ask.parse("when did Bob leave", KNOWN, TODAY).unknown_names == ("Bob",) and not ask.parse("Bob left", KNOWN, TODAY).unknown_names
    assert ask.parse("person with a red bag", KNOWN, TODAY).semantic_text == "with red bag"
    assert ask.parse("did Mina return in the evening", KNOWN, TODAY).event_kind == "cross_in" and ask.parse("did Mina go outside overnight", KNOWN, TODAY).band == (22, 6)
    assert ask.parse("was Rafi in the kitchen this morning", KNOWN, TODAY).band is None and ask.parse("who was in the kitchen", KNOWN, TODAY).event_kind == "dwell"
    assert ask.parse("how many times did Rafi ever go last 2024-02-30 or 2024-02-28", KNOWN, TODAY).semantic_text == "2024 02 30 or"
    assert ask.parse("person", KNOWN, TODAY).intent == "find" and ask.parse("has a dog", KNOWN, TODAY).intent == "did" and not ask.parse("red bag", KNOWN, TODAY).grounded and ask.parse("who came today", KNOWN, TODAY).grounded


def test_asking(spark):
    people = spark.createDataFrame([(1, "Rafi"), (2, "Mina")], "id long, name string")
    cameras = spark.createDataFrame([(1, "cam1")], "id long, name string")
    zones = spark.createDataFrame([(1, "front door", "line"), (2, "kitchen", "region")], "id long, name string, kind string")
    noon = dt.datetime(2024, 5, 7, 12, tzinfo=dt.timezone.utc).timestamp()
    t = spark.createDataFrame([(1, 1, noon, noon + 9, 1, "person", 1), (2, 1, noon + 60, noon + 70, 2, "person", 1), (3, 2, noon + 99, noon + 100, None, "dog", 1)], "id long, segment_id long, ts_start double, ts_end double, identity_id long, label string, camera_id long")
    e = spark.createDataFrame([(1, 1, 1, 1, 1, "person", "cross_out", noon, 0.0), (2, 1, 1, 1, 1, "person", "cross_out", noon + 30, 0.0), (3, 1, 1, 1, 1, "person", "cross_in", noon + 40, 0.0), (4, 2, 2, 1, 1, "person", "dwell", noon + 60, 900.0), (5, 1, 3, 2, 1, "dog", "cross_out", noon + 99, 0.0)], "id long, zone_id long, tracklet_id long, segment_id long, camera_id long, label string, kind string, ts double, duration double")
    searched = []
    ranked = lambda text, plan: searched.append(text) or people.limit(0)
    say = lambda q: (lambda a: a.answer.first()["answer"] if a.answer is not None else None)(ask.ask(q, TODAY, e, zones, t, people, cameras, ranked))
    assert say("how many times did Rafi go out the front door yesterday") == "2 times at front door" and not searched
    assert say("how long did Mina stay in the kitchen") == "Mina for 15.0 minutes across 1 visit; longest 900s at 12:01:00."
    assert say("when did Rafi go out the front door") == "2 times, from Tue 07 May, 12:00:00 to 12:00:30."
    assert say("did Rafi come in the front door") == "Yes - 1 time(s), first at Tue 07 May, 12:00:40." and say("who left by the front door yesterday") == "Rafi, plus 1 unrecognised."
    assert say("who was the dog") == "1 sighting(s), nobody recognised." and say("when did Mina go out the front door on monday") == "No record of Mina at front door on 2024-05-06."
    assert say("when did Bob leave") == "I do not know anyone called Bob. Enrolled: Mina, Rafi."
    searched.clear()
    asked = ask.ask("person in a red jacket", TODAY, e, zones, t, people, cameras, ranked)
    assert asked.rows.count() == 2 and searched == ["red jacket"] and asked.caveat.startswith("'red jacket'")
    assert say("something blue") is None and searched[-1] == "something blue"
    assert ask.mode(ask.parse("when did Bob leave", KNOWN, TODAY), 0, 0, True) == "refused"
    assert ask.mode(ask.parse("when did someone leave", ask.Vocabulary(), TODAY), 0, 0, False) == "needs_zone"


def test_catalog(spark):
    t = spark.createDataFrame([(1, "person"), (1, "person"), (1, "dog"), (2, None)], "segment_id long, label string")
    assert {r["segment_id"]: (r["n_tracklets"], r["labels"]) for r in catalog.label_counts(t).collect()} == {1: (3, {"dog": 1, "person": 2}), 2: (1, {})}
    v = spark.createDataFrame([(1, 0, 1.0), (1, 90, 1.4), (2, 180, 0.1), (3, 0, 1.0), (3, 90, 1.2)], "video_id long, degrees int, conf double")
    assert {r["video_id"]: r["rotation"] for r in catalog.orientation(v).collect()} == {1: 90, 2: 180, 3: 0}


def test_mean_vector(spark):
    d = spark.createDataFrame([(1, [2.0, 0.0], 1.0), (1, [0.0, 3.0], -1.0)], "g long, v array<double>, w double")
    assert vectors.mean_vector(d, ["g"], "v", "w").first()["vector"] == pytest.approx([1.0, 0.0])


def test_streams_end_runs_like_the_batch(spark, tmp_path):
    from sightline.streaming import live

    trace(spark, [0, 0.6, 0.3, 0.1, 0.9, 0.0]).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("v long, t double, score double").parquet(str(tmp_path / "in"))
    q = live.hysteresis(s, "v", "t", "score", RULES).writeStream.format("memory").queryName("runs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r["start"], r["end"]) for r in spark.table("runs").collect()) == [(0.5, 1.0), (2.0, 2.0)]


def test_box_queries_take_all_lines(spark):
    from sightline import queries

    d = "/root/testdata/sf0.001"
    boxes = queries._boxes(spark, d).toPandas()
    assert len(boxes) == spark.read.parquet(f"{d}/lineitem.parquet").count()
    kept = []
    for key, g in boxes.groupby(["video_id", "t", "cls"]):
        rows = sorted(g.itertuples(index=False), key=lambda r: (-r.score, r.x1, r.y1))
        left = []
        for r in rows:
            inner = [max(0.0, min(r.x2, k.x2) - max(r.x1, k.x1)) * max(0.0, min(r.y2, k.y2) - max(r.y1, k.y1)) for k in left]
            sizes = [(r.x2 - r.x1) * (r.y2 - r.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) for k in left]
            if all(i <= 0.45 * (s - i) for i, s in zip(inner, sizes)):
                left.append(r)
        kept += [tuple(r) for r in left]
    assert sorted(map(tuple, queries.nms_boxes(spark, d).collect())) == sorted(kept)
    n = 0
    for _, g in boxes.groupby("video_id"):
        for _, c in g.groupby("cls"):
            c = c.sort_values(["t", "score", "x1", "y1"], ascending=[True, False, True, True], ignore_index=True)
            box, at = c[["x1", "y1", "x2", "y2"]].to_numpy(), c["t"].to_numpy()
            frames = [(rows := np.flatnonzero(at == t), box[rows], c["score"].to_numpy()[rows]) for t in sorted(g["t"].unique())]
            n += sum(map(len, tracking.follow(frames)))
    assert queries.track_objects(spark, d).count() == n > 0


def test_vocabulary_has_every_name_that_the_question_means(spark):
    people = spark.range(150_000).select("id", F.concat(F.lit("user "), F.col("id").cast("string")).alias("name"))
    zones = spark.createDataFrame([(1, "Front  Door", "line"), (2, "yard", "region"), (3, None, "line")], "id long, name string, kind string")
    cameras = spark.createDataFrame([(1, "gate")], "id long, name string")
    labels = spark.createDataFrame([("dog",), ("error",), (None,)], "label string")
    q = "how many errors did USER 149999 have at the Front Today Door on monday"
    known = ask.vocabulary(q, people, zones, cameras, labels)
    assert "user 149999" in known.identities and len(known.identities) < 100 and known.zones == (("Front  Door", "line"),) and (known.cameras, known.labels, known.enrolled) == ((), ("error",), True)
    every = ask.Vocabulary(tuple(r["name"] for r in people.collect()), (("Front  Door", "line"), ("yard", "region")), ("gate",), ("dog", "error"))
    for q in (q, "when did user 99999 leave the yard", "when did Bob leave"):
        assert ask.parse(q, ask.vocabulary(q, people, zones, cameras, labels), TODAY) == ask.parse(q, every, TODAY)
