"""Decoding against loops over anchors, suppression across classes; the frame loop against a whole-segment walk."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.config import Tracker
from sightline.operators import detect, tracking


def loop_decode(raw, width, height, head, size, least, classes=None):
    rows = raw if raw and len(raw[0]) == head.attributes else [list(c) for c in zip(*raw)]
    grid = [(x, y, s) for s in head.strides for y in range(size // s) for x in range(size // s)]
    scale = min(size / width, size / height)
    left, above = ((size - round(n * scale)) // 2 if head.centred else 0 for n in (width, height))
    out = []
    for i, p in enumerate(rows):
        scores = [s * p[4] for s in p[5:]] if head.objectness else p[4:]
        best = max(scores)
        cls = scores.index(best)
        if best < least or classes is not None and cls not in classes:
            continue
        cx, cy, w, h = p[:4]
        if head.grid:
            gx, gy, s = grid[i]
            cx, cy, w, h = (cx + gx) * s, (cy + gy) * s, math.exp(w) * s, math.exp(h) * s
        clip = lambda v, most: min(max(v, 0.0), most)
        out.append((i, clip((cx - w / 2 - left) / scale, width), clip((cy - h / 2 - above) / scale, height), clip((cx + w / 2 - left) / scale, width), clip((cy + h / 2 - above) / scale, height), best, cls))
    return out


HEADS = [detect.Head(3), detect.Head(3, objectness=True, centred=False), detect.Head(2, objectness=True, grid=True, strides=(8, 16), centred=False), detect.Head(5, grid=True, strides=(8, 16, 32))]


@pytest.mark.parametrize("head", HEADS)
@pytest.mark.parametrize("classes", [None, [1]])
def test_decode(spark, head, classes):
    rng, frames = random.Random(3), []
    for k in range(6):
        n = head.anchors(32) if head.grid else rng.choice([1, 5, 40])
        raw = [[rng.uniform(-1, 2) if head.grid else rng.uniform(0, 32) for _ in range(4)] + [rng.choice([0.1, 0.5, 0.9, 1.0]) for _ in range(head.attributes - 4)] for _ in range(n)]
        turned = k % 2 and len(raw) != head.attributes
        frames.append((k, rng.choice([31, 64, 100]), rng.choice([17, 64, 33]), [list(c) for c in zip(*raw)] if turned else raw))
    df = spark.createDataFrame([*frames, (98, 10, 10, []), (99, 10, 10, None)], "f long, width int, height int, raw array<array<double>>")
    found = defaultdict(list)
    for r in detect.decoded(df, ["f"], head, 32, 0.3, classes).collect():
        found[r["f"]].append((r["anchor"], r["x1"], r["y1"], r["x2"], r["y2"], r["score"], r["cls"]))
    for k, w, h, raw in frames:
        want = loop_decode(raw, w, h, head, 32, 0.3, classes)
        assert [x[0] for x in sorted(found[k])] == [x[0] for x in want] and np.allclose(sorted(found[k]), want) if want else not found[k]
    assert not found[98] and not found[99]


def test_a_wrong_number_of_anchors_is_an_error(spark):
    df = spark.createDataFrame([(1, 10, 10, [[0.0] * 7] * 5)], "f long, width int, height int, raw array<array<double>>")
    with pytest.raises(Exception, match="anchors"):
        detect.decoded(df, ["f"], HEADS[2], 32).collect()


def test_suppression_is_by_class_and_the_best_of_a_frame_stay(spark):
    rng = random.Random(8)
    raw = [[rng.uniform(5, 27), rng.uniform(5, 27), 8.0, 8.0, *[rng.choice([0.2, 0.4, 0.8]) + rng.random() / 100 for _ in range(3)]] for _ in range(60)]
    df = spark.createDataFrame([(1, 32, 32, raw), (2, 32, 32, raw[:30])], "f long, width int, height int, raw array<array<double>>")
    for most in (300, 6):
        got = defaultdict(list)
        for r in detect.detections(df, ["f"], detect.Head(3), 32, most=most).collect():
            got[r["f"]].append(r["anchor"])
        for f, rows in ((1, raw), (2, raw[:30])):
            kept = []
            for b in sorted(loop_decode(rows, 32, 32, detect.Head(3), 32, 0.25), key=lambda x: -x[5]):
                if all(k[6] != b[6] or tracking.iou_table(np.array([k[1:5]]), np.array([b[1:5]]))[0, 0] <= 0.45 for k in kept):
                    kept.append(b)
            assert sorted(got[f]) == sorted(b[0] for b in kept[:most])


SCHEMA = "seg long, t double, cls int, x1 double, y1 double, x2 double, y2 double, score double"
P = Tracker(high=0.5, low=0.1, iou_high=0.25, iou_low=0.45, most_missed=4, least_hits=3)


def walk(seg, t0, n, x0, y, score=0.9, cls=0, step=10.0):
    return [(seg, float(t0 + i), cls, x0 + step * i, y, x0 + step * i + 40, y + 90, score) for i in range(n)]


def reference_tracks(rows, frames, p):
    """Whole segments in memory, frame by frame, numbers taken when tracks start."""
    out = []
    for seg in sorted({s for s, _ in frames}):
        follower = tracking.Follower(p)
        own = sorted((r for r in rows if r[0] == seg), key=lambda r: (r[1], -r[7], r[3], r[4]))
        for t in sorted(t for s, t in frames if s == seg):
            at = [i for i, r in enumerate(own) if r[1] == t]
            found = follower.frame(np.array([own[i][2] for i in at], np.int64), np.array(at, np.int64), np.array([own[i][3:7] for i in at]).reshape(-1, 4), np.array([own[i][7] for i in at]))
            out += [(*own[i], n) for i, n in found]
    return Counter(out)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_the_stream_is_the_walk_whatever_the_batches(spark, batch):
    rng, rows = random.Random(1), []
    for seg in range(4):
        for _ in range(12):
            rows += [r for r in walk(seg, rng.randint(0, 30), rng.randint(1, 20), rng.uniform(0, 500), rng.choice([0.0, 100.0, 300.0]), rng.choice([0.9, 0.6]), rng.randint(0, 2)) if rng.random() > 0.2]
        rows += walk(seg, 5, 10, 700.0, 0.0, 0.3)
    frames = [(seg, float(t)) for seg in range(5) for t in range(60) if rng.random() > 0.1 or any(r[0] == seg and r[1] == t for r in rows)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = tracking.tracks(spark.createDataFrame(rows, SCHEMA), ["seg"], p=P, frames=spark.createDataFrame(frames, "seg long, t double"))
        got = Counter(tuple(r) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == reference_tracks(rows, frames, P) and len(got) > 100


def tracked(spark, rows, frames=None):
    df = tracking.tracks(spark.createDataFrame(rows, SCHEMA), ["seg"], p=P, frames=spark.createDataFrame([(1, float(t)) for t in range(frames)], "seg long, t double") if frames else None)
    return {r["track_id"]: r["n"] for r in df.groupBy("track_id").agg(F.count("*").alias("n")).collect()}


def test_short_and_long_absences(spark):
    assert tracked(spark, walk(1, 0, 4, 0.0, 0.0) + walk(1, 6, 4, 60.0, 0.0), 10) == {1: 8}
    assert tracked(spark, walk(1, 0, 4, 0.0, 0.0) + walk(1, 14, 4, 300.0, 0.0), 18) == {1: 4, 2: 4}


def test_doubtful_boxes_sustain_a_track_but_start_none(spark):
    rows = walk(1, 0, 8, 0.0, 0.0)
    weak = [(*r[:7], 0.2 if 2 <= i <= 4 else 0.9) for i, r in enumerate(rows)]
    assert tracked(spark, weak) == {1: 8} and tracked(spark, [(*r[:7], 0.2) for r in rows]) == {}


def test_classes_do_not_swap(spark):
    rows = [x for i in range(8) for x in ((1, float(i), 0, i * 20.0, 100.0, i * 20 + 40.0, 190.0, 0.9), (1, float(i), 16, 140.0 - i * 20, 100.0, 180.0 - i * 20, 190.0, 0.9))]
    assert tracked(spark, rows) == {1: 8, 2: 8}


def test_a_blip_is_discarded_and_takes_its_number_with_it(spark):
    blip = [(1, 0.0, 0, 0.0, 0.0, 40.0, 90.0, 0.9)]
    assert tracked(spark, blip, 9) == {}
    assert tracked(spark, blip + walk(1, 6, 5, 500.0, 0.0), 12) == {2: 5}


def test_tracks_end_when_the_window_changes(spark):
    rows = walk(1, 0, 4, 0.0, 0.0) + walk(2, 4, 4, 40.0, 0.0)
    df = tracking.tracks(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["seg"], p=P)
    assert sorted((r["seg"], r["track_id"]) for r in df.select("seg", "track_id").distinct().collect()) == [(1, 1), (2, 1)]
    assert tracking.tracks(spark.createDataFrame([], SCHEMA), ["seg"], p=P).count() == 0
