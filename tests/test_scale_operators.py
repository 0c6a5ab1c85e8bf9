"""Nearest spans, gallery blocks, quantiles and dense numbers against brute force, also where groups are cut."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.config import Matching
from sightline.operators import identity, ingest, intervals, quantiles


def brute_nearest(at, spans, preferred):
    ranked = [((not (preferred and p), max(s - at, at - e, 0.0), s, i), i, max(s - at, at - e, 0.0)) for i, s, e, p in spans]
    return min(ranked)[1:] if ranked else (None, None)


@pytest.mark.parametrize("preferred", [False, True])
@pytest.mark.parametrize("bucket", [3.0, 86400.0])
def test_nearest(spark, preferred, bucket):
    rng = random.Random(7)
    spans = []
    for k in range(3):
        for i in range(60):
            s = rng.choice([rng.randint(0, 60), rng.uniform(0, 60)])
            spans.append((k, i, float(s), float(s + rng.choice([0, 0, 1, 3, rng.uniform(0, 20)])), rng.random() < 0.3))
    at = [(n, rng.randint(0, 3), rng.choice([float(rng.randint(-5, 70)), rng.uniform(-5, 90)]), "x") for n in range(300)]
    odd = [(900, None, 1.0, "x"), (901, 0, None, "x"), (902, 1, 5.0, "x"), (902, 1, 5.0, "x")]
    known = spark.createDataFrame([*spans, (None, 1, 0.0, 9.0, True), (0, 500, None, 9.0, True), (0, None, 1.0, 9.0, True)], "k int, id long, s double, e double, good boolean")
    asked = spark.createDataFrame(at + odd, "n int, k int, at double, id string").withColumnRenamed("id", "other")
    out = intervals.nearest(asked, known, ["k"], "n", "at", "id", "s", "e", F.col("good") if preferred else None, bucket=bucket)
    assert out.columns == ["n", "k", "at", "other", "id", "gap"]
    rows = out.collect()
    assert len(rows) == len(at) + len(odd)
    for r in rows:
        want = (None, None) if r.k is None or r["at"] is None else brute_nearest(r["at"], [x[1:] for x in spans if x[0] == r.k], preferred)
        assert (r.id, r.gap and round(r.gap, 9)) == (want[0], want[1] and round(want[1], 9)), r
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.nearest(asked, known.limit(0), ["k"], "n", "at", "id", "s", "e").where("id IS NOT NULL OR gap IS NOT NULL").count() == 0


def brute_match(v, known, p):
    best = {}
    for who, w in known:
        best[who] = max(best.get(who, -9), float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)))
    (who, top), *rest = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    lead = top - (rest[0][1] if rest else 0.0)
    return (who if top >= p.threshold and lead >= p.margin else None, top, lead)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_gallery_blocks(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(identity, "BLOCK", 7)
    monkeypatch.setattr(identity, "BATCH", 20)
    rng, p = np.random.default_rng(1), Matching(0.85, 0.02)
    known = [(f"w{rng.integers(0, 9)}", rng.normal(size=4).tolist()) for _ in range(50)] + [("w0", [1.0, 0.0, 0.0, 0.0])] * 20
    asked = [(i, rng.normal(size=4).tolist()) for i in range(90)] + [(200, [1.0, 0.0, 0.0, 0.0])]
    c = spark.createDataFrame([*asked, (300, None)], "id long, vector array<double>")
    g = spark.createDataFrame([*known, ("w1", None), (None, [1.0, 0.0, 0.0, 0.0])], "identity string, vector array<double>")
    out = identity.matches(c, g, "id", p, most_bytes=most_bytes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {r["id"]: r for r in out.collect()}
    assert found.pop(300)["reason"] == "no vector" and len(found) == len(asked)
    for i, v in asked:
        who, top, lead = brute_match(v, known, p)
        assert found[i]["identity"] == who and found[i]["score"] == pytest.approx(top) and found[i]["lead"] == pytest.approx(lead)
    assert len({r["reason"] for r in found.values()}) == 3


@pytest.mark.parametrize("gathered", [10_000, 5])
def test_quantiles(spark, gathered):
    rng = random.Random(3)
    groups = {
        1: [rng.gauss(0, 1) for _ in range(400)],
        2: [float(rng.choice([1, 1, 1, 2, 1e9])) for _ in range(300)],
        3: [5.0] * 50,
        4: [1.5],
        None: [-1e308, 1e308, 0.0, 1.0, *[rng.expovariate(1) for _ in range(60)]],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [(1, None), (7, None)]
    rng.shuffle(rows)
    wanted = {"low": 0.3, "half": 0.5, "top": 1.0, "least": 0.0}
    out = quantiles.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", wanted, count="n", gathered=gathered, bins=8)
    found = {r.g: r for r in out.collect()}
    assert set(found) == {*groups, 7} and found[7].n == 0 and found[7].half is None
    for g, own in groups.items():
        assert found[g].n == len(own) and found[g].half == pytest.approx(statistics.median(own))
        for name, q in wanted.items():
            assert found[g][name] == pytest.approx(float(np.quantile(own, q))), (g, name)
    assert quantiles.quantiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", wanted).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    words = [f"w{i % 37:02d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    rows = sorted((r["n"], r["w"]) for r in ingest.numbered(df, ["w"], "n", 10, rows=40).collect())
    assert [n for n, _ in rows] == list(range(10, 510)) and [w for _, w in rows] == sorted(words)
    assert ingest.numbered(df.limit(0), ["w"]).count() == 0
    named = ingest.named_ids(spark.createDataFrame([(4, "w03")], "id long, name string"), df.withColumnRenamed("w", "name"))
    assert sorted((r["id"], r["name"]) for r in named.collect()) == [(4, "w03"), *enumerate([w for w in sorted(set(words)) if w != "w03"], 5)]
    assert "Window" not in named._jdf.queryExecution().executedPlan().toString()
