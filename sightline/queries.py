"""Registered queries of the engine's operators on the driver's tables, each beside its SQL twin.

Floats are rounded to six digits on both sides, since sums differ in their last bits by order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.config import Hysteresis, Matching, Triage
from sightline.functions import geometry, times, vectors
from sightline.plans import ask
from sightline.operators import catalog, detect, filters, identity, ingest, intervals, search, segments, textindex, tracking, triage, zones
from sightline.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The vector and the words that the retrieval queries look for.
WORDS = ["the", "thonen", "und"]
EVENT_RULES = Hysteresis(open=60, close=20, gap_s=3600, least_s=600, roll_s=300)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as samples of a user's activity, in seconds."""
    return table(spark, d, "events").withColumn("t", times.epoch("ts"))


_T = "SELECT *, epoch(ts) AS t FROM events"
Q0 = "SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0"


def vector0(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [1.0]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, ({Q0}) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 200")
def semantic_topk(spark, d):
    out = search.semantic(table(spark, d, "embeddings"), vector0(spark, d), "vec_id", "embedding")
    return out.select("vec_id", r6(F.col("score")).alias("score"))


@query(f"SELECT label, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS score FROM embeddings, ({Q0}) GROUP BY label")
def semantic_best_per_group(spark, d):
    out = search.semantic(table(spark, d, "embeddings"), vector0(spark, d), "label", "embedding", limit=None)
    return out.select("label", r6(F.col("score")).alias("score"))


@query("""
WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT c.vec_id, g.label AS who, max(list_cosine_similarity(c.e, g.e)) AS score FROM u c, u g WHERE c.vec_id % 10 <> 0 AND g.vec_id % 10 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, lead(score, 1, 0) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, who))
SELECT vec_id, CASE WHEN score >= 0.42 AND score - nxt >= 0.06 THEN who END AS identity, round(score, 6) AS score,
  CASE WHEN score < 0.42 THEN 'below threshold' WHEN score - nxt < 0.06 THEN 'too close to call' END AS reason FROM r WHERE n = 1
""")
def identity_match(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    known = e.where("vec_id % 10 = 0").select(F.col("label").alias("identity"), "vector")
    out = identity.matches(e.where("vec_id % 10 <> 0"), known, "vec_id", Matching())
    return out.select("vec_id", "identity", r6(F.col("score")).alias("score"), "reason")


@query("""
WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
x AS (SELECT label, i, avg(e[i]) AS v FROM u, unnest(range(1, 65)) AS t(i) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(v * v)) AS n FROM x GROUP BY label)
SELECT label, i - 1 AS i, round(v / n, 6) AS v FROM x JOIN n USING (label)
""")
def vector_aggregate(spark, d):
    m = vectors.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("vector").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


_BM25 = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS len, {counts} FROM t),
s AS (SELECT count(*) AS n, avg(len) AS avg_len, {dfs} FROM p),
ranked AS (SELECT doc_id, {score} AS score FROM p, s WHERE {any})
"""


def bm25_sql() -> str:
    counts = ", ".join(f"len(list_filter(ws, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(WORDS))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(WORDS)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))" for i in range(len(WORDS)))
    return _BM25.format(counts=counts, dfs=dfs, score=score, any=" OR ".join(f"f{i} > 0" for i in range(len(WORDS))))


def document_index(spark, d) -> textindex.TextIndex:
    """The stored index of ``documents``, made when a query first asks for it and again when the files have changed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = f"{shared.shared_dir(spark)}/sightline/text-{shared.stamp(table(spark, d, 'documents'))}"
    shared.made_once(spark, path, lambda at: textindex.TextIndex.build(docs, "doc_id", "text", at))
    return textindex.TextIndex(spark, path, "doc_id", dict(docs.dtypes)["doc_id"])


@query(bm25_sql() + "SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, doc_id LIMIT 200")
def bm25_topk(spark, d):
    out = document_index(spark, d).ranked(WORDS, 200)
    return out.select("doc_id", r6(F.col("score")).alias("score"))


@query(bm25_sql() + f""",
good AS (SELECT doc_id FROM labels WHERE quality = 1),
sem AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (
  SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, ({Q0})
  WHERE vec_id IN (SELECT doc_id FROM good) AND vec_id IN (SELECT doc_id FROM documents) ORDER BY s DESC, vec_id LIMIT 200)),
lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (
  SELECT * FROM ranked WHERE doc_id IN (SELECT doc_id FROM good) ORDER BY score DESC, doc_id LIMIT 200)),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.r AS rank0, b.r AS rank1, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score FROM sem a FULL JOIN lex b ON a.doc_id = b.doc_id)
SELECT doc_id, rank0, rank1, round(score, 6) AS score FROM f ORDER BY f.score DESC, rank0 NULLS LAST, rank1 NULLS LAST, doc_id LIMIT 40
""")
def rrf_hybrid(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    out = search.hybrid(docs, "doc_id", "text", vecs, "vector", " ".join(WORDS), vector0(spark, d), good, index=document_index(spark, d))
    return out.select("doc_id", F.col("rank0").cast("long").alias("rank0"), F.col("rank1").cast("long").alias("rank1"), r6(F.col("score")).alias("score"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def segment_document(spark, d):
    return search.joined_bodies(table(spark, d, "conversations"), "conv_id", ["turn"], "text")


RUNS = f"""
WITH e AS ({_T}), sg AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value < 20 THEN 0 END AS sign FROM e),
st AS (SELECT *, coalesce(last_value(sign IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM sg),
nw AS (SELECT *, CASE WHEN on_ = 0 OR lag(on_, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 0 THEN 1 ELSE 0 END AS fresh FROM st),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM nw),
runs AS (SELECT user_id, min(t) AS s, max(t) + 60 AS e FROM rn WHERE on_ = 1 GROUP BY user_id, run),
g AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600 THEN 0 ELSE 1 END AS fresh FROM runs),
g2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g),
merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g2 GROUP BY user_id, run HAVING max(e) - min(s) >= 600)
"""


def _runs(spark, d):
    return segments.merged_runs(segments.hysteresis_runs(events(spark, d), ["user_id"], "t", "value", ["ts", "event_id"], EVENT_RULES, 60.0), ["user_id"], EVENT_RULES)


@query(RUNS + 'SELECT user_id, s AS "start", e AS "end" FROM merged')
def hysteresis_segments(spark, d):
    return _runs(spark, d)


@query(RUNS + """, sc AS (SELECT m.user_id, m.s, m.e, avg(value) AS score, arg_max(t, struct_pack(v := value, n := -t)) AS peak FROM merged m JOIN e x ON x.user_id = m.user_id AND x.t >= m.s AND x.t < m.e GROUP BY ALL),
wd AS (SELECT user_id, greatest(s - 300, 0) AS s, e + 300 AS e, score, peak FROM sc),
wg AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM wd),
w2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM wg)
SELECT user_id, min(s) AS "start", max(e) AS "end", round(max(score), 6) AS score, arg_max(peak, struct_pack(v := score, n := -s)) AS peak FROM w2 GROUP BY user_id, run""")
def segments_scored(spark, d):
    scored = segments.score_runs(_runs(spark, d), events(spark, d), ["user_id"], "t", "value")
    return segments.rolled(scored, ["user_id"], None, EVENT_RULES).withColumn("score", r6(F.col("score")))


_SPANS = f"""
WITH x AS (SELECT user_id, t AS s, t + value * 60 AS e FROM ({_T})),
g AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM x),
g2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g),
spans AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g2 GROUP BY user_id, run)
"""


def _spans(spark, d):
    s = events(spark, d).select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"))
    return intervals.coalesce_spans(s, ["user_id"])


@query(_SPANS + 'SELECT user_id, round(s, 3) AS "start", round(e, 3) AS "end" FROM spans')
def coalesce_intervals(spark, d):
    return _spans(spark, d).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(_SPANS + f""", u AS (SELECT event_id, user_id, t, t + 120 AS t2 FROM ({_T})),
b AS (SELECT u.event_id, arg_min(spans.s, spans.s) AS s FROM u JOIN spans ON u.user_id = spans.user_id AND spans.s <= u.t2 AND spans.e >= u.t GROUP BY u.event_id)
SELECT event_id, round(s, 3) AS span_start FROM u LEFT JOIN b USING (event_id)""")
def overlap_first_match(spark, d):
    u = events(spark, d).select("event_id", "user_id", F.col("t").alias("u0"), (F.col("t") + 120).alias("u1"))
    s = _spans(spark, d).select("user_id", F.col("start").alias("s0"), F.col("end").alias("s1"), F.col("start").alias("span_start"))
    out = intervals.first_overlap(u, s, ["user_id"], "event_id", ("u0", "u1"), "span_start", ("s0", "s1"))
    return out.select("event_id", F.round("span_start", 3).alias("span_start"))


@query(_SPANS + """, p AS (SELECT DISTINCT user_id, 1705320000.0 AS inst FROM events),
g3 AS (SELECT p.user_id, s, greatest(s - inst, inst - e, 0) AS gap FROM p JOIN spans USING (user_id))
SELECT user_id, round(arg_min(s, struct_pack(g := gap, s := s)), 3) AS span_start, round(min(gap), 3) AS gap FROM g3 GROUP BY user_id""")
def nearest_segment(spark, d):
    at = table(spark, d, "events").select("user_id").distinct().withColumn("at", F.lit(1705320000.0))
    s = _spans(spark, d).withColumn("span_start", F.col("start"))
    out = intervals.nearest(at, s, ["user_id"], "user_id", "at", "span_start", "start", "end")
    return out.select("user_id", F.round("span_start", 3).alias("span_start"), F.round("gap", 3).alias("gap"))


@query("""
WITH h AS (SELECT event_type, epoch(date_trunc('hour', ts)) AS hr, avg(value) AS v FROM events GROUP BY ALL),
q AS (SELECT event_type, quantile_cont(v, 0.3) AS base, median(v) AS m FROM h GROUP BY event_type),
s AS (SELECT event_type, any_value(base) AS base, greatest(1.4826 * median(abs(v - base)), 0.03 * any_value(base)) AS spread FROM h JOIN q USING (event_type) WHERE v <= m GROUP BY event_type)
SELECT event_type, round(base, 6) AS base, round(spread, 6) AS spread, round(greatest(base + 3 * spread, 1.08 * base), 6) AS threshold FROM s
""")
def robust_threshold(spark, d):
    h = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hr")).agg(F.avg("value").alias("v"))
    s = triage.idle_level(h, ["event_type"], "v")
    threshold = F.greatest(F.col("base") + 3 * F.col("spread"), 1.08 * F.col("base"))
    return s.select("event_type", r6(F.col("base")).alias("base"), r6(F.col("spread")).alias("spread"), r6(threshold).alias("threshold"))


@query("""
WITH p AS (SELECT l_linenumber, median(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY l_linenumber)
SELECT l_orderkey, l_linenumber, round(l_extendedprice / CASE WHEN n >= 5 AND m > 0 THEN m ELSE (SELECT median(l_extendedprice) FROM lineitem) END, 6) AS rel FROM lineitem JOIN p USING (l_linenumber)
""")
def position_normalise(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(1).alias("k"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return triage.relative_sizes(li, "k", "l_linenumber", "l_extendedprice").select("l_orderkey", "l_linenumber", r6(F.col("rel")).alias("rel"))


@query()
def rolling_baseline(spark, d):
    """Hourly bins of each event type as a recording: levels, thresholds and flags."""
    e = events(spark, d)
    first = e.agg(F.floor(F.min("t") / 3600).alias("_0"))
    b = e.join(F.broadcast(first)).groupBy(F.col("event_type").alias("video_id"), (F.floor(F.col("t") / 3600) - F.col("_0")).cast("int").alias("bin")).agg(F.avg("value").alias("value"))
    b = b.withColumns({"scorable": F.lit(True), "blind": F.lit(False)})
    p = Triage(window_s=48, bin_s=1)
    out = triage.flagged(triage.smoothed(triage.rolling_level(b, p=p), p=p), p)
    return out.select("video_id", "bin", r6(F.col("base")).alias("base"), r6(F.col("threshold")).alias("threshold"), "high", "low")


_DAY = 1705276800.0


@query(f"""
WITH x AS (SELECT greatest(t - {_DAY}, 0) AS lo, least(t + value - {_DAY}, 86400) AS hi, value AS v FROM ({_T}) WHERE t + value > {_DAY} AND t < {_DAY} + 86400),
b AS (SELECT unnest(range(CAST(floor(lo / 60) AS BIGINT), CAST(least(floor((hi - 1e-9) / 60), 1439) AS BIGINT) + 1)) AS bucket, lo, hi, v FROM x WHERE hi > lo),
a AS (SELECT bucket, max(v) AS activity, sum(least(hi, (bucket + 1) * 60) - greatest(lo, bucket * 60)) AS coverage FROM b WHERE least(hi, (bucket + 1) * 60) - greatest(lo, bucket * 60) > 0 GROUP BY bucket)
SELECT r.bucket, round(coalesce(activity, 0), 6) AS activity, round(coalesce(coverage, 0), 3) AS coverage FROM range(1440) r(bucket) LEFT JOIN a USING (bucket)
""")
def minute_timeline(spark, d):
    e = events(spark, d)
    s = e.select(F.col("t").alias("ts_start"), (F.col("t") + F.col("value")).alias("ts_end"), F.col("value").alias("activity_score"))
    v = e.select(F.col("t").alias("start_ts"), F.col("value").alias("duration"))
    out = intervals.minute_timeline(s, v, _DAY)
    return out.select("bucket", r6(F.col("activity")).alias("activity"), F.round("coverage", 3).alias("coverage"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def days_rollup(spark, d):
    return catalog.days(events(spark, d), "t", F.col("value")).select("day", "n", F.round("seconds", 4).alias("seconds"))


ANCHORS = "SELECT event_id, user_id, ts, epoch(ts) AS t, least(value / 200, 1) AS x, coalesce(least(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 200, 1), 0) AS y FROM events"


def anchors(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d)
    return e.select("event_id", "user_id", "ts", "t", F.least(F.col("value") / 200, F.lit(1.0)).alias("x"), F.coalesce(F.least(F.lag("value").over(w) / 200, F.lit(1.0)), F.lit(0.0)).alias("y"))


@query(f"""
WITH a AS ({ANCHORS}), p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, (0.5 - 0.5) * (y - 0) - (1 - 0) * (x - 0.5) AS sq, (0.5 - 0.5) * (py - 0) - (1 - 0) * (px - 0.5) AS sp,
  (x - px) * (0 - py) - (y - py) * (0.5 - px) AS sa, (x - px) * (1 - py) - (y - py) * (0.5 - px) AS sb FROM p WHERE px IS NOT NULL)
SELECT event_id, user_id, CASE WHEN sq > 0 THEN 'cross_in' ELSE 'cross_out' END AS kind FROM s WHERE sp * sq < 0 AND sa * sb < 0
""")
def zone_crossings(spark, d):
    return zones.line_crossings(anchors(spark, d), ["user_id"], ["ts", "event_id"], "x", "y", (0.5, 0.0, 0.5, 1.0)).select("event_id", "user_id", "kind")


SQUARE = [[0.1, 0.1], [0.6, 0.1], [0.6, 0.6], [0.1, 0.6]]


def _fold(parts: list[str]) -> str:
    out = f"coalesce({parts[0]}, false)"
    for p in parts[1:]:
        out = f"({out} <> coalesce({p}, false))"
    return out


def _polygon():
    return F.array(*[F.array(*map(F.lit, p)) for p in SQUARE])


IN = _fold([f"(({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / nullif({b[1]} - {a[1]}, 0)::DOUBLE + {a[0]})" for a, b in zip(SQUARE, SQUARE[1:] + SQUARE[:1])])


@query(f"SELECT p_partkey, {IN} AS inside FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, least(p_retailprice / 2000, 1) AS y FROM part)")
def point_in_polygon(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), F.least(F.col("p_retailprice") / 2000, F.lit(1.0)).alias("y"))
    return p.select("p_partkey", geometry.in_polygon(F.col("x"), F.col("y"), _polygon()).alias("inside"))


@query(f"""
WITH a AS (SELECT *, {IN} AS ins FROM ({ANCHORS})),
n AS (SELECT *, CASE WHEN ins = lag(ins) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh, max(t) OVER (PARTITION BY user_id) AS fin FROM a),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
q AS (SELECT user_id, run, bool_or(ins) AS ins, min(t) AS t, count(*) AS c, max(fin) AS fin FROM r GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT *, lag(ins, 1, false) OVER (PARTITION BY user_id ORDER BY run) AS was FROM q),
m AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY run) AS nxt FROM c WHERE ins <> was)
SELECT user_id, CASE WHEN ins THEN 'enter' ELSE 'exit' END AS kind, t, 0.0::DOUBLE AS duration FROM m UNION ALL
SELECT user_id, 'dwell', t, round(coalesce(nxt, fin) - t, 6) FROM m WHERE ins
""")
def zone_region_events(spark, d):
    a = anchors(spark, d).withColumn("inside", geometry.in_polygon(F.col("x"), F.col("y"), _polygon()))
    return zones.region_events(a, ["user_id"], ["ts", "event_id"], "t", "inside", 2).withColumn("duration", r6(F.col("duration")))


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)
AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
""")
def exists_filters(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id"), "l_returnflag", "l_quantity")
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    s = filters._having(filters._having(o, li.where("l_returnflag = 'R'")), li.where("l_quantity > 40"))
    return s.join(c, "o_custkey", "left_semi").select(F.col("id").alias("o_orderkey"), "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_pending(spark, d):
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.lit(None).cast("double").alias("transcribed_at"))
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"))
    return filters.pending_speech(v, u).select(F.col("id").alias("c_custkey"), "c_name")


@query("""
SELECT l_orderkey, l_linenumber, n_name, s_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000 WHERE l_quantity >= 45
""")
def star_events(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey", "s_name")
    j = li.where("l_quantity >= 45").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "n_name", "s_name")


@query("""
SELECT (SELECT count(*) FROM orders) AS videos, round((SELECT sum(o_totalprice) FROM orders), 2) AS seconds, round((SELECT 1 - sum(o_totalprice / 4) / sum(o_totalprice) FROM orders), 6) AS reduction,
(SELECT count(*) FROM customer) AS segments, (SELECT count(*) FROM part) AS tracklets, (SELECT count(*) FROM part WHERE p_brand = 'Brand#11') AS people,
(SELECT count(*) FROM nation) AS zones, (SELECT count(*) FROM region) AS cameras, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM embeddings WHERE label::VARCHAR IS DISTINCT FROM '3') AS stale
""")
def library_summary(spark, d):
    none = F.lit(None).cast("long")
    v = table(spark, d, "orders").select(F.col("o_totalprice").alias("duration"), (F.col("o_totalprice") / 4).alias("active_seconds"))
    s = table(spark, d, "customer").select(none.alias("analyzed_at"))
    t = table(spark, d, "part").select(F.when(F.col("p_brand") == "Brand#11", "person").alias("label"), none.alias("identity_id"), none.alias("caption"))
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("model"))
    out = catalog.library_summary(v, s, t, table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region"), e, "3")
    return out.select("videos", F.round("seconds", 2).alias("seconds"), r6(F.col("reduction")).alias("reduction"), "segments", "tracklets", "people", "zones", "cameras", "embeddings", "stale")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 8")
def top_labels(spark, d):
    return catalog.top(table(spark, d, "part"), "p_brand", 8)


@query("SELECT n_nationkey, count(c_custkey) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def cameras_rollup(spark, d):
    return catalog.rollup(table(spark, d, "nation"), "n_nationkey", table(spark, d, "customer"), "c_nationkey", "c_acctbal").withColumn("total", F.round("total", 2))


@query("""
SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation
""")
def correlated_counts(spark, d):
    kids = {"customers": (table(spark, d, "customer"), "c_nationkey"), "suppliers": (table(spark, d, "supplier"), "s_nationkey")}
    return catalog.counted(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", kids)


@query(f"""
WITH b AS (SELECT user_id, event_id, t, ts, value / 500 AS x FROM ({_T}))
SELECT user_id, count(*) AS n_detections, round(avg(x), 6) AS mean_score, max(x) AS max_score, min(t) AS t_start, max(t) AS t_end, min(x) AS x1, max(x + 0.1) AS x2,
  round(arg_min(x + 0.05, struct_pack(t := t, x := x + 0.05)), 6) AS x_start, round(arg_max(x + 0.05, struct_pack(t := t, x := x + 0.05)), 6) AS x_end FROM b GROUP BY user_id
""")
def tracklet_rollup(spark, d):
    x = F.col("value") / 500
    b = events(spark, d).select("user_id", "t", F.col("t").alias("ts"), x.alias("x1"), x.alias("y1"), (x + 0.1).alias("x2"), (x + 0.1).alias("y2"), x.alias("score"))
    out = catalog.tracklet_rollup(b, "user_id")
    return out.select("user_id", "n_detections", r6(F.col("mean_score")).alias("mean_score"), "max_score", "t_start", "t_end", "x1", "x2", r6(F.col("x_start")).alias("x_start"), r6(F.col("x_end")).alias("x_end"))


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY lpad(doc_id::VARCHAR, 12, '0')) > 1 THEN 'duplicate' ELSE 'new' END AS status FROM documents
""")
def dedupe_fingerprint(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.md5(F.col("text").cast("binary")).alias("fingerprint"), F.col("n_chars").alias("size"), F.lit(0.0).alias("mtime"))
    known = docs.select("path", F.lit(None).cast("double").alias("ingested_at"), F.col("size").alias("size_bytes"), "mtime", "fingerprint").limit(0)
    return ingest.statuses(docs, known).select("doc_id", "status")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return ingest.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id").withColumn("value", r6(F.col("value")))


@query("SELECT event_id FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6")
def time_of_day(spark, d):
    return filters.in_hours(events(spark, d), "t", 22, 6).select("event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_by_kind(spark, d):
    return catalog.events_by_kind(table(spark, d, "events").withColumnRenamed("event_type", "kind")).withColumnRenamed("kind", "event_type")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def label_counts(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("segment_id"), F.col("event_type").alias("label"))
    return catalog.label_counts(t).select(F.col("segment_id").alias("user_id"), F.col("n_tracklets").alias("n"), F.size("labels").cast("long").alias("kinds"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, epoch(ts), event_id) AS n FROM events) WHERE n <= 5")
def best_crops(spark, d):
    e = events(spark, d)
    return catalog.best_rows(e, ["user_id"], [F.desc("value"), F.asc("t"), F.asc("event_id")], 5).select("user_id", "event_id")


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber * 90 - 90 AS deg, sum(l_discount) AS c FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
b AS (SELECT l_suppkey, arg_max(deg, struct_pack(c := round(c, 4), d := -deg)) AS deg, max(round(c, 4)) AS best, coalesce(max(round(c, 4)) FILTER (deg = 0), 0) AS up FROM s GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN best > 0 AND best >= 1.35 * up THEN deg ELSE 0 END::BIGINT AS rotation FROM b
""")
def orientation_vote(spark, d):
    v = table(spark, d, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("video_id"), (F.col("l_linenumber") * 90 - 90).alias("degrees")).agg(F.round(F.sum("l_discount"), 4).alias("conf"))
    return catalog.orientation(v).select(F.col("video_id").alias("l_suppkey"), F.col("rotation").cast("long").alias("rotation"))


@query("""
SELECT doc_id, score FROM (SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY n_chars DESC, doc_id DESC LIMIT 40)
""")
def browse_newest(spark, d):
    return search.browse(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 0"), "doc_id", "n_chars")


def _boxes(spark, d):
    li = table(spark, d, "lineitem")
    x, y = F.pmod(F.col("l_partkey"), F.lit(90)) / 100, F.pmod(F.col("l_orderkey"), F.lit(90)) / 100
    return li.select(F.col("l_suppkey").alias("video_id"), F.dayofmonth("l_shipdate").cast("double").alias("t"), F.col("l_linenumber").cast("int").alias("cls"), x.alias("x1"), y.alias("y1"), (x + 0.1).alias("x2"), (y + 0.1).alias("y2"), (F.col("l_discount") * 5 + 0.4).alias("score"))


@query()
def nms_boxes(spark, d):
    """Boxes of all suppliers' lines as frames."""
    return tracking.nms(_boxes(spark, d), ["video_id", "t"])


@query()
def track_objects(spark, d):
    return tracking.tracks(_boxes(spark, d), ["video_id"])


@query()
def stemmed_bm25(spark, d):
    out = search.bm25(table(spark, d, "documents"), "doc_id", "text", "thing thinking", stems=True, limit=200)
    return out.select("doc_id", r6(F.col("score")).alias("score"))


@query()
def filename_times(spark, d):
    """Start times read back from made-up file names of the events."""
    e = table(spark, d, "events")
    p = e.select("event_id", F.concat(F.lit("/nvr/ch "), F.pmod("event_id", F.lit(8)).cast("string"), F.lit("/rec_"), F.date_format("ts", "yyyyMMdd__HHmmss"), F.lit(".mp4")).alias("path"))
    return p.select("event_id", ingest.filename_time(F.col("path")).alias("ts"), ingest.camera_name(F.col("path")).alias("camera"))


SQL["filename_times"] = "SELECT event_id, epoch(date_trunc('second', ts)) AS ts, 'ch ' || (event_id % 8) AS camera FROM events"


@query(f"""
WITH v AS (SELECT o_orderkey AS video_id, o_totalprice / 1000 AS d FROM orders), k AS (SELECT *, floor(d / 15)::BIGINT AS w FROM v),
n AS (SELECT *, CASE WHEN d <= 15 THEN 1 ELSE w + CASE WHEN d - w * 15 >= 0.4 * 15 THEN 1 ELSE 0 END END AS n FROM k WHERE d > 0)
SELECT video_id, i * 15.0::DOUBLE AS "start", round(CASE WHEN i = n - 1 THEN d ELSE (i + 1) * 15 END, 6) AS "end" FROM n, unnest(range(0, n)) AS t(i)
""")
def even_windows(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_totalprice") / 1000).alias("duration"))
    return segments.even_windows(v).select("video_id", "start", r6(F.col("end")).alias("end"))


@query("""
SELECT event_id AS id, epoch(ts) AS ts, round(value, 6) AS duration, 'user ' || user_id AS identity, event_type AS label FROM events
WHERE user_id = 7 AND event_type = 'error' AND hour(ts) >= 12 AND hour(ts) < 18
""")
def ask_sightings(spark, d):
    """A typed question over events as sightings: name and label are grounded in the table's own vocabulary."""
    plan, args = _asked(spark, d, "when did user 7 have an error in the afternoon")
    rows = ask.answer_rows(plan, *args)
    return rows.select("id", "ts", r6(F.col("duration")).alias("duration"), "identity", "label")


@query("SELECT count(*) AS n, CASE count(*) WHEN 0 THEN 'No record of user 7.' WHEN 1 THEN '1 time' ELSE count(*) || ' times' END AS answer FROM events WHERE user_id = 7 AND event_type = 'error' AND hour(ts) >= 6 AND hour(ts) < 12")
def ask_how_many(spark, d):
    plan, args = _asked(spark, d, "how many times did user 7 have an error in the morning")
    return ask.headline(plan, ask.answer_rows(plan, *args))


def _asked(spark, d, question):
    e = events(spark, d)
    t = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("segment_id"), F.col("t").alias("ts_start"), (F.col("t") + F.col("value")).alias("ts_end"), F.col("user_id").alias("identity_id"), F.col("event_type").alias("label"), F.lit(0).alias("camera_id"))
    people = e.select(F.col("user_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name")).distinct()
    cameras = spark.createDataFrame([(0, "gate")], "id long, name string")
    none = spark.createDataFrame([], "id long, zone_id long, tracklet_id long, segment_id long, camera_id long, name string, kind string, label string, ts double, duration double")
    known = ask.vocabulary(question, people, none, cameras, t)
    plan = ask.parse(question, known, dt.date(2024, 1, 20))
    return plan, (none.drop("name"), none.select(F.col("id"), "name"), t, people, cameras)


def _raw_grid(spark, d):
    """Embeddings as the raw output of a grid head: five anchors of eight attributes; every third one a row per attribute."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: F.abs(x.cast("double")) * 4))
    turned = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.abs(F.col("embedding")[i * 8 + k].cast("double")) * 4))
    return table(spark, d, "embeddings").select("vec_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.when(F.col("vec_id") % 3 == 0, turned).otherwise(rows).alias("raw"))


GRID_HEAD = detect.Head(classes=3, objectness=True, grid=True, strides=(32, 64), centred=False)


@query("""
WITH a AS (SELECT vec_id, i, list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: abs(x::DOUBLE) * 4) AS p FROM embeddings, range(5) t(i)),
s AS (SELECT *, list_transform(p[6:8], lambda x: x * p[5]) AS sc FROM a), b AS (SELECT *, list_max(sc) AS score, list_position(sc, list_max(sc)) - 1 AS cls FROM s WHERE list_max(sc) >= 0.25),
g AS (SELECT *, CASE WHEN i < 4 THEN i % 2 ELSE 0 END AS gx, CASE WHEN i < 4 THEN i // 2 ELSE 0 END AS gy, CASE WHEN i < 4 THEN 32 ELSE 64 END AS st FROM b),
c AS (SELECT *, (p[1] + gx) * st AS cx, (p[2] + gy) * st AS cy, exp(p[3]) * st AS w, exp(p[4]) * st AS h FROM g)
SELECT vec_id, i AS anchor, round(greatest(0, least((cx - w / 2) / (64.0::DOUBLE / 1920), 1920)), 6) AS x1, round(greatest(0, least((cy - h / 2) / (64.0::DOUBLE / 1920), 1080)), 6) AS y1,
  round(greatest(0, least((cx + w / 2) / (64.0::DOUBLE / 1920), 1920)), 6) AS x2, round(greatest(0, least((cy + h / 2) / (64.0::DOUBLE / 1920), 1080)), 6) AS y2, round(score, 6) AS score, cls::INT AS cls FROM c
""")
def decode_grid(spark, d):
    out = detect.decoded(_raw_grid(spark, d), ["vec_id"], GRID_HEAD, 64)
    return out.select("vec_id", F.col("anchor").cast("long").alias("anchor"), *[r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "cls")


def _raw_plain(spark, d):
    """Orders as frames, their lines as anchors in pixels of a 640 square with four classes and no objectness."""
    li = table(spark, d, "lineitem")
    of = lambda k: F.when(F.col("l_suppkey") % 4 == k, F.col("l_discount") * 10).otherwise(F.col("l_tax")).cast("double")
    line = F.array((F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 640).cast("double"), F.col("l_quantity").cast("double") * 4, F.col("l_quantity").cast("double") * 2, of(0), of(1), of(2), of(3))
    # a frame has at most as many anchors as an order has lines
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("p")))).alias("_r"))
    return rows.select("l_orderkey", F.lit(1000).alias("width"), F.lit(751).alias("height"), F.transform("_r", lambda r: r["p"]).alias("raw"))


@query("""
WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 640, l_suppkey % 640, l_quantity) - 1 AS i, l_partkey % 640 AS cx, l_suppkey % 640 AS cy, l_quantity::DOUBLE * 4 AS w, l_quantity::DOUBLE * 2 AS h,
  list_transform(range(4), lambda k: CASE WHEN l_suppkey % 4 = k THEN (l_discount * 10)::DOUBLE ELSE l_tax::DOUBLE END) AS sc FROM lineitem),
b AS (SELECT *, list_max(sc) AS score, list_position(sc, list_max(sc)) - 1 AS cls FROM a WHERE list_max(sc) >= 0.25)
SELECT l_orderkey, i AS anchor, round(greatest(0, least((cx - w / 2) / 0.64::DOUBLE, 1000)), 6) AS x1, round(greatest(0, least((cy - h / 2 - 79) / 0.64::DOUBLE, 751)), 6) AS y1,
  round(greatest(0, least((cx + w / 2) / 0.64::DOUBLE, 1000)), 6) AS x2, round(greatest(0, least((cy + h / 2 - 79) / 0.64::DOUBLE, 751)), 6) AS y2, round(score, 6) AS score, cls::INT AS cls FROM b
""")
def decode_plain(spark, d):
    out = detect.decoded(_raw_plain(spark, d), ["l_orderkey"], detect.Head(classes=4), 640)
    return out.select("l_orderkey", F.col("anchor").cast("long").alias("anchor"), *[r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2", "score")], "cls")


@query()
def detected_boxes(spark, d):
    """Raw grid output to boxes, suppression included."""
    return detect.detections(_raw_grid(spark, d), ["vec_id"], GRID_HEAD, 64)


@query()
def track_sampled_frames(spark, d):
    """Boxes of all lines, and every day of a month as a sampled frame of each supplier's recording, whether it has a box or not."""
    boxes = _boxes(spark, d)
    frames = table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda n: n.cast("double"))).alias("t"))
    return tracking.tracks(boxes, ["video_id"], frames=frames)
