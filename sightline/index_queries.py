"""Registered queries over a made-up index: orders as segments, lines as tracklets and events, suppliers as identities, nations as zones, regions as cameras."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import geometry
from sightline.functions.times import epoch
from sightline.operators import filters, identity, ingest, search, segments, stages, triage, zones
from sightline.plans import ask
from sightline.queries import ANCHORS, EVENT_RULES, IN, RUNS, SQUARE, anchors, events
from sightline.queries import Q0 as _Q0
from sightline.sources import shared
from sightline.queries import WORDS, bm25_sql, document_index, query, r6, table, vector0

_INDEX = """WITH seg AS (SELECT o_orderkey AS id, o_custkey AS video_id, o_custkey % 5 AS camera_id, epoch(o_orderdate) AS ts_start, epoch(o_orderdate) + 3600 AS ts_end FROM orders),
tr AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS segment_id, l_suppkey % 25 AS video_id, l_suppkey % 5 AS camera_id, CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'dog' ELSE 'car' END AS label,
  CASE WHEN l_linenumber <= 2 THEN l_suppkey END AS identity_id, epoch(l_shipdate) AS ts_start, epoch(l_shipdate) + l_quantity AS ts_end, l_discount * 10 AS max_score, CASE WHEN l_tax >= 0.04 THEN l_linestatus END AS caption FROM lineitem),
ev AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS tracklet_id, l_partkey % 25 AS zone_id, l_orderkey AS segment_id, CASE l_linestatus WHEN 'O' THEN 'enter' ELSE 'cross_out' END AS kind, epoch(l_shipdate) AS ts FROM lineitem WHERE l_linenumber <= 3),
idn AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), zn AS (SELECT n_nationkey AS id, n_name AS name FROM nation), cam AS (SELECT r_regionkey AS id, r_name AS name FROM region)
"""


def _segments(spark, d):
    o, t = table(spark, d, "orders"), epoch("o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), F.pmod("o_custkey", F.lit(5)).alias("camera_id"), t.alias("ts_start"), (t + 3600).alias("ts_end"))


def _tracklets(spark, d):
    t = epoch("l_shipdate")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("segment_id"), F.pmod("l_suppkey", F.lit(25)).alias("video_id"), F.pmod("l_suppkey", F.lit(5)).alias("camera_id"),
        F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "N", "dog").otherwise("car").alias("label"), F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey")).alias("identity_id"),
        t.alias("ts_start"), (t + F.col("l_quantity")).alias("ts_end"), (F.col("l_discount") * 10).alias("max_score"), F.when(F.col("l_tax") >= 0.04, F.col("l_linestatus")).alias("caption"), F.lit(None).cast("string").alias("thumb_path"),
    )


def _events(spark, d):
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").where("l_linenumber <= 3").select(
        n.alias("id"), n.alias("tracklet_id"), F.pmod("l_partkey", F.lit(25)).alias("zone_id"), F.col("l_orderkey").alias("segment_id"), F.when(F.col("l_linestatus") == "O", "enter").otherwise("cross_out").alias("kind"), epoch("l_shipdate").alias("ts"),
    )


def _named(spark, d, name, key, label):
    return table(spark, d, name).select(F.col(key).cast("long").alias("id"), F.col(label).alias("name"))


def _identities(spark, d):
    return _named(spark, d, "supplier", "s_suppkey", "s_name")


def _zones(spark, d):
    return _named(spark, d, "nation", "n_nationkey", "n_name")


@query(_INDEX + """SELECT id FROM seg WHERE id IN (SELECT segment_id FROM tr WHERE label = 'person') AND id IN (SELECT segment_id FROM tr WHERE identity_id = 7) AND id IN (SELECT segment_id FROM ev WHERE kind = 'cross_out')""")
def allowed_segments(spark, d):
    """Segments with a person, a named identity and a crossing, each of any of their tracklets or events."""
    name = _identities(spark, d).where("id = 7").first()["name"]
    f = filters.SegmentFilter(label="person", identity=name, event_kind="cross_out")
    return filters.allowed_segments(_segments(spark, d), _tracklets(spark, d), _identities(spark, d), _events(spark, d), _zones(spark, d), f).select("id")


@query(_INDEX + """SELECT seg.id FROM seg JOIN (SELECT min(ts_start) AS first FROM seg) ON ts_end > epoch(date_trunc('day', to_timestamp(first) AT TIME ZONE 'UTC')) AND ts_start < epoch(date_trunc('day', to_timestamp(first) AT TIME ZONE 'UTC')) + 86400""")
def allowed_segments_of_day(spark, d):
    """Segments that overlap the calendar day of the first one."""
    s = _segments(spark, d)
    day = s.agg(F.date_format(F.timestamp_seconds(F.min("ts_start")), "yyyy-MM-dd").alias("day")).first()["day"]
    return filters.allowed_segments(s, _tracklets(spark, d), _identities(spark, d), _events(spark, d), _zones(spark, d), filters.SegmentFilter(day=day)).select("id")


@query(_INDEX + "SELECT ev.id, zn.name AS zone, idn.name AS identity, ev.ts FROM ev JOIN zn ON zn.id = zone_id JOIN tr ON tr.id = tracklet_id LEFT JOIN idn ON idn.id = identity_id WHERE zone_id = 3 AND kind = 'enter'")
def event_listing(spark, d):
    return filters.event_rows(_events(spark, d), _zones(spark, d), _tracklets(spark, d), _identities(spark, d), zone_id=3, kind="enter").select("id", "zone", "identity", "ts")


@query(_INDEX + "SELECT tr.id, n_name AS path, idn.name, round(max_score, 6) AS max_score FROM tr JOIN nation ON n_nationkey = video_id LEFT JOIN idn ON idn.id = identity_id WHERE label = 'dog' AND max_score >= 0.5 ORDER BY ts_start DESC, tr.id DESC LIMIT 200")
def object_listing(spark, d):
    videos = _zones(spark, d).withColumnRenamed("name", "path")
    return filters.objects(_tracklets(spark, d), _identities(spark, d), videos, label="dog", min_score=0.5).select("id", "path", "name", r6(F.col("max_score")).alias("max_score"))


@query(_INDEX + "SELECT id, name, coalesce(a.n, 0) AS n_examples, coalesce(b.n, 0) AS n_sightings FROM idn LEFT JOIN (SELECT identity_id, count(*) AS n FROM tr WHERE label = 'person' GROUP BY 1) a ON a.identity_id = id LEFT JOIN (SELECT identity_id, count(*) AS n FROM tr GROUP BY 1) b ON b.identity_id = id")
def people_rollup(spark, d):
    t = _tracklets(spark, d)
    return identity.people(_identities(spark, d), t.where("label = 'person'"), t)


@query(_INDEX + "SELECT id FROM idn WHERE id NOT IN (SELECT identity_id FROM tr WHERE identity_id % 3 = 0)")
def orphan_identities(spark, d):
    t = _tracklets(spark, d).where("identity_id % 3 = 0")
    return identity.orphans(_identities(spark, d), t.limit(0), t).select("id")


@query(_INDEX + """, g AS (SELECT segment_id, label, name, count(*) AS n FROM tr LEFT JOIN idn ON idn.id = identity_id GROUP BY ALL), p AS (
  SELECT seg.id AS s, 0 AS o, name AS w FROM seg JOIN cam ON cam.id = camera_id UNION ALL SELECT segment_id, 1, rtrim(repeat(label || ' ', least(n, 3)::INT)) FROM g
  UNION ALL SELECT segment_id, 2, name FROM g WHERE name IS NOT NULL UNION ALL SELECT segment_id, 3, caption FROM tr WHERE caption IS NOT NULL
  UNION ALL SELECT * FROM (SELECT DISTINCT segment_id, 5, name || ' ' || replace(kind, '_', ' ') FROM ev JOIN zn ON zn.id = zone_id))
SELECT s AS segment_id, string_agg(w, ' ' ORDER BY o, w) AS body FROM p GROUP BY s""")
def segment_documents(spark, d):
    speech = spark.createDataFrame([], "segment_id long, text string")
    return search.segment_documents(_segments(spark, d), _tracklets(spark, d), _identities(spark, d), speech, _events(spark, d), _zones(spark, d), _named(spark, d, "region", "r_regionkey", "r_name"))


@query(_INDEX + "SELECT id FROM tr WHERE caption IS NULL AND label = 'person'")
def captions_pending(spark, d):
    return filters.pending_captions(_tracklets(spark, d)).select("id")


@query(_INDEX + "SELECT segment_id, caption FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY length(caption) DESC, id, caption DESC) AS k FROM tr WHERE caption IS NOT NULL) WHERE k = 1")
def best_captions(spark, d):
    return filters.best_caption(_tracklets(spark, d))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def speech_pending(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1.0).alias("transcribed_at"))
    heard = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("video_id"))
    return filters.pending_speech(o, heard).select("id")


@query("""
WITH f AS (SELECT p_partkey AS k, '/v/' || p_partkey AS path, p_brand || p_type AS fp, p_size::BIGINT AS size, p_retailprice AS mtime FROM part),
known AS (SELECT path, fp, size + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS size, mtime FROM f WHERE k % 2 = 0),
j AS (SELECT f.*, coalesce(f.size = known.size, false) AS same, (SELECT min(o.path) FROM known o WHERE o.fp = f.fp AND o.path <> f.path) AS old, first_value(f.path) OVER (PARTITION BY f.fp ORDER BY f.path) AS head FROM f LEFT JOIN known ON known.path = f.path)
SELECT path, CASE WHEN same THEN 'unchanged' WHEN coalesce(old, nullif(head, path)) IS NOT NULL THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN NOT same THEN coalesce(old, nullif(head, path)) END AS duplicate_of FROM j
""")
def ingest_statuses(spark, d):
    """Every part as a file; every second one is known, half of those with another size."""
    p = table(spark, d, "part")
    f = p.select("p_partkey", F.concat(F.lit("/v/"), F.col("p_partkey").cast("string")).alias("path"), F.concat("p_brand", "p_type").alias("fingerprint"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("mtime"))
    other = (F.col("p_partkey") % 4 == 0).cast("long")
    known = f.where("p_partkey % 2 = 0").select("path", "fingerprint", (F.col("size") + other).alias("size_bytes"), "mtime", F.lit(1.0).alias("ingested_at"))
    return ingest.statuses(f.drop("p_partkey"), known).select("path", "status", "duplicate_of")


_SEARCH = f"""
WITH tv AS (SELECT vec_id AS segment_id, 0 AS source, NULL::BIGINT AS tracklet_id, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL SELECT vec_id % 97, 1, vec_id + 1000000, embedding::DOUBLE[] FROM embeddings),
good AS (SELECT doc_id FROM labels WHERE quality = 1),
seg AS (SELECT doc_id AS id, n_chars % 5 AS camera_id, doc_id * 60.0::DOUBLE AS ts_start FROM documents),
cap AS (SELECT vec_id % 97 AS id, arg_max(c, struct_pack(n := length(c), i := -vec_id)) AS caption FROM (SELECT vec_id, repeat('seen ', label) || vec_id AS c FROM embeddings WHERE label < 6) GROUP BY 1),
sem AS (SELECT segment_id AS id, s AS semantic_score, tracklet_id AS best_tracklet_id, row_number() OVER (ORDER BY s DESC, segment_id) AS rank0 FROM (
  SELECT *, list_cosine_similarity(e, q) AS s FROM tv, ({_Q0}) WHERE segment_id IN (SELECT doc_id FROM good) AND segment_id IN (SELECT id FROM seg)
  QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY s DESC, source, tracklet_id) = 1) QUALIFY rank0 <= 200)"""


def _found(spark, d, **asked):
    segments = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.pmod("n_chars", F.lit(5)).alias("camera_id"), (F.col("doc_id") * F.lit(60.0)).alias("ts_start"))
    e = table(spark, d, "embeddings")
    own = e.select(F.col("vec_id").alias("segment_id"), F.lit(0).alias("source"), F.lit(None).cast("long").alias("tracklet_id"), F.col("embedding").alias("vector"))
    vectors = own.unionByName(e.select(F.pmod("vec_id", F.lit(97)).alias("segment_id"), F.lit(1).alias("source"), (F.col("vec_id") + 1000000).alias("tracklet_id"), F.col("embedding").alias("vector")))
    caption = F.when(F.col("label") < 6, F.concat(F.repeat(F.lit("seen "), F.col("label")), F.col("vec_id").cast("string")))
    tracklets = e.select((F.col("vec_id") + 1000000).alias("id"), F.pmod("vec_id", F.lit(97)).alias("segment_id"), caption.alias("caption"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    out = search.search(segments, document_index(spark, d), vectors, tracklets, allowed=good, **asked)
    return out.select("id", "camera_id", "ts_start", r6(F.col("score")).alias("score"), F.array_join("sources", "+").alias("sources"), r6(F.col("semantic_score")).alias("semantic_score"), "best_tracklet_id", "caption")


@query(bm25_sql().replace("WITH t AS", _SEARCH + ", t AS", 1) + """,
lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank1 FROM ranked WHERE doc_id IN (SELECT doc_id FROM good) QUALIFY rank1 <= 200),
f AS (SELECT id, rank0, rank1, semantic_score, best_tracklet_id, coalesce(1.0::DOUBLE / (60 + rank0), 0) + coalesce(1.0::DOUBLE / (60 + rank1), 0) AS score FROM sem FULL JOIN lex USING (id)
  ORDER BY score DESC, rank0 NULLS LAST, rank1 NULLS LAST, id LIMIT 40)
SELECT id, camera_id, ts_start, round(score, 6) AS score, concat_ws('+', CASE WHEN rank0 IS NOT NULL THEN 'semantic' END, CASE WHEN rank1 IS NOT NULL THEN 'lexical' END) AS sources,
  round(semantic_score, 6) AS semantic_score, best_tracklet_id, caption FROM f JOIN seg USING (id) LEFT JOIN cap USING (id)""")
def search_by_text_and_vector(spark, d):
    return _found(spark, d, text=" ".join(WORDS), query_vector=vector0(spark, d))


@query(_SEARCH + """
SELECT id, camera_id, ts_start, round(1.0::DOUBLE / (60 + rank0), 6) AS score, 'semantic' AS sources, round(semantic_score, 6) AS semantic_score, best_tracklet_id, caption
FROM sem JOIN seg USING (id) LEFT JOIN cap USING (id) WHERE rank0 <= 40""")
def search_by_vector(spark, d):
    return _found(spark, d, query_vector=vector0(spark, d))


@query(_SEARCH + """
SELECT id, camera_id, ts_start, 0.0::DOUBLE AS score, 'filter' AS sources, NULL::DOUBLE AS semantic_score, NULL::BIGINT AS best_tracklet_id, caption
FROM (SELECT * FROM seg WHERE id IN (SELECT doc_id FROM good) ORDER BY ts_start DESC, id DESC LIMIT 40) LEFT JOIN cap USING (id)""")
def search_browse(spark, d):
    return _found(spark, d)


@query("""
WITH f AS (SELECT c_custkey, c_acctbal < 0 AS bad, c_nationkey < 5 AS deaf FROM customer), o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
j AS (SELECT f.*, coalesce(n, 0) AS n FROM f LEFT JOIN o ON o_custkey = c_custkey)
SELECT 'probe' AS stage, count(*) FILTER (NOT bad) AS done, count(*) FILTER (bad) AS failed, 0::BIGINT AS waiting, count(*) FILTER (NOT bad) AS rows, CASE WHEN bool_or(bad) THEN 'no video stream' ELSE '' END AS notes FROM j
UNION ALL SELECT 'scan', count(*) FILTER (NOT bad), 0, count(*) FILTER (bad), coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT, '' FROM j
UNION ALL SELECT 'listen', count(*) FILTER (NOT bad AND NOT deaf), count(*) FILTER (NOT bad AND deaf), count(*) FILTER (bad), count(*) FILTER (NOT bad AND NOT deaf), CASE WHEN bool_or(NOT bad AND deaf) THEN 'ValueError: no audio' ELSE '' END FROM j
UNION ALL SELECT 'index', count(*) FILTER (NOT bad AND NOT deaf), 0, count(*) FILTER (bad OR deaf), count(*) FILTER (NOT bad AND NOT deaf AND n > 0), '' FROM j
""")
def import_stages(spark, d):
    """Customers as files, in four stages of which two fail for some; a second run finds only the failed ones left."""
    files = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")

    def listen(pdf):
        if (pdf["c_nationkey"] < 5).any():
            raise ValueError("no audio")
        return pdf[["c_custkey"]]

    graph = stages.Import(
        f"{shared.shared_dir(spark)}/sightline/import-{uuid.uuid4().hex}", "c_custkey", dict(files.dtypes)["c_custkey"],
        [
            stages.Stage("index", lambda due, t: t["scan"].join(due, "c_custkey", "left_semi").groupBy("c_custkey").agg(F.count("*").alias("n")), ("scan", "listen")),
            stages.Stage("probe", lambda due, _: due.select("c_custkey", F.when(F.col("c_acctbal") < 0, "no video stream").alias("error"))),
            stages.Stage("scan", lambda due, _: due.join(orders, "c_custkey").select("c_custkey", "o_orderkey"), ("probe",)),
            stages.Stage("listen", lambda due, _: stages.attempted(due, "c_custkey", listen, f"c_custkey {dict(files.dtypes)['c_custkey']}"), ("probe",)),
        ],
    )
    graph.run(files)
    graph.run(files)
    return graph.summary(files).withColumn("notes", F.array_join("notes", ";"))


def _spoken(spark, d):
    """Conversations as utterances of recordings: clearness by the turn."""
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), "text", (F.col("turn") * 2.0).alias("t_start"), (F.col("turn") * 2.0 + F.length("text") / 20).alias("t_end"), (F.col("turn") % 4 * -0.4).cast("double").alias("avg_logprob"), F.when(F.col("conv_id") % 3 == 0, 0.9).otherwise(F.col("turn") % 3 * 0.25).alias("no_speech_prob"))


@query("""
WITH raw AS (SELECT conv_id AS id, length(text) / 20.0::DOUBLE AS s, trim(coalesce(text, '')) <> '' AND turn % 4 * -0.4 >= -1.0 AND CASE WHEN conv_id % 3 = 0 THEN 0.9 ELSE turn % 3 * 0.25 END <= 0.6 AS ok FROM conversations),
v AS (SELECT c_custkey AS id, c_nationkey > 4 AS has_audio FROM customer),
j AS (SELECT v.id, any_value(has_audio) AS has_audio, count(raw.id) AS n, count(raw.id) FILTER (ok) AS k, coalesce(sum(s) FILTER (ok), 0) AS s FROM v LEFT JOIN raw USING (id) GROUP BY v.id)
SELECT count(*) FILTER (has_audio AND k > 0) AS videos, coalesce(sum(k) FILTER (has_audio), 0)::BIGINT AS utterances, round(coalesce(sum(s) FILTER (has_audio), 0), 1) AS seconds_of_speech, count(*) FILTER (NOT has_audio) AS skipped_no_audio,
  count(*) FILTER (has_audio AND n = 0) AS skipped_silent, count(*) FILTER (has_audio AND n > 0 AND k = 0) AS skipped_unclear, coalesce(sum(n - k) FILTER (has_audio), 0)::BIGINT AS discarded FROM j
""")
def speech_summary(spark, d):
    raw = _spoken(spark, d)
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") > 4).alias("has_audio"))
    return stages.speech_summary(videos, raw, filters.spoken(raw))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_partkey % 600 * 1.0::DOUBLE AS x1, l_suppkey % 300 * 1.0::DOUBLE AS y1, l_quantity * 1.5::DOUBLE AS w, l_quantity * 1.0::DOUBLE AS h FROM lineitem),
c AS (SELECT *, greatest(0, trunc(x1 - w * 0.08)) AS cx1, greatest(0, trunc(y1 - h * 0.08)) AS cy1, least(640, trunc(x1 + w + w * 0.08)) AS cx2, least(320, trunc(y1 + h + h * 0.08)) AS cy2 FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DOUBLE AS l_quantity, cx1::INT AS x1, cy1::INT AS y1, cx2::INT AS x2, cy2::INT AS y2, least(cx2 - cx1, 48)::INT AS width,
  CASE WHEN cx2 - cx1 > 48 THEN greatest(1, trunc((cy2 - cy1) * (48 / (cx2 - cx1)))) ELSE cy2 - cy1 END::INT AS height FROM c WHERE cx2 - cx1 >= 4 AND cy2 - cy1 >= 4
""")
def crop_boxes(spark, d):
    li, x, y = table(spark, d, "lineitem"), (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") % 300).cast("double")
    w, h = F.col("l_quantity").cast("double") * 1.5, F.col("l_quantity").cast("double")
    crop = geometry.thumb_crop(x, y, x + w, y + h, F.lit(640), F.lit(320), 48)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("l_quantity"), crop.alias("c")).where("c IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "c.*")


def _asked_of_zones(spark, d, question):
    """Every second nation is a region, the others are lines; the first three lines of an order are events."""
    t = _tracklets(spark, d)
    own = table(spark, d, "lineitem").where("l_linenumber <= 3")
    label = F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "N", "dog").otherwise("car")
    n, kind = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.when(F.col("l_linestatus") == "O", "enter").otherwise("cross_out")
    e = own.select(
        n.alias("id"), n.alias("tracklet_id"), F.pmod("l_partkey", F.lit(25)).alias("zone_id"), F.col("l_orderkey").alias("segment_id"), kind.alias("kind"), epoch("l_shipdate").alias("ts"),
        label.alias("label"), F.pmod("l_suppkey", F.lit(5)).alias("camera_id"), F.lit(0.0).alias("duration"),
    )
    zones = _zones(spark, d).withColumn("kind", F.when(F.col("id") % 2 == 0, "region").otherwise("line"))
    people, cameras = _identities(spark, d), _named(spark, d, "region", "r_regionkey", "r_name")
    plan = ask.parse(question, ask.vocabulary(question, people, zones, cameras, t), dt.date(1998, 1, 1))
    return plan, ask.answer_rows(plan, e, zones, t, people, cameras)


_ZONE_ROWS = _INDEX + """, e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 25 AS zone_id, CASE l_linestatus WHEN 'O' THEN 'enter' ELSE 'cross_out' END AS kind, epoch(l_shipdate) AS ts,
  CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'dog' ELSE 'car' END AS label, l_suppkey % 5 AS camera_id FROM lineitem WHERE l_linenumber <= 3),
z AS (SELECT e.id, e.ts, idn.name AS identity, e.label, cam.name AS camera, e.kind, zn.name AS zone FROM e JOIN zn ON zn.id = e.zone_id JOIN tr ON tr.id = e.id
  LEFT JOIN idn ON idn.id = tr.identity_id LEFT JOIN cam ON cam.id = e.camera_id)
"""


@query(_ZONE_ROWS + "SELECT count(*) AS n, count(*) || ' time' || CASE count(*) WHEN 1 THEN '' ELSE 's' END || ' at NATION_6' AS answer FROM z WHERE zone = 'NATION_6' AND kind = 'enter' AND label = 'dog'")
def ask_entries_of_a_region(spark, d):
    """Nation 6 is a region, so that coming in is entering it."""
    return ask.headline(*_asked_of_zones(spark, d, "how many times did a dog come in the nation_6"))


@query(_ZONE_ROWS + "SELECT id, ts, identity, label, camera, kind, zone FROM z WHERE zone = 'NATION_7' AND kind = 'cross_out' AND camera = 'ASIA'")
def ask_crossings_of_a_line(spark, d):
    """Nation 7 is a line, so that leaving is crossing it outwards."""
    plan, rows = _asked_of_zones(spark, d, "when did anything leave Nation_7 in Asia")
    return rows.select("id", "ts", "identity", "label", "camera", "kind", "zone")


@query(_ZONE_ROWS + "SELECT id, ts, identity, label, camera, kind, zone FROM z WHERE zone = 'NATION_8' AND kind IN ('enter', 'cross_in', 'cross_out') AND label = 'person' AND (hour(to_timestamp(ts) AT TIME ZONE 'UTC') >= 22 OR hour(to_timestamp(ts) AT TIME ZONE 'UTC') < 6)")
def ask_visits_at_night(spark, d):
    """A zone without a direction: visits, in a part of the day."""
    plan, rows = _asked_of_zones(spark, d, "what person was at Nation_8 at night")
    return rows.select("id", "ts", "identity", "label", "camera", "kind", "zone")


_PATH = f"SELECT user_id, user_id % 3 AS cam, x, y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS t FROM ({ANCHORS})"


@query(f"""
WITH a AS (SELECT * FROM ({_PATH}) WHERE cam < 2), p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM a WHERE cam = 1 WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, 0.5 - x AS sq, 0.5 - px AS sp, (x - px) * (0 - py) - (y - py) * (0.5 - px) AS sa, (x - px) * (1 - py) - (y - py) * (0.5 - px) AS sb FROM p WHERE px IS NOT NULL),
f AS (SELECT *, {IN} AS ins FROM a), n AS (SELECT *, CASE WHEN ins = lag(ins) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS fresh, max(t) OVER (PARTITION BY user_id) AS fin FROM f),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n),
q AS (SELECT user_id, run, bool_or(ins) AS ins, min(t) AS t, max(fin) AS fin FROM r GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT *, lag(ins, 1, false) OVER (PARTITION BY user_id ORDER BY run) AS was FROM q), m AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY run) AS nxt FROM c WHERE ins <> was),
e AS (SELECT user_id, 1 AS zone_id, CASE WHEN sq > 0 THEN 'cross_in' ELSE 'cross_out' END AS kind, t, 0.0::DOUBLE AS duration FROM s WHERE sp * sq < 0 AND sa * sb < 0
  UNION ALL SELECT user_id, 2 + user_id % 3, CASE WHEN ins THEN 'enter' ELSE 'exit' END, t, 0.0 FROM m UNION ALL SELECT user_id, 2 + user_id % 3, 'dwell', t, coalesce(nxt, fin) - t FROM m WHERE ins)
SELECT user_id AS tracklet_id, zone_id, user_id * 10 AS segment_id, user_id % 3 AS camera_id, 'user' AS label, kind, t, 1000 + t AS ts, duration FROM e
""")
def zone_events_of_boxes(spark, d):
    """Users as tracklets of three cameras; a line on one of them, a region on two, none on the third."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = anchors(spark, d).withColumn("n", F.row_number().over(w).cast("double"))
    # boxes whose lower edges have the anchors in their middle
    boxes = a.select(F.col("user_id").alias("tracklet_id"), F.col("n").alias("t"), F.col("x").alias("x1"), F.lit(0.0).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    tracklets = a.select("user_id").distinct().select(F.col("user_id").alias("id"), (F.col("user_id") * 10).alias("segment_id"), F.lit(1).cast("long").alias("video_id"), F.pmod("user_id", F.lit(3)).alias("camera_id"), F.lit("user").alias("label"))
    square = str(SQUARE)
    drawn = spark.createDataFrame([(1, 1, "line", "line", "[[0.5,0],[0.5,1]]"), (3, 1, "yard", "region", square), (2, 0, "hall", "region", square)], "id long, camera_id long, name string, kind string, points string")
    out = zones.zone_events(boxes, tracklets, drawn, spark.createDataFrame([(1, 1000.0)], "id long, start_ts double"))
    return out.drop("video_id")


@query()
def packet_candidates(spark, d):
    """Lines as packets, suppliers as recordings: every first line is a key frame, prices are sizes."""
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    packets = li.select(F.col("l_suppkey").alias("video_id"), F.row_number().over(w).alias("seq"), F.col("l_extendedprice").alias("size"), (F.col("l_linenumber") == 1).alias("is_key")).withColumn("t", F.col("seq") * 0.25)
    videos = packets.groupBy("video_id").agg((F.max("t") + 1).alias("duration"))
    return triage.candidates(packets, videos).select("video_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(RUNS + """, sc AS (SELECT m.user_id, m.s, m.e, avg(value) AS score, arg_max(t, struct_pack(v := value, n := -t)) AS peak FROM merged m JOIN e x ON x.user_id = m.user_id AND x.t >= m.s AND x.t < m.e GROUP BY ALL),
du AS (SELECT user_id, max(t) + 30 AS d FROM e GROUP BY 1), wd AS (SELECT user_id, greatest(s - 300, 0) AS s, least(e + 300, d) AS e, score, peak FROM sc JOIN du USING (user_id)),
wg AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM wd),
w2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM wg)
SELECT user_id, min(s) AS "start", max(e) AS "end", round(max(score), 6) AS score, arg_max(peak, struct_pack(v := score, n := -s)) AS peak FROM w2 GROUP BY user_id, run""")
def segments_within_recordings(spark, d):
    """All steps from a trace to segments, which end with their recordings."""
    e = events(spark, d)
    ends = e.groupBy("user_id").agg((F.max("t") + 30).alias("duration"))
    out = segments.activity_segments(e, ["user_id"], "t", "value", ["ts", "event_id"], EVENT_RULES, 60.0, ends)
    return out.withColumn("score", r6(F.col("score")))
