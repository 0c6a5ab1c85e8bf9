"""Counts and listings over the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.times import day as day_of
from sightline.functions.times import overlaps_day


def reduction(active: Column, duration: Column) -> Column:
    """Part of the recordings without activity; 0 without recordings."""
    return F.when(duration > 0, 1 - active / duration).otherwise(0.0)


def library_summary(videos: DataFrame, segments: DataFrame, tracklets: DataFrame, identities: DataFrame, zones: DataFrame, cameras: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """One row: recordings, seconds, segments, tracklets, people, names, zones, cameras, vectors and stale ones."""
    one = videos.agg(F.count("*").alias("videos"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("active_seconds"), F.lit(0.0)).alias("active"))
    one = one.withColumn("reduction", reduction(F.col("active"), F.col("seconds")))
    person = F.col("label") == "person"
    parts = [
        segments.agg(F.count("*").alias("segments"), F.count_if(F.col("analyzed_at").isNotNull()).alias("analyzed")),
        tracklets.agg(F.count("*").alias("tracklets"), F.count_if(person).alias("people"), F.count_if(person & F.col("identity_id").isNull()).alias("unnamed"), F.count_if(F.col("caption").isNotNull()).alias("captioned")),
        identities.agg(F.count("*").alias("identities")),
        zones.agg(F.count("*").alias("zones")),
        cameras.agg(F.count("*").alias("cameras")),
        embeddings.agg(F.count("*").alias("embeddings"), F.count_if(~F.col("model").eqNullSafe(F.lit(model))).alias("stale")),
    ]
    for p in parts:
        one = one.join(F.broadcast(p))  # one row each
    return one


def top(df: DataFrame, by: str, n: int = 8, out: str = "n") -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(out)).orderBy(F.desc(out), by).limit(n)


def labels(tracklets: DataFrame, day: str | None = None, camera_id: int | None = None) -> DataFrame:
    t = tracklets.where(overlaps_day(F.col("ts_start"), F.col("ts_end"), day)) if day is not None else tracklets
    t = t.where(F.col("camera_id") == camera_id) if camera_id is not None else t
    return t.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def counted(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``parents`` with, for each name, how many rows of a child table point to them; each child is counted before it is joined."""
    for name, (child, fk) in children.items():
        n = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias(name))
        parents = parents.join(n, parents[key] == n["_fk"], "left").drop("_fk").fillna(0, [name])
    return parents


def rollup(parents: DataFrame, key: str, children: DataFrame, fk: str, total: str) -> DataFrame:
    """``key, n, total`` of every parent, empty ones too."""
    s = children.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias("n"), F.sum(total).alias("total"))
    return parents.select(key).join(s, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def days(df: DataFrame, ts: str, seconds: Column) -> DataFrame:
    """``day, n, seconds`` by local day, newest first."""
    return df.groupBy(day_of(F.col(ts)).alias("day")).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds")).orderBy(F.desc("day"))


def label_counts(tracklets: DataFrame) -> DataFrame:
    """``segment_id, n_tracklets, labels``: a map from label to count."""
    n = tracklets.groupBy("segment_id", "label").agg(F.count("*").cast("int").alias("n"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))))
    return n.groupBy("segment_id").agg(F.sum("n").alias("n_tracklets"), F.map_from_entries(pairs).alias("labels"))


def tracklet_rollup(detections: DataFrame, key: str = "tracklet_id") -> DataFrame:
    """First and last centre, union of boxes, scores and times of each tracklet."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    d = detections.withColumns({"_x": cx, "_y": cy})
    at = lambda f, c: f(F.col(c), F.struct("t", "_x", "_y"))
    return d.groupBy(key).agg(
        F.count("*").alias("n_detections"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        at(F.min_by, "_x").alias("x_start"), at(F.min_by, "_y").alias("y_start"), at(F.max_by, "_x").alias("x_end"), at(F.max_by, "_y").alias("y_end"),
    )


def best_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each task's share before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def best_crops(detections: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` boxes of each tracklet with the highest scores, the earlier of equal ones."""
    return best_rows(detections, ["tracklet_id"], [F.desc("score"), F.asc("t")], n)


def events_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def orientation(votes: DataFrame, margin: float = 1.35) -> DataFrame:
    """``video_id, rotation`` from ``video_id, degrees, conf``: the strongest turn, if it beats upright by the margin; else 0."""
    s = votes.groupBy("video_id", "degrees").agg(F.sum("conf").alias("s"))
    b = s.groupBy("video_id").agg(F.max(F.struct(F.col("s"), (-F.col("degrees")).alias("d"))).alias("_b"), F.coalesce(F.max(F.when(F.col("degrees") == 0, F.col("s"))), F.lit(0.0)).alias("_up"))
    turned = (F.col("_b.s") > 0) & (F.col("_b.s") >= margin * F.col("_up"))
    return b.select("video_id", F.when(turned, -F.col("_b.d")).otherwise(0).alias("rotation"))


def best_face(faces: DataFrame, least: float = 24.0) -> DataFrame:
    """Each crop's largest face whose sides reach ``least``."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return best_rows(faces.where(F.least(w, h) >= least), ["crop_id"], [F.desc(w * h), F.asc("face_id")])


def pending_totals(segments: DataFrame) -> DataFrame:
    return segments.where("analyzed_at is null").agg(F.countDistinct("video_id").alias("videos"), F.coalesce(F.sum(F.col("t_end") - F.col("t_start")), F.lit(0.0)).alias("seconds"))


def people_board(tracklets: DataFrame, limit: int = 200) -> DataFrame:
    """Persons with a picture, unnamed ones first, then by time."""
    t = tracklets.where((F.col("label") == "person") & F.col("thumb_path").isNotNull()).orderBy("ts_start", "id").limit(limit)
    return t.orderBy(F.col("identity_id").isNotNull(), "ts_start", "id")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 2000) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, most))
