"""Structured filters. ``None`` sets no predicate; every other value, 0 included, does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.times import in_band, overlaps_day, within_day


@dataclass(frozen=True)
class SegmentFilter:
    day: str | None = None
    video_id: int | None = None
    camera_id: int | None = None
    label: str | None = None
    identity: str | None = None
    zone: str | None = None
    event_kind: str | None = None

    @property
    def active(self) -> bool:
        return any(v is not None for v in vars(self).values())


def allowed_segments(segments: DataFrame, tracklets: DataFrame, identities: DataFrame, events: DataFrame, zones: DataFrame, f: SegmentFilter) -> DataFrame:
    """Segments that satisfy every filter; label, identity, zone and kind need not be of one tracklet or event."""
    s = segments
    if f.day is not None:
        s = s.where(overlaps_day(F.col("ts_start"), F.col("ts_end"), f.day))
    for c in ("video_id", "camera_id"):
        if getattr(f, c) is not None:
            s = s.where(F.col(c) == getattr(f, c))
    if f.label is not None:
        s = _having(s, tracklets.where(F.col("label") == f.label))
    if f.identity is not None:
        named = identities.where(F.col("name") == f.identity).select(F.col("id").alias("identity_id"))
        s = _having(s, tracklets.join(named, "identity_id", "left_semi"))
    if f.zone is not None:
        z = zones.where(F.col("name") == f.zone).select(F.col("id").alias("zone_id"))
        s = _having(s, events.join(z, "zone_id", "left_semi"))
    if f.event_kind is not None:
        s = _having(s, events.where(F.col("kind") == f.event_kind))
    return s


def _having(segments: DataFrame, rows: DataFrame) -> DataFrame:
    return segments.join(rows.select(F.col("segment_id").alias("id")), "id", "left_semi")


def objects(tracklets: DataFrame, identities: DataFrame, videos: DataFrame, camera_id: int | None = None, segment_id: int | None = None, day: str | None = None, label: str | None = None, min_score: float = 0.0, limit: int = 200, offset: int = 0) -> DataFrame:
    """Tracklets newest first, with the video's path, the name if any, and whether there is a picture."""
    t = tracklets
    for c, v in (("camera_id", camera_id), ("segment_id", segment_id), ("label", label)):
        t = t.where(F.col(c) == v) if v is not None else t
    t = t.where(overlaps_day(F.col("ts_start"), F.col("ts_end"), day)) if day is not None else t
    t = t.where(F.col("max_score") >= min_score) if min_score > 0 else t
    t = t.join(videos.select(F.col("id").alias("video_id"), "path"), "video_id").join(identities.select(F.col("id").alias("identity_id"), "name"), "identity_id", "left")
    return t.withColumn("has_crop", F.col("thumb_path").isNotNull()).orderBy(F.desc("ts_start"), F.desc("id")).offset(offset).limit(min(limit, 2000))


def event_rows(events: DataFrame, zones: DataFrame, tracklets: DataFrame, identities: DataFrame, identity: str | None = None, zone_id: int | None = None, kind: str | None = None, label: str | None = None, camera_id: int | None = None, day: str | None = None) -> DataFrame:
    """Events with zone, tracklet and name, in time order."""
    e = events
    for c, v in (("zone_id", zone_id), ("kind", kind), ("label", label), ("camera_id", camera_id)):
        e = e.where(F.col(c) == v) if v is not None else e
    e = e.where(within_day(F.col("ts"), day)) if day is not None else e
    t = tracklets.select(F.col("id").alias("tracklet_id"), "identity_id", F.col("thumb_path").isNotNull().alias("has_crop"))
    e = e.join(zones.select(F.col("id").alias("zone_id"), F.col("name").alias("zone")), "zone_id").join(t, "tracklet_id")
    e = e.join(identities.select(F.col("id").alias("identity_id"), F.col("name").alias("identity")), "identity_id", "left")
    return (e.where(F.col("identity") == identity) if identity is not None else e).orderBy("ts", "id")


def in_hours(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    return df.where(in_band(F.col(ts), start, end))


def spoken(raw: DataFrame, least_logprob: float = -1.0, most_silence: float = 0.6) -> DataFrame:
    """Utterances that are words, said clearly enough; an unknown confidence passes."""
    clear = (F.coalesce("avg_logprob", F.lit(0.0)) >= least_logprob) & (F.coalesce("no_speech_prob", F.lit(0.0)) <= most_silence)
    return raw.where((F.trim(F.coalesce("text", F.lit(""))) != "") & clear)


def utterances_of(utterances: DataFrame, video_id: int | None = None, segment_id: int | None = None, limit: int = 200) -> DataFrame:
    """What was said in a recording or segment, in time order, at most ``limit`` rows."""
    for column, wanted in (("video_id", video_id), ("segment_id", segment_id)):
        utterances = utterances.where(F.col(column) == wanted) if wanted is not None else utterances
    return utterances.orderBy("ts_start", "id").limit(limit)


def pending_analysis(segments: DataFrame) -> DataFrame:
    return segments.where("analyzed_at is null")


def pending_captions(tracklets: DataFrame, labels: tuple[str, ...] = ("person",)) -> DataFrame:
    return tracklets.where(F.col("caption").isNull() & F.col("label").isin(*labels)).orderBy(F.desc("ts_start"), F.desc("id"))


def pending_speech(videos: DataFrame, utterances: DataFrame) -> DataFrame:
    heard = utterances.where("video_id is not null").select(F.col("video_id").alias("id"))
    return videos.where("transcribed_at is null").join(heard, "id", "left_anti")


def stale_vectors(vectors: DataFrame, model: str | None) -> DataFrame:
    return vectors.where(~F.col("model").eqNullSafe(F.lit(model)))


def best_caption(tracklets: DataFrame) -> DataFrame:
    """``segment_id, caption``: the longest caption of a segment, the first in order of ids."""
    c = tracklets.where("caption is not null")
    best = F.max(F.struct(F.length("caption").alias("n"), (-F.col("id")).alias("i"), F.col("caption"))).alias("_b")
    return c.groupBy("segment_id").agg(best).select("segment_id", F.col("_b.caption").alias("caption"))


def first_caption(*tries: str) -> Column:
    """The first caption that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in tries])
