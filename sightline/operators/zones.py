"""Zone events from the path of a tracklet's anchor: line crossings, and entering, leaving and dwelling in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g

POINTS = "array<array<double>>"


def parsed_zones(zones: DataFrame) -> DataFrame:
    """Zones with ``points`` as arrays; those that aren't valid go."""
    z = zones.withColumn("points", F.from_json("points", POINTS)) if dict(zones.dtypes)["points"] == "string" else zones
    return z.where(g.valid_zone(F.col("kind"), F.col("points")))


def line_crossings(path: DataFrame, keys: list[str], order: list[str], x: str, y: str, line: tuple) -> DataFrame:
    """Rows of ``path`` at which the step from the row before properly crosses the line, with ``kind``.

    ``line`` is ``(ax, ay, bx, by)``, columns or numbers.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    a, b = (F.lit(line[0]), F.lit(line[1])), (F.lit(line[2]), F.lit(line[3])) if not hasattr(line[2], "alias") else (line[2], line[3])
    a = (line[0], line[1]) if hasattr(line[0], "alias") else a
    d = path.withColumns({"_px": F.lag(x).over(w), "_py": F.lag(y).over(w)})
    p, q = (F.col("_px"), F.col("_py")), (F.col(x), F.col(y))
    kind = F.when(g.side(*q, *a, *b) > 0, "cross_in").otherwise("cross_out")
    return d.where(F.col("_px").isNotNull() & g.crosses(p, q, a, b)).withColumn("kind", kind).drop("_px", "_py")


def region_events(path: DataFrame, keys: list[str], order: list[str], t: str, inside: str, hysteresis: int = 2) -> DataFrame:
    """``keys, kind, t, duration``: ``enter``, ``exit`` and ``dwell`` from a flag per sample.

    A change is believed once ``hysteresis`` samples in a row agree, and dated from the first of them. A
    dwell lasts from entering to leaving, or to the last sample.
    """
    h = max(1, hysteresis)
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = path.select(*keys, *dict.fromkeys([t, *order]), F.col(inside).alias("_in"))
    d = d.withColumn("_new", F.coalesce((F.col("_in") != F.lag("_in").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(upto)).withColumn("_end", F.max(t).over(Window.partitionBy(*keys)))
    runs = d.groupBy(*keys, "_run").agg(F.first("_in").alias("_in"), F.min(t).alias("t"), F.count("*").alias("_n"), F.first("_end").alias("_end"))
    r = Window.partitionBy(*keys).orderBy("_run")
    runs = runs.where(F.col("_n") >= h).withColumn("_was", F.lag("_in", 1, False).over(r)).where("_in <> _was")
    runs = runs.withColumn("_next", F.lead("t").over(r))
    moves = runs.select(*keys, F.when(F.col("_in"), "enter").otherwise("exit").alias("kind"), "t", F.lit(0.0).alias("duration"))
    dwell = runs.where("_in").select(*keys, F.lit("dwell").alias("kind"), "t", (F.coalesce("_next", "_end") - F.col("t")).alias("duration"))
    return moves.union(dwell)


def zone_events(detections: DataFrame, tracklets: DataFrame, zones: DataFrame, videos: DataFrame, hysteresis: int = 2) -> DataFrame:
    """All events of the zones' cameras, rebuilt from stored boxes.

    ``tracklet_id, zone_id, segment_id, video_id, camera_id, label, kind, t, ts, duration``. Zones meet the
    tracklets of their camera; a tracklet without boxes has no events.
    """
    z = parsed_zones(zones).select(F.col("id").alias("zone_id"), "camera_id", F.col("kind").alias("zone_kind"), "points")
    tr = tracklets.select(F.col("id").alias("tracklet_id"), "segment_id", "video_id", "camera_id", "label")
    ax, ay = g.anchor(F.col("x1"), F.col("x2"), F.col("y2"))
    at = detections.select("tracklet_id", "t", ax.alias("x"), ay.alias("y")).join(tr.select("tracklet_id", "camera_id"), "tracklet_id")
    met = at.join(z, "camera_id")
    keys = ["tracklet_id", "zone_id"]
    lines = met.where("zone_kind = 'line'")
    corner = lambda i, j: F.get(F.get("points", F.lit(i)), F.lit(j))
    crossed = line_crossings(lines, keys, ["t"], "x", "y", (corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).select(*keys, "kind", "t", F.lit(0.0).alias("duration"))
    flags = met.where("zone_kind = 'region'").withColumn("inside", g.in_polygon(F.col("x"), F.col("y"), F.col("points")))
    events = crossed.unionByName(region_events(flags, keys, ["t"], "t", "inside", hysteresis))
    start = videos.select(F.col("id").alias("video_id"), "start_ts")
    full = events.join(tr, "tracklet_id").join(start, "video_id")
    return full.select("tracklet_id", "zone_id", "segment_id", "video_id", "camera_id", "label", "kind", "t", (F.col("start_ts") + F.col("t")).alias("ts"), "duration")


def zone_problems(zones: DataFrame) -> DataFrame:
    """Zones that aren't valid, or share camera and name with another: ``id, problem``."""
    twice = F.count("*").over(Window.partitionBy("camera_id", "name")) > 1
    pts = F.from_json("points", POINTS) if dict(zones.dtypes)["points"] == "string" else F.col("points")
    z = zones.withColumn("_ok", g.valid_zone(F.col("kind"), pts)).withColumn("_twice", twice)
    return z.select("id", F.when(~F.col("_ok"), "invalid").when(F.col("_twice"), "name taken").alias("problem")).where("problem is not null")
