"""Boxes, lines and polygons in normalised coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(x2 - x1, zero) * F.greatest(y2 - y1, zero)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes ``(x1, y1, x2, y2)``; 0 where the union is empty."""
    inner = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def to_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def clip(x: Column, most: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(most)))


def anchor(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The middle of a box's lower edge."""
    return (x1 + x2) / 2, y2


def side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed area: on which side of the line from a to b the point is."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crosses(p: tuple[Column, Column], q: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether the segments pq and ab properly intersect; touching and collinear ones don't."""
    return (side(*p, *a, *b) * side(*q, *a, *b) < 0) & (side(*a, *p, *q) * side(*b, *p, *q) < 0)


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule for an array of ``[x, y]``, folded over its edges."""
    following = F.concat(F.slice(polygon, F.lit(2), F.size(polygon) - 1), F.slice(polygon, F.lit(1), F.lit(1)))
    edges = F.zip_with(polygon, following, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))

    def flip(inside: Column, e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"]
        return inside != (((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < at, F.lit(False)))

    return F.aggregate(edges, F.lit(False), flip)


def valid_zone(kind: Column, points: Column) -> Column:
    """A line has two points, a region three or more, all within 0..1."""
    enough = F.when(kind == "line", F.size(points) == 2).when(kind == "region", F.size(points) >= 3).otherwise(False)
    return F.coalesce(enough & F.forall(points, lambda p: (F.size(p) == 2) & p[0].between(0, 1) & p[1].between(0, 1)), F.lit(False))


def letterbox(width: Column, height: Column, size: int, centred: bool = True) -> tuple[Column, Column, Column]:
    """Scale and whole-pixel padding left and above that fit a frame into a square; of an odd rest the smaller half comes first."""
    scale = F.least(size / width, size / height)
    pad = lambda n: F.floor((size - F.bround(n * scale)) / 2).cast("double") if centred else F.lit(0.0)
    return scale, pad(width), pad(height)


def from_letterbox(box: tuple[Column, ...], width: Column, height: Column, size: int, centred: bool = True) -> tuple[Column, ...]:
    """Corners in the square as corners in the frame, clipped to it."""
    scale, left, above = letterbox(width, height, size, centred)
    within = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    return tuple(within((v - (left if i % 2 == 0 else above)) / scale, width if i % 2 == 0 else height) for i, v in enumerate(box))


def caption_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, grow: float = 1.35, least_box: float = 8, least_crop: float = 96) -> Column:
    """Square around a box, grown and clipped to the frame; null for a box or crop that is too small."""
    half = F.greatest(x2 - x1, y2 - y1) * grow / 2
    cx, cy, _, _ = to_center(x1, y1, x2, y2)
    crop = F.struct(
        F.greatest(cx - half, F.lit(0.0)).alias("x1"), F.greatest(cy - half, F.lit(0.0)).alias("y1"), F.least(cx + half, width).alias("x2"), F.least(cy + half, height).alias("y2")
    )
    small = (F.least(x2 - x1, y2 - y1) < least_box) | (F.least(crop["x2"] - crop["x1"], crop["y2"] - crop["y1"]) < least_crop)
    return F.when(~small, crop)


def thumb_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, most_width: int, pad: float = 0.08, least: int = 4) -> Column:
    """Whole-pixel corners of a box padded by a part of its size and clipped to the frame, and the size of the picture
    once it is at most ``most_width`` wide; null for a crop below ``least`` pixels."""
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    whole = lambda c: c.cast("int")  # noqa: E731  towards zero
    crop = F.struct(F.greatest(F.lit(0), whole(x1 - px)).alias("x1"), F.greatest(F.lit(0), whole(y1 - py)).alias("y1"), F.least(width, whole(x2 + px)).alias("x2"), F.least(height, whole(y2 + py)).alias("y2"))
    w, h = crop["x2"] - crop["x1"], crop["y2"] - crop["y1"]
    scaled = F.when(w > most_width, F.greatest(F.lit(1), whole(h * (F.lit(most_width) / w)))).otherwise(h)
    return F.when((w >= least) & (h >= least), F.struct(crop["x1"].alias("x1"), crop["y1"].alias("y1"), crop["x2"].alias("x2"), crop["y2"].alias("y2"), F.least(w, F.lit(most_width)).alias("width"), scaled.alias("height")))
