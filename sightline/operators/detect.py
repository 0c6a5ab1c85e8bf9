"""Raw predictions of a detector to boxes: layout, anchor grid, best class, inverse letterbox, suppression.

A frame's ``raw`` output is an array of arrays of numbers, either a row per anchor or a row per attribute; attributes
are centre, size, for some heads how sure an object is, then a score per class. All steps up to suppression are column
expressions: a frame is one row, exploded to its anchors once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry
from sightline.operators.tracking import nms


@dataclass(frozen=True)
class Head:
    """``objectness``: a column before the classes that multiplies them. ``grid``: centres are offsets from anchor cells
    and sizes logarithms, both in strides; else both are pixels of the square input. ``centred``: where padding went.
    """

    classes: int
    objectness: bool = False
    grid: bool = False
    strides: tuple[int, ...] = (8, 16, 32)
    centred: bool = True

    @property
    def attributes(self) -> int:
        return 4 + self.objectness + self.classes

    def anchors(self, size: int) -> int:
        return sum((size // s) ** 2 for s in self.strides)


def anchor_rows(raw: Column, attributes: int) -> Column:
    """A row per anchor: as it stands if its rows have the known length, turned if it has that many rows; an unknown layout has more anchors than attributes."""
    first = F.coalesce(F.size(F.get(raw, F.lit(0))), F.lit(0))
    turned = F.transform(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), lambda i: F.transform(raw, lambda a: F.get(a, i)))
    stands = (first == attributes) | ((F.size(raw) != attributes) & (F.size(raw) >= first))
    return F.when(first == 0, F.slice(raw, 1, 0)).when(stands, raw).otherwise(turned)


def anchor_cell(i: Column, size: int, strides: tuple[int, ...]) -> tuple[Column, Column, Column]:
    """Column, row and stride of anchor ``i``: the cells of each stride row by row, the first stride first."""
    begin, x, y, step = 0, None, None, None
    for s in strides:
        cells = size // s
        here, at = i < begin + cells * cells, i - begin
        parts = (at % cells, F.floor(at / cells), F.lit(s))
        x, y, step = (F.when(here, v) if c is None else c.when(here, v) for c, v in zip((x, y, step), parts))
        begin += cells * cells
    return x, y, step


def decoded(frames: DataFrame, keys: list[str], head: Head, size: int, least: float = 0.25, classes: list[int] | None = None) -> DataFrame:
    """``keys, anchor, x1, y1, x2, y2, score, cls`` of the anchors whose best class scores ``least`` or more, in pixels of the frame.

    ``frames``: ``keys``, ``width``, ``height`` and ``raw``. Of equal classes the first is best; ``classes`` limits what
    is kept. A frame without predictions has no rows; with ``grid``, a number of anchors that isn't the grid's is an error.
    """
    pre = 4 + head.objectness
    rows = anchor_rows(F.col("raw"), head.attributes)
    each = frames.where("raw IS NOT NULL").select(*keys, "width", "height", rows.alias("_rows"))
    if head.grid:
        want = head.anchors(size)
        wrong = F.raise_error(F.concat(F.lit(f"a grid of {want} anchors, but rows: "), F.size("_rows").cast("string")))
        n = F.coalesce(F.size("_rows"), F.lit(0))
        each = each.withColumn("_rows", F.when((n == want) | (n == 0), F.col("_rows")).otherwise(wrong))
    each = each.select(*keys, "width", "height", F.posexplode("_rows").alias("anchor", "_p"))
    p = lambda k: F.col("_p")[k].cast("double")
    scores = F.transform(F.slice("_p", pre + 1, head.classes), lambda s: s.cast("double") * p(4) if head.objectness else s.cast("double"))
    best = each.withColumn("_s", scores).withColumn("score", F.array_max("_s")).where(F.col("score") >= least)
    best = best.withColumn("cls", (F.array_position("_s", F.col("score")) - 1).cast("int"))
    best = best.where(F.col("cls").isin(classes)) if classes is not None else best
    cx, cy, w, h = p(0), p(1), p(2), p(3)
    if head.grid:
        x, y, stride = anchor_cell(F.col("anchor"), size, head.strides)
        cx, cy, w, h = (cx + x) * stride, (cy + y) * stride, F.exp(w) * stride, F.exp(h) * stride
    corners = geometry.from_letterbox(geometry.from_center(cx, cy, w, h), F.col("width"), F.col("height"), size, head.centred)
    return best.select(*keys, "anchor", *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))], "score", "cls")


def detections(frames: DataFrame, keys: list[str], head: Head, size: int, least: float = 0.25, overlap: float = 0.45, most: int = 300, classes: list[int] | None = None) -> DataFrame:
    """Decoded boxes after suppression within each class; the best ``most`` of a frame stay."""
    kept = nms(decoded(frames, keys, head, size, least, classes), keys, overlap, cap=most)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "anchor")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
