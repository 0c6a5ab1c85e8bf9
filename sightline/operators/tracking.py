"""Boxes per frame to tracks: suppression, a constant-velocity filter, and two-stage association.

What a frame does to the tracks depends on the frames before it, so a segment is worked through in order, as a
stream of sorted rows with a bounded state; segments are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sightline.config import Tracker


def iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.prod(np.clip(hi - lo, 0, None), axis=2)
    size = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    union = size(a)[:, None] + size(b)[None, :] - inner
    return np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)


def suppress(boxes: np.ndarray, scores: np.ndarray, most: float) -> np.ndarray:
    """Greedy: boxes by falling score (of equal ones the first), each dropping later ones that overlap it by more than ``most``."""
    order, kept = np.lexsort((np.arange(len(scores)), -scores)), []
    table = iou_table(boxes, boxes)
    alive = np.ones(len(scores), bool)
    for i in order:
        if alive[i]:
            kept.append(i)
            alive &= table[i] <= most
    return np.array(kept, np.int64)


def nms(detections: DataFrame, keys: list[str], most: float = 0.45, cap: int = 300) -> DataFrame:
    """Suppression per key and class; at most ``cap`` boxes of a key's class stay, the best ones.

    Frames are many and small, so a task works through its sorted frames batch by batch, holding back the
    last frame of a batch until it is whole.
    """
    groups, rest = [*keys, "cls"], [c for c in detections.columns if c not in (*keys, "cls")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            mark = (pdf[groups] != pdf[groups].shift()).any(axis=1).to_numpy().nonzero()[0]
            held = pdf.iloc[mark[-1] :]
            yield keep(pdf.iloc[: mark[-1]], mark)
        if held is not None:
            yield keep(held, np.zeros(1, np.int64))

    def keep(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        boxes, scores, rows = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["score"].to_numpy(float), []
        for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
            if a < b:
                rows.append(a + suppress(boxes[a:b], scores[a:b], most)[:cap])
        return pdf.iloc[np.concatenate(rows)] if rows else pdf.iloc[:0]

    return detections.repartition(*groups).sortWithinPartitions(*groups, *rest).mapInPandas(run, detections.schema)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest assignment, by shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            now = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            step = c[now - 1, free - 1] - u[now] - v[free]
            better = step < least[free]
            least[free[better]], way[free[better]] = step[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    rows, cols = match[1:][match[1:] > 0] - 1, np.flatnonzero(match[1:] > 0)
    return (cols, rows) if turned else (rows, cols)


#: Noise of positions and speeds, in heights of the box (fixed values).
_POSITION, _SPEED = 1 / 20, 1 / 160


def _measures(boxes: np.ndarray) -> np.ndarray:
    """Centre, shape and height of each box."""
    w, h = np.maximum(boxes[:, 2] - boxes[:, 0], 1e-6), np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.column_stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, w / h, h])


def _diagonals(values: np.ndarray) -> np.ndarray:
    return values[:, :, None] * np.eye(values.shape[1])


class Follower:
    """The tracks of one segment, frame by frame: a constant-velocity filter for each, over arrays of all live tracks.

    A state is centre, shape and height of a box and their speeds per frame; noise grows with the height. Only live
    tracks are kept, and of one that hasn't been seen ``least_hits`` times its rows. Within a class, certain boxes
    look for a track first; the tracks left look among the doubtful ones, which never start one. A certain box without
    a track takes the next number, even if its track is never reported.
    """

    def __init__(self, p: Tracker = Tracker()) -> None:
        self.p, self.started = p, 0
        self.x, self.cov = np.zeros((0, 8)), np.zeros((0, 8, 8))
        self.cls, self.number, self.hits, self.missed = (np.zeros(0, np.int64) for _ in range(4))
        self.pending: list[list[int]] = []

    def frame(self, classes: np.ndarray, rows: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """(row, track) that are certain from now on: rows of this frame, and earlier ones of tracks that come to be reported."""
        p = self.p
        if len(self.x):
            self._predict()
        sure, unsure = scores >= p.high, (scores >= p.low) & (scores < p.high)
        met: list[tuple[int, int]] = []
        new: list[int] = []
        for c in np.unique(classes).tolist():
            own, of = np.flatnonzero(self.cls == c), classes == c
            first = np.flatnonzero(of & sure)
            hit = self._pair(own, first, boxes, p.iou_high)
            taken = {t for t, _ in hit}
            rest = np.array([t for t in own.tolist() if t not in taken], np.int64)
            met += hit + self._pair(rest, np.flatnonzero(of & unsure), boxes, p.iou_low)
            used = {d for _, d in hit}
            new += [d for d in first.tolist() if d not in used]
        out: list[tuple[int, int]] = []
        if met:
            tracks, seen = np.array([t for t, _ in met]), np.array([d for _, d in met])
            self._update(tracks, _measures(boxes[seen]))
            self.hits[tracks] += 1
            self.missed[tracks] = 0
            for t, d in met:
                self.pending[t].append(int(rows[d]))
                if self.hits[t] >= p.least_hits:
                    out += [(row, int(self.number[t])) for row in self.pending[t]]
                    self.pending[t] = []
        if len(self.x) and self.missed.max() > p.most_missed:
            self._keep(self.missed <= p.most_missed)
        if new:
            out += self._start(np.array(new), classes, rows, boxes)
        return out

    def _pair(self, tracks: np.ndarray, found: np.ndarray, boxes: np.ndarray, least: float) -> list[tuple[int, int]]:
        if not len(tracks) or not len(found):
            return []
        cx, cy, a, h = self.x[tracks, :4].T
        table = iou_table(np.column_stack([cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2]), boxes[found])
        if table.max() < least:
            return []
        return [(int(tracks[i]), int(found[j])) for i, j in zip(*assign(1 - table)) if table[i, j] >= least]

    def _predict(self) -> None:
        h = self.x[:, 3].copy()
        same, flat = np.full(len(h), 1e-2), np.full(len(h), 1e-5)
        noise = np.column_stack([_POSITION * h, _POSITION * h, same, _POSITION * h, _SPEED * h, _SPEED * h, flat, _SPEED * h])
        self.x[:, :4] += self.x[:, 4:]
        self.cov[:, :4] += self.cov[:, 4:]
        self.cov[:, :, :4] += self.cov[:, :, 4:]
        self.cov[:, range(8), range(8)] += noise**2
        self.missed += 1

    def _update(self, tracks: np.ndarray, z: np.ndarray) -> None:
        x, cov = self.x[tracks], self.cov[tracks]
        h = x[:, 3]
        noise = np.column_stack([_POSITION * h, _POSITION * h, np.full(len(h), 1e-1), _POSITION * h])
        s = cov[:, :4, :4] + _diagonals(noise**2)
        gain = np.linalg.solve(s, cov[:, :4]).transpose(0, 2, 1)
        self.x[tracks] = x + (gain @ (z - x[:, :4])[:, :, None])[:, :, 0]
        self.cov[tracks] = cov - gain @ s @ gain.transpose(0, 2, 1)

    def _keep(self, mask: np.ndarray) -> None:
        self.x, self.cov, self.cls, self.number, self.hits, self.missed = (v[mask] for v in (self.x, self.cov, self.cls, self.number, self.hits, self.missed))
        self.pending = [x for x, kept in zip(self.pending, mask.tolist()) if kept]

    def _start(self, new: np.ndarray, classes: np.ndarray, rows: np.ndarray, boxes: np.ndarray) -> list[tuple[int, int]]:
        z, n = _measures(boxes[new]), len(new)
        h = z[:, 3]
        near, fast = 2 * _POSITION * h, 10 * _SPEED * h
        spread = np.column_stack([near, near, np.full(n, 1e-2), near, fast, fast, np.full(n, 1e-5), fast])
        numbers = self.started + 1 + np.arange(n)
        self.started += n
        self.x = np.concatenate([self.x, np.column_stack([z, np.zeros((n, 4))])])
        self.cov = np.concatenate([self.cov, _diagonals(spread**2)])
        self.cls, self.number = np.concatenate([self.cls, classes[new]]), np.concatenate([self.number, numbers])
        self.hits, self.missed = np.concatenate([self.hits, np.ones(n, np.int64)]), np.concatenate([self.missed, np.zeros(n, np.int64)])
        at_once = self.p.least_hits <= 1
        self.pending += [[] if at_once else [row] for row in rows[new].tolist()]
        return list(zip(rows[new].tolist(), numbers.tolist())) if at_once else []


def follow(frames: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p: Tracker = Tracker()) -> list[list[int]]:
    """Rows of each reported track of one class, from frames of ``(rows, boxes, scores)``."""
    follower, found = Follower(p), {}
    for rows, boxes, scores in frames:
        for row, number in follower.frame(np.zeros(len(rows), np.int64), rows, boxes, scores):
            found.setdefault(number, []).append(row)
    return [found[n] for n in sorted(found)]


def tracks(detections: DataFrame, keys: list[str], t: str = "t", p: Tracker = Tracker(), frames: DataFrame | None = None) -> DataFrame:
    """Boxes that belong to a track, with ``track_id``: from 1 within ``keys`` as tracks start, in order of time and class.

    ``frames`` (``keys`` and ``t``) names all sampled instants, so that tracks also age while nothing is seen;
    without it, only instants that have a box count. Instants without boxes give no rows. A track that is never
    reported takes its number with it. When ``keys`` change, all tracks end.

    A segment is followed in order, as a stream: a task holds one batch, the live tracks and their pending rows, whatever
    the segment's length. ``keys`` should name the window of a recording, so that a long one is many segments.
    """
    box = ["x1", "y1", "x2", "y2", "score"]
    rest = [c for c in detections.columns if c not in (*keys, t, *box)]
    all_rows = detections.withColumn("_box", F.lit(True))
    if frames is not None:
        all_rows = all_rows.unionByName(frames.select(*keys, t).withColumn("_box", F.lit(False)), allowMissingColumns=True)
    order = [*keys, t, F.desc("score"), "x1", "y1", "x2", "y2", *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, held, of = Follower(p), None, None

        def work(table: pa.Table, starts: list[int], ends: int) -> list[tuple[int, int]]:
            nonlocal follower, of
            seen = table["_box"].to_numpy()
            boxes = np.column_stack([table[c].to_numpy() for c in box[:4]]).astype(float)
            scores, classes = table["score"].to_numpy(), table["cls"].to_numpy()
            named = list(zip(*[table[k].to_pylist() for k in keys]))
            out: list[tuple[int, int]] = []
            for a, b in zip(starts, [*starts[1:], ends]):
                if named[a] != of:
                    follower, of = Follower(p), named[a]
                rows = a + np.flatnonzero(seen[a:b])
                out += follower.frame(classes[rows].astype(np.int64), rows, boxes[rows], scores[rows])
            return out

        def emit(table: pa.Table, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                rows, numbers = zip(*found)
                taken = table.take(pa.array(rows, pa.int64())).drop_columns(["_box"]).append_column("track_id", pa.array(numbers, pa.int64()))
                yield from taken.combine_chunks().to_batches()

        def bounds(table: pa.Table, first: int) -> list[int]:
            """Where frames begin among the rows from ``first`` on."""
            change = np.zeros(table.num_rows, bool)
            change[first : first + 1] = True
            for k in (*keys, t):
                codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            return [i for i in np.flatnonzero(change).tolist() if i >= first]

        carried = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = bounds(table, carried)
            # the last frame may go on in the next batch
            found = work(table, starts[:-1], starts[-1])
            yield from emit(table, found)
            # of what has been worked through, only the pending rows of live tracks are needed again
            pending = [row for own in follower.pending for row in own]
            keep = pa.array([*pending, *range(starts[-1], table.num_rows)], pa.int64())
            held, carried, n = table.take(keep).combine_chunks(), len(pending), 0
            for k, own in enumerate(follower.pending):
                follower.pending[k] = list(range(n, n := n + len(own)))
        if held is not None:
            yield from emit(held, work(held, [carried], held.num_rows))

    schema = StructType([*detections.schema.fields, StructField("track_id", LongType())])
    return all_rows.repartition(*keys).sortWithinPartitions(*order).select(*detections.columns, "_box").mapInArrow(run, schema)


def inferred(rows: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through an injected model: ``model()`` is called once a task, its result on each batch."""

    def run(batches):
        apply = model()
        for pdf in batches:
            yield apply(pdf)

    return rows.mapInPandas(run, schema)
