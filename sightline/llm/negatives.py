"""Hard negatives by a two-dimensional block matrix multiply of integer vectors.

Rows, sorted by label, and anchors are cut to blocks, and each block to chunks of dimensions. A tile of scores is
the product of an anchor block and a row block: the two blocks meet in Spark once per chunk, each task multiplies one
chunk into a partial tile of int64 scores, and the partial tiles are shuffled to the tile's place and added there.
Every tile is reduced at once to the first rows of each anchor; tiles of one stripe are reduced in turn, so that a
task holds one tile and the best rows so far.

Positives need only tiles whose blocks share a label, negatives only those that differ in one, so that nearly every
tile is made once. The positives' scores are the windows that the second pass reduces by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Scores are below this, so that a hundred of one fit a long.
MOST_SCORE = 1 << 56
#: Stands for a score that doesn't count.
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Params:
    """``scale``: components become floor(scale * x). The first ``positives`` and ``negatives`` are returned; negatives
    score from ``low`` to ``high`` hundredths of the positive's score. ``anchors`` and ``rows``: rows of the two kinds
    of block; ``width``: components of a chunk; ``stripe``: row blocks that are reduced together.
    """

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    anchors: int = 128
    rows: int = 2048
    width: int = 32
    stripe: int = 8


def integer_rows(vectors: DataFrame, anchor: Column, p: Params) -> DataFrame:
    """``uid, id, label, anchor, v``: the rows that take part, with whole components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    taking = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x"), sound.alias("sound"))
    whole = F.transform("x", lambda c: F.floor(c * p.scale).cast("long"))
    return taking.where("label IS NOT NULL AND x IS NOT NULL AND sound").select(F.monotonically_increasing_id().alias("uid"), "id", "label", "anchor", whole.alias("v"))


BLOCKS_SQL = "block long, chunk int, height int, kind string, matrix binary, uids binary, labels binary, ids binary, members array<long>, least long, most long"
BLOCKS = pa.schema(
    [("block", pa.int64()), ("chunk", pa.int32()), ("height", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary()), ("uids", pa.binary()), ("labels", pa.binary())]
    + [("ids", pa.binary()), ("members", pa.list_(pa.int64())), ("least", pa.int64()), ("most", pa.int64())]
)


def blocks_of(rows: DataFrame, size: int, width: int) -> DataFrame:
    """One row per block and chunk: a matrix of ``size`` rows at most. Blocks are numbered from 0.

    Rows are dealt by ranges of label and id, so that a block has one label, or labels with few rows, and a label with
    very many rows has many blocks. Partitions number their blocks themselves; their counts shift the numbers.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // (size * 4)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
            order = np.array(sorted(range(table.num_rows), key=(ids := [(x is None, x or 0) for x in table["id"].to_pylist()]).__getitem__))
            table = table.take(pa.array(order))
            ids = table["id"].combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            uids, labels = (table[c].to_numpy() for c in ("uid", "label"))
            v = table["v"].combine_chunks()
            lengths = v.value_lengths().to_numpy()
            filled = np.zeros((len(uids), max(1, int(lengths.max()))), np.int64)
            filled[np.arange(filled.shape[1]) < lengths[:, None]] = v.flatten().to_numpy()
            for c in range(-(-filled.shape[1] // width)):
                m = filled[:, c * width : (c + 1) * width]
                kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max)
                m = m.astype(kind)
                meta = [uids.tobytes(), labels.tobytes(), np.stack([ids.fill_null(0).to_numpy(), known]).tobytes(), uids.tolist()] if c == 0 else [None] * 4
                values = [part << 32 | n, c, len(uids), kind, m.tobytes(), *meta, int(labels.min()), int(labels.max())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, BLOCKS.types)], schema=BLOCKS)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                table = pa.Table.from_batches(held)
                yield from block(table.slice(0, size))
                n, held, count = n + 1, table.slice(size).to_batches(), count - size
        if count:
            yield from block(pa.Table.from_batches(held))

    order = ("label", "id", "uid")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(ordered.select("uid", "id", "label", "v").mapInArrow(cut, BLOCKS_SQL), "blocks")
    # one row per partition of a number of partitions that this function sets
    counts = stored.where("chunk = 0").groupBy(F.shiftright("block", 32).alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = stored.withColumn("part", F.shiftright("block", 32)).join(F.broadcast(before), "part")
    return numbered.withColumn("block", F.col("before") + F.col("block").bitwiseAND((1 << 32) - 1)).drop("part", "before")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 scores; through doubles where every sum is a whole number that they hold."""
    most = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most >= MOST_SCORE:
        raise ValueError("components are too large for scores of 64 bits")
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial tile for each pair of chunks."""
    for batch in batches:
        for x in batch.to_pylist():
            a = np.frombuffer(x["a_matrix"], x["a_kind"]).reshape(x["a_height"], -1)
            b = np.frombuffer(x["b_matrix"], x["b_kind"]).reshape(x["b_height"], -1)
            k = min(a.shape[1], b.shape[1])
            values = {"a": x["a"], "b": x["b"], "chunk": x["chunk"], "tile": _product(a[:, :k], b[:, :k]).tobytes()}
            values |= {c: x[c] for c in ("a_uids", "a_labels", "windows", "b_uids", "b_labels", "b_ids")}
            yield pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in PARTIAL], schema=PARTIAL)


PARTIAL = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int32()), ("tile", pa.binary()), ("a_uids", pa.binary()), ("a_labels", pa.binary()), ("windows", pa.list_(pa.struct([("uid", pa.int64()), ("place", pa.int32()), ("score", pa.int64())])))]
    + [(c, pa.binary()) for c in ("b_uids", "b_labels", "b_ids")]
)
PARTIAL_SQL = "a long, b long, chunk int, tile binary, a_uids binary, a_labels binary, windows array<struct<uid long, place int, score long>>, b_uids binary, b_labels binary, b_ids binary"
FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor long, place int, id long, uid long, score long"


class Best:
    """The first ``k`` rows so far of each anchor (and place) of one block, by falling score, then id, nulls last, then uid."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score = k, np.full((n, k), _NONE)
        self.id, self.null, self.uid = np.zeros((n, k), np.int64), np.ones((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, uids: np.ndarray) -> None:
        """``scores``: a row per anchor, a column per row of the block, columns by id; changed."""
        n, at = np.arange(len(scores)), []
        for _ in range(min(self.k, scores.shape[1])):
            best = scores.argmax(axis=1)
            at.append((best, scores[n, best].copy()))
            scores[n, best] = _NONE
        cols, new = np.stack([b for b, _ in at], 1), np.stack([s for _, s in at], 1)
        parts = [np.concatenate(x, axis=1) for x in ((self.score, new), (self.null, null[cols]), (self.id, ids[cols]), (self.uid, uids[cols]))]
        order = np.lexsort([parts[3], parts[2], parts[1], ~parts[0]], axis=1)[:, : self.k]
        self.score, self.null, self.id, self.uid = (np.take_along_axis(x, order, 1) for x in parts)

    def rows(self, anchors: np.ndarray, place: int) -> pa.RecordBatch:
        have = self.score != _NONE
        ids = pa.array(self.id[have], mask=self.null[have] != 0)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(anchors, have.sum(axis=1))), pa.array(np.full(have.sum(), place, np.int32)), ids, pa.array(self.uid[have]), pa.array(self.score[have])], schema=FOUND)


def _reduce(keep: Callable[[dict, np.ndarray], Iterator[tuple[int, np.ndarray]]], k: int, stripe: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the partial tiles of each place and keep each anchor's first ``k`` rows among the scores that ``keep`` leaves, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for _, striped in groupby(rows, key=lambda x: (x["a"], x["b"] // stripe)):
            best: dict[int, Best] = {}
            uids = np.empty(0, np.int64)
            for _, partial in groupby(striped, key=lambda x: x["b"]):
                head, total = None, None
                for x in partial:
                    tile = np.frombuffer(x["tile"], np.int64)
                    total = tile.copy() if total is None else np.add(total, tile, out=total)
                    head = x if x["chunk"] == 0 else head
                uids = np.frombuffer(head["a_uids"], np.int64)
                columns, (ids, known) = np.frombuffer(head["b_uids"], np.int64), np.frombuffer(head["b_ids"], np.int64).reshape(2, -1)
                for place, scores in keep(head, total.reshape(len(uids), -1)):
                    best.setdefault(place, Best(len(uids), k)).add(scores, ids, 1 - known, columns)
            for place, b in best.items():
                yield b.rows(uids, place)

    return run


def _labels(head: dict) -> np.ndarray:
    return np.frombuffer(head["a_labels"], np.int64)[:, None] == np.frombuffer(head["b_labels"], np.int64)


def _tiles(pairs: DataFrame, a: DataFrame, b: DataFrame, p: Params, keep: Callable, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor and place over the tiles ``pairs (a, b)``."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # an anchor block meets very many row blocks: it is sent to several tasks, each with a share of them
    spread = max(1, -(-parts // max(1, a.where("chunk = 0").count())))
    left = a.select(F.col("block").alias("a"), "chunk", *[F.col(c).alias(f"a_{c}") for c in ("kind", "height", "matrix", "uids", "labels")], "windows")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    right = b.select(F.col("block").alias("b"), "chunk", *[F.col(c).alias(f"b_{c}") for c in ("kind", "height", "matrix", "uids", "labels", "ids")])
    met = pairs.withColumn("share", F.pmod(F.col("b"), F.lit(spread)).cast("int")).join(left, ["a", "share"]).join(right, ["b", "chunk"])
    partial = met.mapInArrow(_multiply, PARTIAL_SQL)
    placed = partial.withColumn("stripe", F.floor(F.col("b") / p.stripe)).repartition(parts, "a", "stripe").sortWithinPartitions("a", "b", "chunk").drop("stripe")
    found = placed.mapInArrow(_reduce(keep, k, p.stripe), FOUND_SQL)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, params: Params = Params()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors (vec_id, label, embedding)``.

    ``anchor`` tells the rows that are anchors. Rows with a null label, a null vector or a component that is null or
    not finite take no part. Repeated rows are rows of their own: one is another's positive, and a repeated anchor has
    its results twice. Ties go to the smaller vec_id, a null one last. Components that a shorter vector
    lacks are zero. Components so large that scores don't fit 64 bits are an error. Other columns are ignored; an
    empty table, or one without anchors, has no rows.
    """
    p = params
    stored = materialize(integer_rows(vectors, anchor, p), "integers")
    b = materialize(blocks_of(stored, p.rows, p.width), "rows")
    a = materialize(blocks_of(stored.where("anchor"), p.anchors, p.width), "anchors").withColumn("windows", F.lit(None).cast("array<struct<uid:long,place:int,score:long>>"))
    spans = [x.where("chunk = 0").select(F.col("block").alias(n), F.col("least").alias(f"{n}_least"), F.col("most").alias(f"{n}_most")) for n, x in (("a", a), ("b", b))]
    n_a, n_b = (s.count() for s in spans)
    grid = stored.sparkSession.range(n_a * n_b).select(F.expr(f"id div {max(1, n_b)}").alias("a"), F.expr(f"id % {max(1, n_b)}").alias("b")).join(spans[0], "a").join(spans[1], "b")

    def same(head: dict, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        itself = np.frombuffer(head["a_uids"], np.int64)[:, None] == np.frombuffer(head["b_uids"], np.int64)
        scores[~_labels(head) | itself] = _NONE
        yield 0, scores

    shared = grid.where("a_least <= b_most AND b_least <= a_most").select("a", "b")
    positives = materialize(_tiles(shared, a, b, p, same, p.positives), "positives")

    def in_window(head: dict, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        other, hundredfold = ~_labels(head), 100 * scores
        line = {u: i for i, u in enumerate(np.frombuffer(head["a_uids"], np.int64).tolist())}
        tops = np.full((p.positives, len(line)), _NONE)
        for w in head["windows"] or []:
            tops[w["place"] - 1, line[w["uid"]]] = w["score"]
        for i, top in enumerate(tops):
            have = np.flatnonzero(top != _NONE)
            if len(have):
                s, t = hundredfold[have], top[have, None]
                left = np.full(scores.shape, _NONE)
                left[have] = np.where(other[have] & (s >= p.low * t) & (s <= p.high * t), scores[have], _NONE)
                yield i + 1, left

    anchors_of = stored.where("anchor").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    uids = a.where("chunk = 0").select("block", F.explode("members").alias("anchor"))
    windows = positives.join(uids, "anchor").groupBy("block").agg(F.collect_list(F.struct(F.col("anchor").alias("uid"), F.col("rank").cast("int").alias("place"), "score")).alias("windows"))
    windowed = a.drop("windows").join(windows, "block", "left").withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows")))
    differing = grid.where("NOT (a_least = a_most AND b_least = b_most AND a_least = b_least)").select("a", "b")
    negatives = _tiles(differing, materialize(windowed, "windowed"), b, p, in_window, p.negatives)
    named = positives.select("anchor", F.col("rank").cast("int").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(named, ["anchor", "place"]).join(anchors_of, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
