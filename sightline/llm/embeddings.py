"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of at least t lie within a squared distance of 2 - 2t. Rotated to their principal
axes and cut into blocks of a few axes, they share that budget: if every block gets a share of it, in
proportion to its variance, two such vectors are within the share in at least one block. Each block is
range-joined: inside a group its first axes are gridded in cells as wide as the share's root, sorted along
one more axis, and a row meets only stretches of its own cell and of half the neighbours. What is within the
share in a block is verified on the whole vectors; a pair counts in the first block whose share it keeps, so
the union over blocks holds it once.

A label whose vectors one task can hold (``held``) is a group and is sent once, for all its blocks. A larger one is cut, in
each block, into cells on one to four axes, and sends a vector also where those of a neighbouring cell may
be in reach; a cell of more than a task holds is dealt to several groups, each of which keeps one chunk
and has the others stream past it. Equal vectors are joined once, with their number. Links are counted and
joined to trees where they are found, so a dense cluster sends rows in proportion to its members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, only

#: Stands for a null id inside.
_NO_ID = -(2**63)
#: Room for rounding in a block's share.
_SLACK = 1 + 1e-6


@dataclass(frozen=True)
class Params:
    """``block`` axes of a rotated vector are a block, of which ``grid`` are gridded inside a group; ``held`` bounds
    the components of the vectors that a group keeps, and of those that it meets at a time."""

    cosine: float = 0.98
    block: int = 8
    grid: int = 5
    held: int = 1 << 20


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, packed as floats or doubles."""
    packed = b"".join(column.to_pylist())
    return np.frombuffer(packed, np.float64 if len(packed) == 8 * dim * len(column) else np.float32).reshape(-1, dim).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _rotate(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """``u @ axes``, added up in one fixed order, so that a row gives the same bits in any company."""
    y = np.zeros_like(u)
    for j in range(u.shape[1]):
        y += u[:, j : j + 1] * axes[j]
    return y


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    dims = batch["dim"].to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), _matrix(part["vector"], int(dim)), part


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, v, _ in _by_dim(batch):
            u = _unit(v)
            total[dim] = total.get(dim, 0) + u.T @ u
    for dim, m in total.items():
        yield pa.RecordBatch.from_pydict({"dim": np.full(m.size, dim, np.int32), "at": np.arange(m.size, dtype=np.int64), "sum": m.ravel()})


@dataclass(frozen=True)
class Rotation:
    """Principal axes of one dimension, as columns, and what each block may use of the squared distance."""

    axes: np.ndarray
    cuts: list[tuple[int, int]]
    shares: list[float]


def rotations(vectors: DataFrame, params: Params) -> dict[int, Rotation]:
    """From sums over all vectors of products of two components; only those sums come to the driver."""
    rows = vectors.select("dim", "vector").mapInArrow(_moments, "dim int, at long, sum double").groupBy("dim", "at").agg(F.sum("sum").alias("sum")).collect()
    found = {}
    for dim in {r["dim"] for r in rows}:
        m = np.zeros(dim * dim)
        for r in rows:
            if r["dim"] == dim:
                m[r["at"]] = r["sum"]
        variance, axes = np.linalg.eigh(m.reshape(dim, dim))
        variance, axes = np.maximum(variance[::-1], 1e-12), np.ascontiguousarray(axes[:, ::-1])
        cuts = [(a, min(dim, a + params.block)) for a in range(0, dim, params.block)]
        whole = (2 - 2 * params.cosine) * _SLACK
        found[dim] = Rotation(axes, cuts, [whole * variance[a:b].sum() / variance.sum() for a, b in cuts])
    return found


PLACED = "label string, dim int, block int, cell string, guest boolean, node long, copies long, vector binary"
#: Stands for all blocks in the rows of a label that one group holds whole.
ALL = -1
#: A cell of a large label in roots of its block's share, and the most axes that are cut into such cells.
WIDTH, DEEPEST = 2, 4


def _reach(share: float) -> float:
    """How far two vectors within ``share`` may lie apart on one axis, with room for rounding."""
    return float(np.sqrt(share)) * (1 + 1e-9)


def _halves(axes: int) -> list[tuple[int, ...]]:
    """Half of a cell's neighbours: those whose first step that isn't zero is positive."""
    return [s for s in itertools.product((-1, 0, 1), repeat=axes) if next((x for x in s if x), 0) > 0]


def _cells(y: np.ndarray, width: float, reach: float) -> Iterator[tuple[list[str], np.ndarray, bool]]:
    """Names of cells, the rows that go there and whether as guests: each to its own, and to those of half its neighbours whose rows may be within reach."""
    cell = np.floor(y / width).astype(np.int64)
    up, down = (cell + 1) * width - y <= reach, y - cell * width <= reach
    for step in [(0,) * y.shape[1], *_halves(y.shape[1])]:
        goes = np.ones(len(y), bool)
        for k, x in enumerate(step):
            if x:
                goes &= down[:, k] if x > 0 else up[:, k]
        rows = np.flatnonzero(goes)
        yield [",".join(map(str, c)) for c in (cell[rows] - np.array(step)).tolist()], rows, any(step)


def _place(turns: dict[int, Rotation]):
    """Rows of labels at level 0 once, for all blocks; those of others in every block, in cells of as many axes as the level says."""

    def row(part: pa.RecordBatch, rows: np.ndarray, block: int, cells: list[str], guest: bool) -> pa.RecordBatch:
        of = part.take(pa.array(rows))
        return pa.RecordBatch.from_pydict({
            "label": of["label"], "dim": of["dim"], "block": np.full(len(rows), block, np.int32), "cell": pa.array(cells, pa.string()),
            "guest": np.full(len(rows), guest), "node": of["node"], "copies": of["copies"], "vector": of["vector"],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, v, part in _by_dim(batch):
                turn, level = turns[dim], part["level"].to_numpy(zero_copy_only=False)
                whole = np.flatnonzero(level == 0)
                yield row(part, whole, ALL, [""] * len(whole), False)
                if len(whole) == len(level):
                    continue
                y = _rotate(_unit(v), turn.axes)
                for axes in np.unique(level[level > 0]).tolist():
                    some = np.flatnonzero(level == axes)
                    for b, ((first, last), share) in enumerate(zip(turn.cuts, turn.shares)):
                        reach = _reach(share)
                        for cells, rows, guest in _cells(y[some, first : min(last, first + axes)], WIDTH * reach, reach):
                            yield row(part, some[rows], b, cells, guest)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs and the smallest node that they connect it to."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


#: Pairs that are looked at together.
_PAIRS = 1 << 18
#: Bits of a row's rank and of a cell's number on one axis in a sort key; cells that agree in them are told apart by the distance.
_RANK, _CELL = 20, 5


def _slices(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row with the rows from its ``low`` up to its ``high``, some at a time."""
    rows = np.flatnonzero(high > low)
    low, size = low[rows], high[rows] - low[rows]
    upto = np.cumsum(size)
    i = 0
    while i < len(rows):
        before = int(upto[i] - size[i])
        j = max(i + 1, int(np.searchsorted(upto, before + _PAIRS, "right")))
        n = size[i:j]
        yield np.repeat(rows[i:j], n), np.arange(int(n.sum())) + np.repeat(low[i:j] - (upto[i:j] - n - before), n)
        i = j


def near_cells(group: np.ndarray, y: np.ndarray, reach: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within ``reach`` on the last of the first ``grid`` axes, and in the same or neighbouring cells on the others.

    Holds every pair within ``reach`` on all axes once; rows are sorted by group, cell and last axis, and the
    rows of a cell or neighbour that are near enough are one stretch of that order.
    """
    grid = min(grid, y.shape[1])
    along = y[:, grid - 1]
    ranked = np.sort(along)
    rank, low, high = np.searchsorted(ranked, along), np.searchsorted(ranked, along - reach), np.searchsorted(ranked, along + reach, "right")
    cell = np.floor(y[:, : grid - 1] / reach).astype(np.int64)

    def key(c: np.ndarray, g: np.ndarray) -> np.ndarray:
        for k in range(c.shape[1]):
            g = g << _CELL | (c[:, k] & ((1 << _CELL) - 1))
        return g << _RANK

    order = np.argsort(key(cell, group) + rank, kind="stable")
    group, cell, low, high = group[order], cell[order], low[order], high[order]
    sorted_keys = key(cell, group) + rank[order]
    for step in [(0,) * (grid - 1), *_halves(grid - 1)]:
        there = key(cell + np.array(step, np.int64), group)
        end = np.searchsorted(sorted_keys, there + high)
        for i, j in _slices(np.searchsorted(sorted_keys, there + low) if any(step) else np.arange(1, len(order) + 1), end):
            yield order[i], order[j]


def _within(turn: Rotation, block: int, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which pairs keep the block's share; sums only grow, so a pair is left as soon as it exceeds it."""
    alive, d = np.arange(len(m)), np.zeros(len(m))
    for k in range(*turn.cuts[block]):
        d = d + (y[m[alive], k] - y[n[alive], k]) ** 2
        fine = d <= turn.shares[block]
        alive, d = alive[fine], d[fine]
    found = np.zeros(len(m), bool)
    found[alive] = True
    return found


@dataclass
class _Rows:
    """Vectors of one dimension, each with the number of its group; ``old`` ones have met each other."""

    group: np.ndarray
    block: np.ndarray
    guest: np.ndarray
    old: np.ndarray
    node: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    turned: np.ndarray

    def where(self, rows: np.ndarray) -> _Rows:
        return _Rows(*(getattr(self, f)[rows] for f in self.__dataclass_fields__))

    def with_(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.__dataclass_fields__))

    def links(self, turn: Rotation, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for block, (first, last) in enumerate(turn.cuts):
            here = np.flatnonzero((self.block == ALL) | (self.block == block))
            if len(here) < 2:
                continue
            for i, j in near_cells(self.group[here], self.turned[here, first:last], _reach(turn.shares[block]), params.grid):
                m, n = here[i], here[j]
                fresh = ~(self.guest[m] & self.guest[n]) & ~(self.old[m] & self.old[n])
                m, n = m[fresh], n[fresh]
                for b in range(block, -1, -1):  # a pair counts in the first block whose share it keeps
                    fine = _within(turn, b, self.turned, m, n) == (b == block)
                    m, n = m[fine], n[fine]
                same = (self.unit[m] * self.unit[n]).sum(axis=1) >= params.cosine
                m, n = m[same], n[same]
                if len(m):
                    yield _told(self.node[m], self.node[n], self.copies[m], self.copies[n])


def _told(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tree, root = _forest(a, b)
    _, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    links = np.bincount(index, np.concatenate([of_b, of_a]).astype(np.float64)).astype(np.int64)
    return tree, root, links


LINKED = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _join(turns: dict[int, Rotation], params: Params):
    """Of a partition sorted by group, kept vectors first: for each vector with links a tree edge and their number.

    Whole stretches of the partition are compared at once, whatever groups they belong to. What the last
    group keeps, which ``held`` bounds, meets the next stretch.
    """
    keys = ("label", "dim", "block", "cell", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for whole in batches:
            begin = 0
            while begin < whole.num_rows:
                batch = whole.slice(begin, max(256, params.held // int(whole["dim"][begin].as_py())))
                begin += batch.num_rows
                marks = list(zip(*(batch[k].to_pylist() for k in keys)))
                group = np.cumsum([i > 0 and marks[i] != marks[i - 1] for i in range(len(marks))]).astype(np.int64)
                dims, block = batch["dim"].to_numpy(), batch["block"].to_numpy()
                guest, node, copies = batch["guest"].to_numpy(zero_copy_only=False), batch["node"].to_numpy(), batch["copies"].to_numpy()
                told, carried = [], kept if marks[0] == last else None
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    unit = _unit(_matrix(batch["vector"].take(pa.array(at)), dim))
                    rows = _Rows(group[at], block[at], guest[at], np.zeros(len(at), bool), node[at], copies[at], unit, _rotate(unit, turns[dim].axes))
                    if carried and dim == marks[0][1]:
                        rows = carried.with_(rows)
                    told += rows.links(turns[dim], params)
                    if dim == marks[-1][1]:
                        kept = rows.where((rows.group == group[-1]) & ~rows.guest)
                        kept.group[:], kept.old[:] = 0, True
                last = marks[-1]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*told)], schema=LINKED)

    return run


def _side(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= 100_000 else small


def _dealt(vectors: DataFrame, turns: dict[int, Rotation], params: Params) -> DataFrame:
    """Each vector in its group, and as a guest in those it has to meet.

    A label of up to ``held`` components is one group, sent once. A larger one is cut into cells in every block,
    on more axes the more vectors it has; a cell that still holds more is dealt to several groups.
    """
    groups = F.col("count") * F.col("dim") / params.held
    level = F.least(F.lit(DEEPEST), F.ceil(F.log(3.0, groups))).cast("int")
    large = materialize(vectors.groupBy("label", "dim").count().where(groups > 1).select("label", "dim", level.alias("level")), "large-labels")
    n = large.count()
    if not n:
        return vectors.withColumn("level", F.lit(0)).mapInArrow(_place(turns), PLACED).withColumn("chunk", F.lit(0))
    placed = vectors.join(_side(large, n), ["label", "dim"], "left").withColumn("level", F.coalesce("level", F.lit(0))).mapInArrow(_place(turns), PLACED)
    cell = ["label", "dim", "block", "cell"]
    homes = placed.where(~F.col("guest") & (F.col("block") != ALL)).groupBy(*cell).count()
    full = materialize(homes.where(groups > 1).select(*cell, F.ceil(groups).cast("int").alias("chunks")), "large-cells")
    sent = placed.join(_side(full, full.count()), cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.when(~F.col("guest"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    sent = sent.withColumn("mine", mine).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("mine", F.col("chunks") - 1))))
    return sent.withColumn("guest", F.col("guest") | (F.col("chunk") < F.col("mine"))).drop("mine", "chunks")


def embedding_groups(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, label, embedding``.

    Only vectors with equal labels that aren't null are compared. Vectors that are null, zero, empty or hold
    a null or non-finite component link with nothing, nor do vectors of different lengths. Rows that repeat
    id, label and vector are one vector; different vectors under one id are compared each, have links of
    their own, and are joined to one component where both have links. All rows without an id share one. Other columns are ignored.
    """
    e = F.col("embedding")
    fine = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    all_rows = only(rows, "vec_id", "label", "embedding").select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("string").alias("label"), e.cast(f"array<{kind}>").alias("embedding")
    )
    sound = all_rows.where(F.col("label").isNotNull() & fine)
    distinct = sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("copies"))
    # an id may have several vectors, so that a vector is told by a number of its own
    told_apart = distinct.withColumn("node", F.monotonically_increasing_id())
    packed = materialize(told_apart.mapInArrow(_pack, f"label string, embedding array<{kind}>, dim int, node long, least long, copies long, vector binary"), "vectors")

    turns = rotations(packed, params)
    vectors = packed.select("label", "dim", "node", "copies", "vector")
    dealt = _dealt(vectors, turns, params)
    keys = ["label", "dim", "block", "cell", "chunk"]
    joined = dealt.repartition(*keys).sortWithinPartitions(*keys, "guest")
    linked = materialize(joined.mapInArrow(_join(turns, params), "node long, root long, links long"), "links")

    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    ids = packed.select("node", "least")
    edges = linked.select("node", "root").join(ids, "node").select(F.col("least").alias("a"), F.col("root").alias("node")).join(ids, "node").select("a", F.col("least").alias("b"))
    roots = connected_components(edges).withColumnRenamed("node", "least")
    told = packed.select("label", "embedding", "node", "least", "copies").join(counts, "node", "left").join(roots, "least", "left")
    found = materialize(
        told.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id")), "found-links"
    )
    out = all_rows.join(found, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    no_id = F.lit(_NO_ID)
    return out.select(F.nullif("vec_id", no_id).alias("vec_id"), "n_links", F.nullif("component_id", no_id).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch["embedding"].type.value_type.to_pandas_dtype()
        vectors = [np.asarray(v, kind).tobytes() for v in batch["embedding"].to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "label": batch["label"], "embedding": batch["embedding"], "dim": batch["embedding"].value_lengths(),
            "node": batch["node"], "least": batch["least"], "copies": batch["copies"], "vector": pa.array(vectors, pa.binary()),
        })
