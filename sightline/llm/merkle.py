"""A Merkle manifest of a table: grouped leaves, their roots, and a proof for every row.

Leaves are sorted by ranges of group and key into an RDD whose partitions stay as they are (a checkpoint). Each
partition says how many leaves of its first and last group it has; these counts, in order, shift its positions in the
groups that other partitions share. Every partition then builds the complete subtrees that lie in it whole. What
remains at its edges are at most two nodes a level; these ragged nodes are shuffled by coordinate, a few levels
a step, and finish the upper levels. The nodes beside a partition's edges go back to it, and it writes its rows' proofs.

The roots of groups, ordered by group, are the leaves of one more tree, made the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Leaves of a partition, about.
LEAVES = 1 << 18
#: Levels that one shuffle of ragged nodes climbs.
CLIMB = 4


def hex_hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; null as ``-``."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def size_at(n: int, level: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    return -(-n >> level)


def height(n: int) -> int:
    """Levels above the leaves."""
    return max(0, n - 1).bit_length()


class Run:
    """The nodes of a run of leaves ``[start, start + len)`` of a group of ``total`` that the run decides alone, by level."""

    def __init__(self, leaves: list[str], start: int, total: int) -> None:
        self.start, self.total = start, total
        #: (first index, nodes) of each level.
        self.levels = [(start, leaves)]
        while self.levels[-1][1] and len(self.levels) <= height(total):
            begin, nodes = self.levels[-1]
            level = len(self.levels)
            if begin & 1:
                begin, nodes = begin + 1, nodes[1:]
            up = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(nodes[::2], nodes[1::2])]
            if len(nodes) & 1 and begin + len(nodes) == size_at(total, level - 1):
                up.append(hex_hash(nodes[-1]))
            self.levels.append((begin >> 1, up))

    def edges(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, node) of the nodes whose parent the run doesn't decide: at most two a level."""
        for level, (begin, nodes) in enumerate(self.levels):
            above, up = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            if not up:
                yield from ((level, begin + i, x) for i, x in enumerate(nodes))
                continue
            if 2 * above > begin:
                yield level, begin, nodes[0]
            if begin + len(nodes) > 2 * (above + len(up)):
                yield level, begin + len(nodes) - 1, nodes[-1]

    def node(self, level: int, i: int) -> str | None:
        begin, nodes = self.levels[level] if level < len(self.levels) else (0, [])
        return nodes[i - begin] if begin <= i < begin + len(nodes) else None

    def beside(self) -> Iterator[tuple[int, int]]:
        """(level, index) of the nodes that proofs of these leaves need and the run doesn't decide: at most four a level."""
        for level in range(height(self.total)):
            a, b = self.start >> level, (self.start + len(self.levels[0][1]) - 1) >> level
            for i in {a, a ^ 1, b, b ^ 1}:
                if a <= i ^ 1 <= b and i < size_at(self.total, level) and self.node(level, i) is None:
                    yield level, i

    def proof(self, at: int, outside: dict[tuple[int, int], str]) -> tuple[list[str | None], list[bool]]:
        """The siblings of the leaf at position ``at`` of the group, from below, None where a node has none, and whether each is on the left."""
        siblings, left = [], []
        for level in range(height(self.total)):
            i = at >> level ^ 1
            siblings.append(None if i >= size_at(self.total, level) else self.node(level, i) or outside[level, i])
            left.append(not i & 1)
        return siblings, left


def _ordered(leaves: DataFrame, n: int) -> DataFrame:
    """``leaves`` in ranges of group, key and leaf, as a checkpoint: partitions and their rows stay what they are."""
    context = leaves.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(leaves.sparkSession))
    # rows that are equal in all three may be very many; the last column spreads them
    order = [*[F.asc_nulls_first(c) for c in ("grp", "key", "leaf")], F.asc("salt")]
    salted = leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    return salted.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt").checkpoint()


def _cuts(column: pa.Array) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    at = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return list(zip(at, at[1:]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """A sorted partition's groups, one after another."""
    parts = (batch.slice(a, b - a) for batch in batches if batch.num_rows for a, b in _cuts(batch["grp"]))
    for grp, own in groupby(parts, key=lambda x: x["grp"][0].as_py()):
        yield grp, pa.Table.from_batches(list(own))


def _places(ordered: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """By partition, (start, total) of its first and of its last group. Their number, which ``grow`` sets, bounds what comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [(g, table.num_rows) for g, table in _runs(batches)]
        part = TaskContext.get().partitionId()
        ends = [(part, *found[0]), (part, *found[-1])][: len(found)]
        yield pa.RecordBatch.from_pydict(dict(zip(COUNTS.names, map(list, zip(*ends)))) if ends else {c: [] for c in COUNTS.names}, schema=COUNTS)

    ends: dict[int, list[tuple[str | None, int]]] = {}
    for x in ordered.select("grp").mapInArrow(count, "part int, grp string, n long").collect():
        ends.setdefault(x.part, []).append((x.grp, x.n))
    totals: dict[str | None, int] = {}
    starts: dict[int, list[int]] = {}
    for part in sorted(ends):
        starts[part] = [totals.get(g, 0) for g, _ in ends[part]]
        for g, n in ends[part]:
            totals[g] = totals.get(g, 0) + n
    return {part: [(start, totals[g]) for start, (g, _) in zip(starts[part], ends[part])] for part in ends}


COUNTS = pa.schema([("part", pa.int32()), ("grp", pa.string()), ("n", pa.int64())])


def _placed(groups: Iterator[tuple[object, pa.Table]], mine: list[tuple[int, int]]) -> Iterator[tuple[object, pa.Table, int, int]]:
    """The groups of a partition with the position of their first leaf here and their number of leaves."""
    held = None
    for i, (g, table) in enumerate(groups):
        if held:
            yield (*held, *(mine[0] if i == 1 else (0, held[1].num_rows)))
        held = (g, table)
    if held:
        yield (*held, *mine[-1])


NODES = pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("node", pa.string()), ("part", pa.int32())])
NODES_SQL = "grp string, total long, level int, i long, node string, part int"


def _climb(nodes: DataFrame, top: int) -> DataFrame:
    """All nodes up to level ``top`` that follow from ``nodes``, brought together by their ancestor's coordinate there; ``part`` is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (grp, _), own in groupby(rows, key=lambda x: (x["grp"], x["up"])):
            made, total = [], 0
            waiting: dict[int, list[tuple[int, str]]] = {}
            for x in own:
                total = x["total"]
                waiting.setdefault(x["level"], []).append((x["i"], x["node"]))
            last = min(top, height(total))
            for level in range(last + 1):
                have = dict(waiting.pop(level, []))
                made += [(grp, total, level, i, node, None) for i, node in have.items()]
                for i in {i & ~1 for i in have} if level < last else ():
                    right = [have[i + 1]] if i + 1 < size_at(total, level) else []
                    waiting.setdefault(level + 1, []).append((i >> 1, hex_hash(have[i], *right)))
            yield pa.RecordBatch.from_pydict(dict(zip(NODES.names, map(list, zip(*made)))), schema=NODES)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("grp", "total", "level", "i", "node", F.expr(f"shiftright(i, {top} - level)").alias("up"))
    return keyed.repartition(parts, "grp", "up").sortWithinPartitions("grp", "up").mapInArrow(run, NODES_SQL)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*part)))), schema=schema)


@dataclass(frozen=True)
class Forest:
    """``ordered``: the checkpointed leaves; ``places``: what its partitions hold; ``nodes``: all ragged nodes and those
    above them, each once; ``wanted``: per partition and group of it, the nodes of others that its proofs need."""

    ordered: DataFrame
    places: dict[int, list[tuple[int, int]]]
    nodes: DataFrame
    wanted: DataFrame

    def roots(self) -> DataFrame:
        return self.nodes.where("i = 0 AND shiftright(total - 1, level) = 0").select("grp", F.col("node").alias("root"))


def grow(leaves: DataFrame, per_part: int = LEAVES) -> Forest:
    """The trees of all groups of ``leaves (grp, key, leaf, ...)``; ``grp`` is a string or null, ``leaf`` a hash in hex."""
    spark = leaves.sparkSession
    n = leaves.count()
    parts = max(1, -(-n // per_part), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)))
    ordered = _ordered(leaves, parts)
    places = _places(ordered)
    shared = spark.sparkContext.broadcast(places)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for grp, table, start, total in _placed(_runs(batches), shared.value.get(part, [])):
                run = Run(table["leaf"].to_pylist(), start, total)
                yield from ((grp, total, level, i, node, part) for level, i, node in run.edges())
                yield (grp, total, None, None, None, part)
                yield from ((grp, total, level, i, None, part) for level, i in run.beside())

        yield from _batches(rows(), NODES)

    edges = materialize(ordered.select("grp", "leaf").mapInArrow(build, NODES_SQL), "edges")
    open_nodes, done = edges.where("node IS NOT NULL"), None
    top = height(open_nodes.agg(F.max("total")).first()[0] or 0)
    for level in [*range((n // max(1, len(places))).bit_length() + CLIMB, top, CLIMB), top]:
        climbed = materialize(_climb(open_nodes.where(F.col("level") <= level), level), "climbed")
        ended = climbed if level == top else climbed.where(F.col("level") < level)
        done = ended if done is None else done.unionByName(ended)
        open_nodes = climbed.where(F.col("level") == level).unionByName(open_nodes.where(F.col("level") > level))
    return Forest(ordered, places, done, edges.where("node IS NULL").select("grp", "level", "i", "part"))


STEPS = "array<struct<sibling: string, left: boolean>>"


def _steps(proofs: list[tuple[list[str | None], list[bool]]]) -> pa.Array:
    ends = np.cumsum([0, *(len(s) for s, _ in proofs)]).astype(np.int32)
    siblings, left = (list(chain.from_iterable(p[k] for p in proofs)) for k in (0, 1))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(siblings, pa.string()), pa.array(left, pa.bool_())], ["sibling", "left"]))


def proofs(forest: Forest, tops: DataFrame | None = None) -> DataFrame:
    """The leaves' columns with ``subroot``, ``root`` and ``proof``: (sibling, left) from the leaf up to the root.

    ``tops (grp, root, above)``: what is above the root of each group, as a second tree's proofs tell.
    A partition's rows and what others know for it are sorted into one stream, which one task reads.
    """
    spark = forest.ordered.sparkSession
    shared = spark.sparkContext.broadcast(forest.places)
    nodes = forest.nodes.select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("i").alias("j"), "node")
    of_node = (F.col("g").eqNullSafe(F.col("grp"))) & (F.col("l") == F.col("level")) & (F.col("j") == F.col("i"))
    found = forest.wanted.where("level IS NOT NULL").join(nodes, of_node).groupBy("part", "grp").agg(F.collect_list(F.struct("level", "i", "node")).alias("outside"))
    found = found.select(F.col("part").alias("p"), F.col("grp").alias("g"), "outside")
    known = forest.wanted.where("level IS NULL").select("part", "grp").join(found, (F.col("p") == F.col("part")) & F.col("g").eqNullSafe(F.col("grp")), "left").select("part", "grp", "outside")
    roots = forest.roots().select(F.col("grp").alias("g"), F.col("root").alias("subroot"))
    known = known.join(roots, F.col("g").eqNullSafe(F.col("grp"))).drop("g")
    if tops is None:
        known = known.withColumn("root", F.col("subroot")).withColumn("above", F.array().cast(STEPS))
    else:
        above = tops.select(F.col("grp").alias("g"), "root", "above")
        known = known.join(above, F.col("g").eqNullSafe(F.col("grp"))).drop("g")
    leaf = F.struct(*forest.ordered.columns)
    leaves = forest.ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), leaf.alias("leaf"))
    # what is known of a group stands before the partition's leaves
    facts = known.select("part", F.lit(-1).cast("long").alias("pos"), F.struct("grp", "outside", "subroot", "root", "above").alias("known"))
    stream = leaves.unionByName(facts, allowMissingColumns=True)
    schema = spark.createDataFrame([], forest.ordered.schema).selectExpr("*", "'' AS subroot", "'' AS root", f"CAST(NULL AS {STEPS}) AS proof").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (batch.slice(i, 2000) for batch in batches for i in range(0, batch.num_rows, 2000))
        cut = (part.slice(a, b - a) for part in pieces for a, b in _cuts(part["part"]))
        for part, own in groupby(cut, key=lambda x: x["part"][0].as_py()):
            about: dict[str | None, dict] = {}

            def rows() -> Iterator[pa.RecordBatch]:
                for b in own:
                    first = int((b["pos"].to_numpy() < 0).sum())
                    about.update((x["grp"], x) for x in b["known"].slice(0, first).to_pylist())
                    if b.num_rows > first:
                        yield pa.RecordBatch.from_struct_array(b["leaf"].slice(first))

            for grp, table, start, total in _placed(_runs(rows()), shared.value[part]):
                tree, fact = Run(table["leaf"].to_pylist(), start, total), about[grp]
                outside = {(x["level"], x["i"]): x["node"] for x in fact["outside"] or []}
                above = [x["sibling"] for x in fact["above"]], [x["left"] for x in fact["above"]]
                for i in range(0, table.num_rows, 2000):
                    part_rows = table.slice(i, 2000).combine_chunks()
                    n = part_rows.num_rows
                    found = [tree.proof(start + i + k, outside) for k in range(n)]
                    steps = _steps([(s + above[0], left + above[1]) for s, left in found])
                    ends = [pa.array([fact["subroot"]] * n), pa.array([fact["root"]] * n), steps]
                    arrays = [part_rows[c].combine_chunks() for c in part_rows.column_names]
                    yield pa.RecordBatch.from_arrays(arrays + ends, names=[*part_rows.column_names, "subroot", "root", "proof"])

    n = max(len(forest.places), 1)
    return stream.repartition(n, "part").sortWithinPartitions("part", "pos").mapInArrow(run, schema)


def manifest(rows: DataFrame, group: str, key: str, leaf: str, per_part: int = LEAVES) -> DataFrame:
    """Every row with ``subroot``, ``root`` and ``proof``, an array of (sibling, left) from its leaf up.

    Leaves of a group ascend by ``key``, then ``leaf`` (null keys first); groups by their UTF-8 bytes (null first, a group
    of its own). Repeated rows are leaves of their own, beside each other. A node without a sibling has null there, and its parent is the hash of it
    alone; a lone leaf is its group's root. An empty table has no rows. Other columns stay, whatever their names.
    """
    held = rows.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("leaf"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    forest = grow(held, per_part)
    roots = materialize(forest.roots(), "roots")
    upper = proofs(grow(roots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf")), per_part))
    tops = materialize(upper.select(F.col("key").alias("grp"), "root", F.col("proof").alias("above")), "tops")
    proven = proofs(forest, tops)
    taken = {c.lower() for c in rows.columns} & {"subroot", "root", "proof"}
    if taken:
        raise ValueError(f"rows already have {', '.join(sorted(taken))}")
    return proven.select("row.*", "subroot", "root", "proof")


def siblings_hash(proof: Column) -> Column:
    """The hash of a proof's siblings, left to right as they are met."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(node: Column, s: Column) -> Column:
        other = F.coalesce(s["sibling"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, node)).otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)
