"""Near-duplicates by SimHash with Golay keys and the exact Jaccard similarity of word shingles.

The keys come first: a set's 64-bit SimHash is cut into three segments, and a key takes the Golay indices of two
of them, each fuzzy (``simhash.fuzzy_indices``), so that pairs with two errors in each of two segments meet; what
meets within ``BITS`` is compared. At a similarity of 0.8 about ten bits differ, and keys alone would lose pairs.
Prefixes are the exact way for those: what the keys have compared isn't compared again.

Two sets of which one has at least the part t of the other in common share a shingle among the first
``n - ceil(t n) + 1`` of each, whatever one order all shingles are put in (prefix filtering): no pair is
missed. The order puts shingles that are frequent in a sample last, which keeps passages that many texts
share out of the prefixes; it decides the work, never the result. A shared shingle is the first that two sets have in
common in one of its rows at least, and there what follows it in the shorter rest bounds what they share: where
that isn't enough, the pair isn't looked at for this row's sake.

A set is kept if no kept earlier one is as similar. Large groups of near copies would have pairs with the
square of their size, so each round compares a prefix's sets with its ``top`` first ones only, settles what
follows from that, and goes on with the sets that are left and a larger ``top`` until none is. A pair is compared
once. Each set has a sketch, a bit or two per shingle, and what differs between two sketches differs between the sets,
so that most pairs that aren't similar are told by their sketches; the sets of the others alone are made from texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_rows, materialize, only, per_batch, release, row_hash, rows_of
from .simhash import SEGMENTS, fuzzy_indices, majority

#: Words of a shingle, and the least similarity as a fraction.
SIZE, LEAST = 5, (4, 5)
#: First sets of a prefix that a first round compares with, and how much more each later round takes.
TOP, MORE = 2, 8
#: Differing bits of two fingerprints of 64 beyond which what shares a key isn't compared; unlike ones have 32 on average.
BITS = 18
#: Sets that frequent shingles are looked for in, and the most of them that the order knows.
SAMPLE, FREQUENT = 8_000, 200_000
#: Most rows that are looked up by a broadcast join; beyond, texts are shuffled for it.
ASIDES = 500_000
#: Parts that the sets of a frequent shingle are dealt to.
PARTS = 1024

_MAX = 2**63 - 1


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Ascending distinct hashes of a text's word shingles; of fewer words than ``size`` one, without a word none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*[words[i:] for i in range(size)]))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64)).view(np.int64)


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def _mapped(docs: DataFrame, f: Callable[[list[np.ndarray]], dict], names: str, size: int) -> DataFrame:
    """Columns that ``f`` makes of the sets of each batch."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in map(str.split, names.split(", "))])
    return only(docs, "text").mapInArrow(per_batch(lambda b: f([shingles(t, size) for t in binary_rows(b["text"])]), schema), names)


def _frequent(docs: DataFrame, n_sets: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, ascending, and in how many of its texts they are."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n_sets // SAMPLE))) == 0).select("text").distinct()
    rows = _mapped(some, lambda found: {"key": np.concatenate([np.empty(0, np.int64), *found])}, "key long", size).groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    best = rows.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    return best["key"].to_numpy(np.int64), best["n"].to_numpy(np.int64)


def _prefixes(frequent: tuple[np.ndarray, np.ndarray], least: tuple[int, int]):
    """The first shingles of each set and their places ``at``, from 0; ``-1 - at`` for a shingle that is frequent."""
    known, times = frequent

    def run(found: list[np.ndarray]) -> dict:
        keys, ids, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for s in found:
            if len(s):
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, times[at], 0)
                first = np.lexsort((s, rank))[: len(s) + least[0] * len(s) // -least[1] + 1]
                place = np.arange(len(first), dtype=np.int32)
                keys.append(s[first])
                ids.append(np.full(len(first), set_id(s), np.int64))
                places.append(np.where(rank[first] > 0, -1 - place, place))
        return {"key": np.concatenate(keys), "set": np.concatenate(ids), "at": np.concatenate(places)}

    return run


def sketch(found: np.ndarray) -> bytes:
    """Whether an odd number of a set's shingles falls on each bit; as many bits as the next power of two of its size, 64 at least."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets alone, at least, by their sketches; the larger sketch is folded to the smaller."""
    u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0) ^ u).sum())


def _likely(least: tuple[int, int]):
    """Pairs whose sketches let them be similar: what is in one set alone is at most (1 - t) / (1 + t) of both sizes."""

    def run(batch: pa.RecordBatch) -> dict:
        both = batch["ma"].to_numpy().astype(np.int64) + batch["mb"].to_numpy()
        apart = np.fromiter(map(differing, batch["xa"].to_pylist(), batch["xb"].to_pylist()), np.int64)
        hits = pa.array(apart * sum(least) <= both * (least[1] - least[0]))
        return {"a": batch["a"].filter(hits), "b": batch["b"].filter(hits)}

    return per_batch(run, PAIRS)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
KEYED = pa.schema([("key", pa.int64()), ("set", pa.int64()), ("o", pa.int64()), ("m", pa.int32()), ("fp", pa.int64())])


def _keys(batch: pa.RecordBatch) -> dict:
    """Per fingerprint the Golay indices of each two segments, 1 to 36 keys."""
    u = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
    near = [-np.sort(-fuzzy_indices(((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)), axis=1)[:, :6] for a, n in SEGMENTS]
    keys, of = [], []
    for i in range(3):
        x, y = near[i][:, :, None], near[(i + 1) % 3][:, None, :]
        row, j, k = np.nonzero((x >= 0) & (y >= 0))
        keys.append(x[row, j, 0] | y[row, 0, k] << 12 | i << 24)
        of.append(row)
    rows = pa.array(np.concatenate(of))
    return {"key": np.concatenate(keys)} | {n: batch[n].take(rows) for n in KEYED.names[1:]}


def key_pairs(first: DataFrame, least: tuple[int, int] = LEAST, top: int = TOP) -> DataFrame:
    """Pairs ``(a, b)`` to compare, b the earlier and among the ``top`` first sets of a Golay key of both, within ``BITS``."""
    keyed = only(first.where("m > 0"), *KEYED.names[1:]).mapInArrow(per_batch(_keys, KEYED), "key long, set long, o long, m int, fp long")
    # one shuffle: a set meets the first ones of its key in the order of the window
    order = Window.partitionBy("key").orderBy("o", "set")
    firsts = {f"_{i}": F.nth_value(F.struct("set", "o", "m", "fp"), i + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) for i in range(top)}
    hits = []
    for name in firsts:
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col(f"{name}.fp"))) <= BITS
        hits.append(F.when(_ordered(least, f"{name}.{{}}") & near, F.col(f"{name}.set")))
    met = keyed.withColumns(firsts).select(F.col("set").alias("a"), F.array_compact(F.array(*hits)).alias("_hits")).where(F.size("_hits") > 0)
    return materialize(met.select("a", F.explode("_hits").alias("b")).distinct(), "key-pairs")


def _ordered(least: tuple[int, int], other: str = "{}_b"):
    """Whether the set with the names ``other`` is the earlier one, and their sizes let them be similar."""
    o, of, m = (F.col(other.format(n)) for n in ("o", "set", "m"))
    earlier = (o < F.col("o")) | (o == F.col("o")) & (of < F.col("set"))
    return earlier & (F.least("m", m) * least[1] >= F.greatest("m", m) * least[0])


def compared(docs: DataFrame, first: DataFrame, pairs: DataFrame, size: int = SIZE, least: tuple[int, int] = LEAST) -> DataFrame:
    """Those of ``pairs`` whose sets are similar: by their sketches, then by their shingles."""
    sketched = pairs
    for end in ("a", "b"):
        sketched = sketched.join(first.select(F.col("set").alias(end), F.col("m").alias(f"m{end}"), F.col("sketch").alias(f"x{end}")), end)
    pairs = materialize(sketched.select("a", "b", "ma", "mb", "xa", "xb").mapInArrow(_likely(least), "a long, b long"), "likely-pairs")
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    wanted = materialize(first.join(ends, "set", "left_semi").select("row", "n"), "candidate-rows")
    # a candidate is one row of its set, so only rows that repeat whole are shuffled to leave one
    held = _mapped(_texts(docs, wanted), lambda found: {"set": [set_id(s) for s in found], "s": [s.tobytes() for s in found]}, "set long, s binary", size)
    held = materialize(held, "sets")
    full = pairs.join(held.select(F.col("set").alias("b"), F.col("s").alias("sb")), "b").join(held.select(F.col("set").alias("a"), F.col("s").alias("sa")), "a")
    similar = materialize(full.select("a", "b", "sa", "sb").mapInArrow(_similar(least), "a long, b long"), "similar")
    release(held, wanted, pairs)
    return similar


def _similar(least: tuple[int, int]):
    def run(batch: pa.RecordBatch) -> dict:
        hits = []
        for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist()):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            hits.append(both * least[1] >= least[0] * (len(x) + len(y) - both))
        hits = pa.array(hits, pa.bool_())
        return {"a": batch["a"].filter(hits), "b": batch["b"].filter(hits)}

    return per_batch(run, PAIRS)


def _without(edges: DataFrame, settled: DataFrame) -> DataFrame:
    """Edges of which neither end is settled."""
    for end in ("a", "b"):
        edges = edges.join(settled.withColumnRenamed("set", end), end, "left_anti")
    return materialize(edges.select("a", "b"), "open-edges")


def _settle(sets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(settled, dropped)`` sets as far as the edges ``(a, b)``, b the earlier, tell; a set that isn't ``full`` has more edges."""
    settled = dropped = None
    while True:
        now = materialize(sets.where("full").select("set").join(edges.select(F.col("a").alias("set")), "set", "left_anti"), "kept-sets")
        if now.isEmpty():
            return None if settled is None else (settled, dropped)
        gone = materialize(edges.join(now.withColumnRenamed("set", "b"), "b").select(F.col("a").alias("set")).distinct(), "dropped-sets")
        both = now.union(gone)
        settled, dropped = (both, gone) if settled is None else (settled.union(both), dropped.union(gone))
        sets = materialize(sets.join(both, "set", "left_anti"), "open-sets")
        edges = _without(edges, both)


def _texts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The row of ``docs`` that each set of ``first`` is first in."""
    rows = first.select(F.col("row").alias("_row"), "n")
    return rows_of(docs, F.broadcast(rows) if rows.count() <= ASIDES else rows)


def dropped_sets(docs: DataFrame, first: DataFrame, size: int = SIZE, least: tuple[int, int] = LEAST, top: int = TOP) -> DataFrame:
    """Sets of the texts of ``docs`` that a kept earlier set is similar to; ``first`` has the place ``o``, a ``row``, its number of repeats ``n``, the number ``m`` of shingles, the fingerprint ``fp`` and the ``sketch`` of each ``set``; ties go by the set."""
    seen = key_pairs(first, least, top)
    edges = compared(docs, first, seen, size, least)
    frequent = _frequent(docs, first.count(), size)
    keyed = _mapped(_texts(docs, first), _prefixes(frequent, least), "key long, set long, at int", size)
    # one shuffle tells the shared prefixes; those of frequent shingles are taken as shared, so their sets may be apart
    part = F.when(F.col("at") < 0, F.pmod("set", F.lit(PARTS))).otherwise(0)
    times = keyed.withColumn("_part", part).withColumn("_times", F.count("*").over(Window.partitionBy("key", "_part")))
    shared = materialize(times.where("_times > 1 or at < 0").select("key", "set", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at")), "shared-prefixes")
    left = materialize(shared.join(first.select("set", "o", "m"), "set").select("key", "set", "at", "m", "o"), "shared-sets")
    release(shared)
    out = only(first, "set").limit(0)
    while not left.isEmpty():
        order = Window.partitionBy("key").orderBy("o", "set")
        tops = materialize(left.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top).select("key", "set", "at", "m", "o"), "first-sets")
        b = tops.select("key", *[F.col(n).alias(f"{n}_b") for n in ("set", "at", "m", "o")])
        enough = F.least(F.col("m") - F.col("at"), F.col("m_b") - F.col("at_b")) * sum(least) >= (F.col("m") + F.col("m_b")) * least[0]
        pairs = left.join(b, "key").where(_ordered(least) & enough).select(F.col("set").alias("a"), F.col("set_b").alias("b")).distinct()
        pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        edges = edges.union(compared(docs, first, pairs, size, least))
        n_top = tops.groupBy("set").agg(F.count("*").alias("_top"))
        sets = left.groupBy("set").agg(F.count("*").alias("_all")).join(n_top, "set", "left").select("set", (F.col("_all") == F.coalesce("_top", F.lit(0))).alias("full"))
        settled, dropped = _settle(materialize(sets, "open-sets"), edges)  # the first set of all is always settled
        out = out.union(dropped)
        after = materialize(left.join(settled, "set", "left_anti").select("key", "set", "at", "m", "o"), "shared-sets")
        release(left, tops)
        left, edges = after, _without(edges, settled)
        seen = _without(seen.union(pairs), settled)
        top *= MORE
    release(left)
    return out


def drop_similar(docs: DataFrame, size: int = SIZE, least: tuple[int, int] = LEAST, top: int = TOP) -> DataFrame:
    """The rows of ``docs`` whose text isn't as similar as ``least`` to that of an earlier row that stays.

    The order is by doc_id, null ones last, then by the text's set of shingles, then by a hash of the row. A
    row goes by its own text, so null and repeated ids are no matter. Texts without a word are equal.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX))
    schema = pa.schema([("row", pa.int64()), ("set", pa.int64()), ("o", pa.int64()), ("m", pa.int32()), ("fp", pa.int64()), ("sketch", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict:
        found = [shingles(t, size) for t in binary_rows(batch["text"])]
        fps = np.array([majority(s.view(np.uint64)) for s in found], np.uint64).view(np.int64)
        return {"row": batch["row"], "set": [set_id(s) for s in found], "o": batch["o"], "m": [len(s) for s in found], "fp": fps, "sketch": [sketch(s) for s in found]}

    rows = docs.select(row_hash(docs).alias("row"), number.alias("o"), "text").mapInArrow(per_batch(run, schema), "row long, set long, o long, m int, fp long, sketch binary")
    each = rows.groupBy("set", "o", "row", "m", "fp", "sketch").agg(F.count("*").alias("n"))
    first = materialize(each.groupBy("set", "m", "fp", "sketch").agg(F.min(F.struct("o", "row", "n")).alias("f")).select("set", "f.o", "f.row", "f.n", "m", "fp", "sketch"), "first-rows")
    kept = materialize(first.join(dropped_sets(docs, first, size, least, top), "set", "left_anti").select(F.col("row").alias("_row"), "n"), "kept-rows")
    return rows_of(docs, kept)
