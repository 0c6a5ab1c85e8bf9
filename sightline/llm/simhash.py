"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Two differing bits in three segments
leave one segment untouched, and no segment with more than two errors. The untouched one is matched as
it is; the next one fuzzily: every word of 23 bits is within three bits of exactly one word of the
perfect binary Golay code, and a segment gets as keys the 12-bit indices of all code words to which it
or one of its 23 single-bit neighbours decodes (one or six). Two segments that differ in at most two
bits have a common neighbour, so they share a key. Three such keys families (33 or 34 bits each) give
the candidates, which are verified on the whole fingerprint.

Only distinct fingerprints are joined, so copies cost one row. Where more than ``bucket`` distinct
fingerprints share a key, their pairs aren't formed: each is sent to itself and its 64 single-bit
neighbours, and those that meet (at most 65) are linked. That is exact for two bits as well, and linear.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, connected_components, materialize, only, per_batch, row_hash, rows_of

#: Generator of the [23, 12, 7] Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Largest number of differing bits that the keys are made for.
ERRORS = 2
#: Hash values that are unpacked at once.
CHUNK = 1 << 17


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles of ``size``; zero without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    digest = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    return majority(np.fromiter(map(digest, shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` of every row, and its longs ``carry``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(t, size, seed) for t in binary_rows(batch["text"])]
        return {"doc_id": batch["doc_id"], "fp": np.array(found, np.uint64).view(np.int64)} | {c: batch[c] for c in carry}

    names = ("doc_id", "fp", *carry)
    d = only(docs, "doc_id", "text", *carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(per_batch(run, pa.schema([(n, pa.int64()) for n in names])), ", ".join(f"{n} long" for n in names))


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits, and the error pattern of each of the 2,048 remainders."""

    def remainder(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GOLAY << (i - 11)
        return w

    bits = np.array([remainder(1 << i) for i in range(23)], np.int64)
    errors = np.full(2048, -1, np.int64)
    errors[0] = 0
    for i in range(23):
        errors[bits[i]] = 1 << i
        for j in range(i):
            errors[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return bits, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one Golay code word within three bits of each 23-bit word."""
    bits, errors = _golay()
    rest = np.zeros(words.shape, np.int64)
    for i in range(23):
        rest ^= (words >> i & 1) * bits[i]
    return (words ^ errors[rest]) >> 11


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """Per word its 24 decoded indices (itself and each single-bit neighbour), ascending; repeats are -1."""
    near = np.sort(decode(words[:, None] ^ np.r_[0, 1 << np.arange(23)][None, :]), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near


def _keys(batch: pa.RecordBatch) -> dict:
    fp = batch["fp"].to_numpy(zero_copy_only=False)
    u = fp.view(np.uint64)
    cut = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys, of = [], []
    for i in range(3):
        near = fuzzy_indices(cut[(i + 1) % 3])
        row, col = np.nonzero(near >= 0)
        keys.append(near[row, col] | cut[i][row] << 12 | i << 34)
        of.append(fp[row])
    return {"key": np.concatenate(keys), "fp": np.concatenate(of)}


def _around(batch: pa.RecordBatch) -> dict:
    fp = batch["fp"].to_numpy(zero_copy_only=False)
    masks = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)].view(np.int64)
    return {"key": (fp[:, None] ^ masks[None, :]).ravel(), "fp": np.repeat(fp, 65)}


KEYED = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def links(fps: DataFrame, bits: int = ERRORS, bucket: int = 256) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp``: they connect exactly what ``bits`` or fewer differing bits connect.

    Keys with up to ``bucket`` fingerprints give each pair within ``bits``. Beyond, fingerprints that share
    a single-bit neighbour are linked through their smallest, which needs ``bits`` of 2.
    """
    if bits != ERRORS:
        raise ValueError("the keys are made for two differing bits")
    keyed = fps.select("fp").mapInArrow(per_batch(_keys, KEYED), "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, "key"), "golay-keys")
    small = shared.where(F.col("n") <= bucket).select("key", "fp")
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select("a", "b")
    )
    dense = shared.where(F.col("n") > bucket).select("fp").distinct()
    met = dense.mapInArrow(per_batch(_around, KEYED), "key long, fp long").groupBy("key").agg(F.collect_set("fp").alias("fps"))
    stars = met.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def _labels(marked: DataFrame, bits: int, bucket: int) -> DataFrame:
    """``(fp, root, component_id)`` of each fingerprint of ``(doc_id, fp)``: its group, and the group's smallest doc_id."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = materialize(connected_components(links(distinct, bits, bucket)), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(named, "root").select("fp", "root", "component_id"), "labels")


def simhash_groups(docs: DataFrame, size: int = 3, seed: int = 42, bits: int = ERRORS, bucket: int = 256) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``, with the smallest doc_id it is linked to.

    Null or wordless texts have fingerprint zero and are linked like any other; so are repeated rows. A
    null doc_id keeps its row and never is a group's smallest id, unless no row of the group has one.
    Other columns of ``docs`` are ignored. Empty input gives no rows.
    """
    marked = materialize(fingerprints(docs, size, seed), "fingerprints")
    return marked.join(_labels(marked, bits, bucket), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, bits: int = ERRORS, bucket: int = 256) -> DataFrame:
    """One row of ``docs`` of each group: that of the smallest doc_id, null ones last, then of the smallest hash of the row.

    The group goes by a row's own text, so rows of other groups stay, whatever ids are null or repeated.
    """
    found = docs.withColumn("_row", row_hash(docs))
    marked = materialize(fingerprints(found, size, seed, ("_row",)), "fingerprints")
    rows = marked.join(_labels(marked, bits, bucket), "fp").groupBy("root", "doc_id", "_row").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row", "n")).alias("f"))
    return rows_of(docs, materialize(first.select("f._row", "f.n"), "kept-rows"))
