"""Repeated passages of words by sorted windows on minimiser anchors, in place of prefix-partitioned suffix trees.

A window is ``length`` consecutive words. Windows that share a prefix are sorted and compared with their
neighbours, as the leaves of a suffix tree cut off at that depth would stand; no tree, inner node or maximal
repeat is made. Rather than a row for every word, the windows are anchored sparsely:

1. Each window chooses the ``gram``-word sequence with the smallest hash inside it as its anchor. Equal
   windows choose equal anchors, and neighbours mostly share one, so about one word in eight is an anchor.
2. Grams that occur once can't lie in a repeated window. The others' occurrences come back to their text
   and send the stretch of words that their windows cover: all suffixes with that prefix.
3. Stretches are grouped by prefix. A prefix whose group holds more than ``group`` rows is prolonged to the
   whole window, and groups of that are dealt to several tasks: each returns what repeats inside its share
   and passes on the first of each window, and these meet in a second, small tree.

Copies of whole texts are set aside first: all their windows start earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, giving_back, materialize, only, per_batch, stream_groups

LENGTH = 20
#: Words of an anchor's gram.
GRAM = 4
#: Most documents that are set aside by a broadcast join; beyond, texts are shuffled for it.
ASIDES = 500_000
#: Rows of a group that one tree holds.
GROUP = 4096
#: Bytes of text that are hashed at once.
CHUNK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base % 2**64, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Anchors:
    """Finds the anchors of texts; its tables of powers grow with the longest chunk."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word in the bytes, which begin and end with white space."""
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 2**64), len(data))
        space = _SPACE[data]
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return start, _mix((total[end] - total[start]) * self.down[start])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text number, gram hash, word position, words before it in its first window, and windows, of each anchor."""
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
        start, h = self.words(data)
        first = np.searchsorted(start, begins)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        none = (np.empty(0, np.int64),) * 5
        if len(h) < self.length:
            return none
        g = np.zeros(len(h) - self.gram + 1, np.uint64)
        for j in range(self.gram):
            g += h[j : len(g) + j] * np.uint64(pow(_BASE, 2 * j + 1, 2**64))
        value, at, span, width = _mix(g), np.arange(len(g)), 1, self.length - self.gram + 1
        grams = value
        while span < width:  # the smallest of each run of width grams, the leftmost of equal ones
            step = min(span, width - span)
            left = value[:-step] <= value[step:]
            value, at = np.where(left, value[:-step], value[step:]), np.where(left, at[:-step], at[step:])
            span += step
        whole = np.flatnonzero(of[: len(at)] == of[self.length - 1 : len(at) + self.length - 1])
        if not len(whole):
            return none
        p = at[whole]
        run = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        p, s, n = p[run], whole[run], np.diff(np.r_[run, len(p)])
        return of[p], grams[p].view(np.int64), p - first[of[p]], p - s, n


ANCHORS = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64())])


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for batch in batches:
            texts, ids, hashes = binary_rows(batch["text"]), batch["doc_id"], batch["h"]
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held < CHUNK):
                    held += len(texts[j])
                    j += 1
                of, g, p, before, n = find(texts[i:j])
                rows = pa.array(of + i)
                yield pa.RecordBatch.from_pydict({"gram": g, "doc_id": ids.take(rows), "h": hashes.take(rows), "at": p << 16 | before << 8 | n}, schema=ANCHORS)
                i = j

    return giving_back(run)


#: Roles of a row: one of a compared text, of a copy of an earlier document's text.
COMPARED, COPY = 0, 1
PACKED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("role", pa.int32()), ("packed", pa.binary())])


def _pack(batch: pa.RecordBatch) -> dict:
    """Texts shrunk for the shuffle, each with its length in front."""
    codec = pa.Codec("zstd", compression_level=1)
    packed = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in binary_rows(batch["text"])]
    return {"doc_id": batch["doc_id"], "h": batch["h"], "role": batch["role"], "packed": packed}


def _unpacked(column: pa.Array) -> Iterator[bytes | None]:
    codec = pa.Codec("zstd")
    for p in column.to_pylist():
        yield None if p is None else codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True)


STRETCH = pa.schema([("key", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("words", pa.binary()), ("shared", pa.bool_())])
STRETCH_SQL = "key long, salt long, doc_id long, h long, start long, windows int, words binary, shared boolean"


def _stretch_rows(length: int, group: int):
    """The stretch of each anchor; of one with a large group, each window, under a longer prefix and a salt."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in STRETCH.names}
        for text, role, doc, h, found in zip(_unpacked(batch["packed"]), *(batch[k].to_pylist() for k in ("role", "doc_id", "h")), batch["found"]):
            if role != COMPARED or text is None:
                continue
            words, seen = text.split(), set()
            for gram, at, n in zip(*(found.values.field(k).to_pylist() for k in ("gram", "at", "n"))):
                if at in seen:  # a repeated row of the input
                    continue
                seen.add(at)
                start, windows = (at >> 16) - (at >> 8 & 255), at & 255
                if n <= group:
                    parts = [(gram, 0, start, windows, b" ".join(words[start : start + windows + length - 1]), False)]
                else:
                    salt = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), h % 2**64) % -(-n // group)
                    parts = []
                    for s in range(start, start + windows):
                        w = b" ".join(words[s : s + length])
                        parts.append((xxhash.xxh64_intdigest(w) - 2**63, salt, s, 1, w, True))
                for key, salt, s, n_windows, w, shared in parts:
                    for k, v in zip(STRETCH.names, (key, salt, doc, h, s, n_windows, w, shared)):
                        out[k].append(v)
        return out

    return per_batch(run, STRETCH)


SPANS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("words", pa.binary())])
SPANS_SQL = "key long, doc_id long, h long, start long, windows int, words binary"


def subtree(rows: list[tuple[tuple[int, int], int, int, bytes]], length: int) -> tuple[list[tuple], list[tuple]]:
    """Of stretches ``(document, start, windows, words)``, a document being a doc_id and a hash of a text, with one prefix: the windows that start earlier elsewhere
    among them, as ``(document, start, windows)``, and the stretches that were the first with their words.

    The suffixes of the stretches are sorted, which puts the leaves of each node of their tree side by side;
    where neighbours agree in ``length`` words, they're below the same deep node.
    """
    repeated: list[tuple] = []
    first: dict[bytes, tuple] = {}
    for row in sorted(rows):
        kept = first.setdefault(row[3], row)
        if kept[:2] != row[:2]:
            repeated.append(row[:3])
    if len(first) > 1:
        leaves = []
        for doc, start, windows, words in first.values():
            cuts = [-1, *(i for i, c in enumerate(words) if c == 32), len(words)]
            leaves += [(words[cuts[i] + 1 : cuts[i + length]], doc, start + i) for i in range(windows)]
        leaves.sort()
        node = b""
        for suffix, doc, start in leaves:
            if suffix != node:
                node, at = suffix, (doc, start)
            elif (doc, start) != at:
                repeated.append((doc, start, 1))
    return repeated, list(first.values())


def _tree_rows(length: int, last: bool):
    """Repeated windows of each group of a sorted partition; from shares of larger groups, also what may repeat another share."""
    keys = ["key"] if last else ["key", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, keys, rows=20_000):
            out: dict[str, list] = {k: [] for k in SPANS.names}
            columns = table.to_pydict()
            rows = list(zip(zip(columns["doc_id"], columns["h"]), columns["start"], columns["windows"], columns["words"]))
            marks = list(zip(*(columns[k] for k in keys)))
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and marks[j] == marks[i]:
                    j += 1
                group, i, k = rows[i:j], j, i
                if last and columns["words"][k] is None:
                    found, passed = [r[:3] for r in group if r[3] is None], []
                    group = [r for r in group if r[3] is not None]
                    found += subtree(group, length)[0]
                else:
                    found, passed = subtree(group, length) if len(group) > 1 else ([], group)
                    if last or not columns["shared"][k]:
                        passed = []
                for doc, start, windows in found:
                    for name, v in zip(SPANS.names, (doc[0], *doc, start, windows, None)):
                        out[name].append(v)
                for doc, start, windows, words in passed:
                    for name, v in zip(SPANS.names, (marks[k][0], *doc, start, windows, words)):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=SPANS)

    return giving_back(run)


def keep_mask(n_words: int, spans: list[tuple[int, int]], length: int) -> np.ndarray:
    """False for each word that a window of a span ``(start, windows)`` covers."""
    edge = np.zeros(n_words + 1, np.int64)
    for start, windows in spans:
        edge[start] += 1
        edge[min(n_words, start + windows + length - 1)] -= 1
    return np.cumsum(edge)[:n_words] == 0


JUDGED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _judge(length: int, texts: bool):
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in JUDGED.names[2:]}
        for text, role, spans in zip(_unpacked(batch["packed"]), batch["role"].to_pylist(), batch["spans"].to_pylist()):
            words = (text or b"").split()
            kept, whole = words, b" ".join(words)
            if role == COPY and len(words) >= length:
                kept = []
            elif role == COMPARED and spans:
                mask = keep_mask(len(words), [(s["start"], s["windows"]) for s in spans], length)
                kept = [w for w, k in zip(words, mask.tolist()) if k]
            joined = whole if kept is words else b" ".join(kept)
            removed = len(words) - len(kept)
            for k, v in zip(out, (len(words), removed, hashlib.sha256(joined).hexdigest(), (joined if removed else text) if texts else None)):
                out[k].append(v)
        return out | {"doc_id": batch["doc_id"], "h": batch["h"], "kept_text": pa.array(out["kept_text"], pa.binary()).cast(pa.string())}

    return per_batch(run, JUDGED)


def _text_roles(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, h2)`` of the texts that aren't compared, being copies of an earlier document's."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")).where("text is not null")
    each = materialize(hashed.distinct(), "texts")
    first = each.groupBy("h", "h2").agg(F.min("doc_id").alias("first"))
    copies = each.join(materialize(first, "first-texts"), ["h", "h2"]).where(F.col("doc_id") > F.col("first"))
    return materialize(copies.select("doc_id", "h", "h2"), "asides")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, texts: bool = True, hashes: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    A word goes if a window of ``length`` words that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document. Null texts have no words. A null doc_id counts as smaller than all others.
    Rows that repeat a doc_id and text are one document and get the same result each; different texts under
    one doc_id, or without one, are documents of their own, in the order of ``xxhash64`` of the text.
    ``kept_text`` (with ``texts``) is the text itself where nothing goes, else the kept words joined by a
    space; with ``hashes``, ``text_hash`` has that hash. Other columns are ignored.
    """
    if not 0 < gram <= length <= 255:
        raise ValueError("gram <= length <= 255")
    d = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    asides = _text_roles(d)
    asides = F.broadcast(asides) if asides.count() <= ASIDES else asides
    role = F.when(F.col("copy"), COPY).otherwise(COMPARED)
    second = d.withColumn("h2", F.xxhash64(F.lit(1), "text"))
    named = second.join(asides.withColumn("copy", F.lit(True)), ["doc_id", "h", "h2"], "left").select("doc_id", "h", role.cast("int").alias("role"), "text")

    def anchors() -> DataFrame:
        compared = named.where((F.col("role") == COMPARED) & F.col("text").isNotNull()).select("doc_id", "h", "text")
        return compared.mapInArrow(_anchor_rows(length, gram), "gram long, doc_id long, h long, at long")

    # a table of its own, so that the join with it can split the share of a gram that very many documents have
    often = materialize(anchors().groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated-grams")
    found = anchors().join(often, "gram").groupBy("doc_id", "h").agg(F.collect_list(F.struct("gram", "at", "n")).alias("found"))
    # texts are shuffled once: both joins read the same exchange
    packed = named.mapInArrow(per_batch(_pack, PACKED), "doc_id long, h long, role int, packed binary").where("doc_id is not null and h is not null").repartition("doc_id", "h")
    stretches = packed.join(found, ["doc_id", "h"]).mapInArrow(_stretch_rows(length, group), STRETCH_SQL)
    shares = stretches.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_tree_rows(length, False), SPANS_SQL)
    spans = shares.repartition("key").sortWithinPartitions("key").mapInArrow(_tree_rows(length, True), SPANS_SQL)
    by_doc = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))

    judged = packed.join(by_doc, ["doc_id", "h"], "left").mapInArrow(_judge(length, texts), "doc_id long, h long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    named = judged.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63)))).withColumnRenamed("h", "text_hash")
    return named if hashes else named.drop("text_hash")
