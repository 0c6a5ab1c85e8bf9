"""Documents cut to pieces of at most a sequence's tokens, and pieces packed by the sum-of-squares rule.

The rule keeps, for every residual gap, the number of open bins that have it, and puts a piece where the sum
of the squares of those numbers becomes smallest; of equal places the smallest gap is taken. A bin is opened
only for a piece that fits in none. Pieces come longest first, as the whole set is known beforehand.

The rule is sequential, so it runs inside shards: pieces are dealt by a hash of their row number to shards of about
``SHARD`` pieces, which Spark spreads and sorts. A shard of the default size leaves some three sequences more than
its tokens need, whatever the number of shards. Pieces that fill a sequence need no bin and aren't shuffled. A task
holds one number and one list of bins per gap, never its pieces.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, fresh, materialize, only
from .tokenfiles import WordEncoder, parts_of

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that are packed together.
SHARD = 1 << 16

#: Anything but single spaces and line ends as white space: there, a match of the byte-level pattern may hold a space or line end.
_UNEVEN = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_WIDE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
#: A space beside a word, which ends a match in any text; the space belongs to what follows.
_BOUNDARY = re.compile(r"(?<=\S) | (?=\S)")
#: Before a piece that has no space before it; no UTF-8 text has this byte.
_BARE = b"\xff"
_MARKS = string.punctuation.replace("'", "")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SpacedEncoder(WordEncoder):
    """Ids of texts by a byte-level file of the ``tokenizers`` library, whose pattern ends every match at a space before or after a word.

    A text is cut at such spaces, and around single line ends; what lies between, with the space before it, is encoded
    once and remembered. A word of Latin letters, and marks after it, are matches of the pattern for sure and
    go to the library's merges at once; anything else takes the library's whole way.
    """

    def __init__(self, content: str, width: int, special: bool = True) -> None:
        super().__init__(content, width, special)
        kind = json.loads(content)
        before = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer with the plain pattern")
        self.newline, self.letters = np.array(self._ids("\n"), np.uint32), _byte_letters()
        self.merge, self.code = self.tokenizer.model.tokenize, "I" if width == 4 else "H"

    def _words(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        if any(x in text for x in _UNEVEN) or b"\xe2\x80" in text and _WIDE.search(text):
            words = [w.encode() for w in _BOUNDARY.split(text.decode("utf-8", "replace"))]
        else:
            words = text.replace(b"\n", b" \xff\n \xff").split(b" ")
        words[0] = _BARE + words[0]
        return words

    def _merged(self, word: bytes) -> bytes | None:
        """The ids of Latin letters and marks after them."""
        bare = word[:1] == _BARE
        s = (word[1:] if bare else word).decode("utf-8", "replace")
        letters = s.rstrip(_MARKS)
        if not letters.isalpha() or max(letters) > "\u024f":
            return None
        marks = s[len(letters) :]
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        found = self.merge(letters if bare else "\u0120" + letters)
        if marks:
            found += self.merge(marks)
        return array(self.code, [t.id for t in found]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words, those that aren't plain many in one text where line ends can stand between them."""
        merge, code = self.merge, self.code
        letters = [w for w in words if w.isalpha()]
        self._keep(letters, [array(code, [t.id for t in merge("\u0120" + w.decode())]).tobytes() for w in letters])
        words = [w for w in words if not w.isalpha()]
        ids = list(map(self._merged, words))
        self._keep([w for w, x in zip(words, ids) if x is not None], [x for x in ids if x is not None])
        spaced = [w for w, x in zip(words, ids) if x is None and w[:1] != _BARE and b"\n" not in w]
        alone = [w for w, x in zip(words, ids) if x is None and (w[:1] == _BARE or b"\n" in w)]
        size = np.dtype(self.kind).itemsize
        for i in range(0, len(spaced), 2000):
            part = spaced[i : i + 2000]
            found = np.array(self._ids((b" " + b"\n ".join(part)).decode("utf-8", "replace")), np.uint32)
            ends = np.flatnonzero(found == self.newline[0])
            if len(self.newline) > 1 or len(ends) != len(part) - 1:  # white space or a special token took a line end
                alone += part
                continue
            flat = found.astype(self.kind).tobytes()
            begin, end = np.r_[0, ends + 1] * size, np.r_[ends, len(found)] * size
            self._keep(part, [flat[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        for i in range(0, len(alone), 2000):
            part = alone[i : i + 2000]
            texts = [(w[1:] if w[:1] == _BARE else b" " + w).decode("utf-8", "replace") for w in part]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self._keep(part, [np.array(x.ids, self.kind).tobytes() for x in found])


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of every row's pieces, by a byte-level file of ``tokenizers``.

    The library is called plainly: the string of a special token is that token. ``end_id`` follows each text; null
    and empty texts have it alone. Only documents of more than ``capacity`` ids are cut, so that every piece but the
    first is full. Repeated rows and null doc_ids are documents of their own; other columns are ignored; an
    empty table has no pieces.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = SpacedEncoder.of_worker(shared.value, 4, True)
        for batch in batches:
            texts = [t or b"" for t in binary_rows(batch["text"])]
            for part in parts_of(texts):
                rows: list[tuple] = []
                for doc, ids in zip(batch["doc_id"][part].to_pylist(), encode(texts[part])):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    begins = [0, *range(first, n, capacity)]
                    rows += [(doc, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(begins, [*begins[1:], n]))]
                yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, map(list, zip(*rows)))), schema=PIECES)

    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Bins:
    """Open bins of one shard by their residual gap."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece: a bin of gap g leaves n(g) and, unless it is full then, joins n(g - length)."""
        have = self.count[length:]
        at = np.flatnonzero(have)
        if len(at):
            change = 2 * (self.count[at] - have[at]) + 2
            if at[0] == 0:
                change[0] = 1 - 2 * have[0]
            gap = length + int(at[change.argmin()])
            found = self.of_gap[gap].pop()
            self.count[gap] -= 1
        else:
            gap, found = self.capacity, self.used
            self.used += 1
        if gap > length:
            self.count[gap - length] += 1
            self.of_gap[gap - length].append(found)
        return found, self.capacity - gap


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (any table with a ``length``) with ``sequence_id`` and ``offset``; offsets in a sequence have no gaps.

    A length that is null or not in 1..``capacity`` is an error. Repeated rows are pieces of their own, other columns
    stay, an empty table stays empty. The same stored table gives the same sequences.
    """
    for name in ("sequence_id", "offset"):
        if name in pieces.columns:
            raise ValueError(f"pieces already have a column {name}")
    number, group = fresh(pieces, "_number"), fresh(pieces, "_shard")
    fits = F.col("length").between(1, capacity)
    checked = pieces.withColumn("length", F.when(fits, F.col("length")).otherwise(F.raise_error(F.lit(f"a length is not in 1..{capacity}"))))
    stored = materialize(checked.withColumn(number, F.monotonically_increasing_id()), "pieces")
    full = stored.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col(number)).withColumn("offset", F.lit(0).cast("long")).drop(number)
    rest = stored.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard))
    dealt = rest.withColumn(group, F.pmod(F.xxhash64(number), F.lit(shards)))
    columns = [c for c in dealt.columns if c not in (number, group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, Bins(capacity)
        for batch in batches:
            sequence, offset = [], []
            for s, length in zip(batch[group].to_pylist(), batch["length"].to_pylist()):
                if s != now:
                    now, bins = s, Bins(capacity)
                found, begin = bins.place(length)
                sequence.append(s << 40 | found)
                offset.append(begin)
            arrays = [batch[c] for c in columns] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    ordered = dealt.repartition(shards, group).sortWithinPartitions(group, F.desc("length"), number)
    return ordered.mapInArrow(run, full.schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` with its ids, sequence and offset: what a reader concatenates to sequences."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)


def with_crc32(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``, which need not be shuffled then."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
