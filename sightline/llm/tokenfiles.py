"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

An id is replaced by its rank among all ids by corpus frequency, so that frequent ids are small numbers. A
number takes one to four bytes; its length less one sits in two bits of a control byte, four numbers to a
control byte, and control and data bytes lie apart. A control byte thus fixes where its four numbers' bytes
are: decoding looks 256 rows up in a table of offsets and lengths and gathers whole blocks at once.

A file is a Parquet part in ascending order of documents; a row is a block: the documents in it, how many
ids each has, and the ids' control and data bytes. The ranks are a Parquet table beside the blocks.
"""

from __future__ import annotations

import itertools
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_rows, materialize, only, shared_dir

#: Ids in a block, unless a single document has more.
BLOCK = 1 << 16
#: Bytes of words and ids that a worker remembers in a generation; with the generation before, at most twice that.
REMEMBERED = 96 << 20
#: What a remembered word takes besides its own bytes and those of its ids.
_ENTRY = 200
#: Types of ids by bytes.
KINDS = {2: "<u2", 4: "<u4"}

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_STARTS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers; a last incomplete control byte is filled with zeros of one byte each, left out of the data."""
    x = np.ascontiguousarray(numbers, np.uint32)
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    codes = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    codes[: len(x)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = x.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse of ``encode_numbers``, by table lookup."""
    c = np.frombuffer(control, np.uint8)
    begin = np.cumsum(_TOTALS[c]) - _TOTALS[c]
    at = (begin[:, None] + _STARTS[c]).ravel()[:count]
    size = _LENGTHS[c].ravel()[:count]
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)[at].copy().view("<u4").ravel() if count else np.empty(0, np.uint32)
    return words & _MASKS[size]


#: A private-use character, put between words that are encoded at once; words that have it are encoded alone.
_BETWEEN = "\ue000"
#: Marks that are one match of the pattern together, after letters.
_MARKS = string.punctuation.replace("'", "").encode()
#: What a worker has encoded so far, by tokenizer; later tasks of the worker go on with it.
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts from a file of the ``tokenizers`` library that treats words between ASCII white space one by one.

    The library encodes a word once; its ids are remembered, as bytes, while the word keeps occurring. Strings
    of special tokens are ordinary text, or with ``special`` those tokens, as in the library's plain call. If the
    library is known to lower-case texts, texts of ASCII alone are lower-cased before the look-up.
    """

    def __init__(self, content: str, width: int, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.known, self.older, self.held = Tokenizer.from_str(content), KINDS[width], {}, {}, 0
        self.tokenizer.encode_special_tokens = not special
        self.lower = '"Lowercase"' in content
        self.whole = self.lower and all(self._ids(w) == [t.id for t in self.tokenizer.model.tokenize(w.lower())] for w in ("a", "Zq", "Hello", "unbelievably", "xqzjkwv" * 9))
        self.cased = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.between = np.array(self._ids(_BETWEEN), np.uint32)
        # a run of ASCII letters is one match of the pattern; the library's merges alone give its ids
        self.merge, self.code = self.tokenizer.model.tokenize, "I" if width == 4 else "H"

    @classmethod
    def of_worker(cls, content: str, width: int, special: bool = False) -> WordEncoder:
        key = f"{cls.__name__}{width}{special}{hash(content)}"
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = cls(content, width, special)
        return _ENCODERS[key]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + _ENTRY * len(words)

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words: of letters alone by the merges, the others many in one text, where a mark shows where each one's ids end."""
        mark, merge, code = _BETWEEN.encode(), self.merge, self.code
        if self.whole:
            letters = [w for w in words if w.isalpha()]
            self._keep(letters, [array(code, [t.id for t in merge(w.lower().decode())]).tobytes() for w in letters])
            marked = [(w, letters) for w in words if not w.isalpha() and (letters := w.rstrip(_MARKS)).isalpha()]
            self._keep([w for w, _ in marked], [array(code, [t.id for part in (x.lower(), w[len(x) :]) for t in merge(part.decode())]).tobytes() for w, x in marked])
            words = [w for w in words if not w.rstrip(_MARKS).isalpha()]
        if marked := [w for w in words if mark in w]:
            self._keep(marked, [np.array(self._ids(w.decode("utf-8", "replace")), self.kind).tobytes() for w in marked])
            words = list(set(words).difference(marked))
        between = b" %b " % mark
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self._ids(between.join(part).decode("utf-8", "replace")), np.uint32)
            k = len(self.between)
            marks = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(ids, k) == self.between).all(axis=1)) if len(ids) >= k else np.empty(0, np.int64)
            if len(marks) != len(part) - 1:
                raise ValueError("words are not encoded one by one")
            flat, size = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
            begin, end = np.r_[0, marks + k] * size, np.r_[marks, len(ids)] * size
            self._keep(part, [flat[a:b] for a, b in zip(begin.tolist(), end.tolist())])

    def _words(self, text: bytes) -> list[bytes]:
        if self.lower and text.isascii():
            low = text.lower()
            if not any(s in low for s in self.cased):
                return low.split()
        return text.split()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        split = [self._words(t) for t in texts]
        new = set(itertools.chain.from_iterable(split)).difference(self.known)
        again = list(new.intersection(self.older))
        self._keep(again, list(map(self.older.__getitem__, again)))
        new.difference_update(again)
        if new:
            self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def parts_of(texts: list[bytes]) -> Iterator[slice]:
    """Slices of texts that hold some megabytes together, and one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held > 4 << 20:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t)
    yield slice(begin, len(texts))


def width_of(path: str) -> int:
    """Bytes that hold any id of the tokenizer at ``path``."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, path: str, end_id: int, width: int = 4, special: bool = False) -> DataFrame:
    """``(doc_id, ids)``: every row's ids with the end id, little-endian, of ``width`` bytes; a null text has the end id alone.

    Strings of special tokens in a text are ordinary text, or those tokens with ``special``.
    """
    end = np.array([end_id], KINDS[width]).tobytes()
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of_worker(shared.value, width, special)
        for batch in batches:
            texts = [t or b"" for t in binary_rows(batch["text"])]
            for part in parts_of(texts):
                ids = [x + end for x in encode(texts[part])]
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"][part], "ids": ids}, schema=IDS)

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary")


def frequency_ranks(ids: DataFrame, width: int = 4) -> np.ndarray:
    """Ids by falling frequency over all documents, equal ones by id. As long as the vocabulary that occurs, which bounds what comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                found = np.bincount(np.frombuffer(b"".join(batch["ids"].slice(i, 1000).to_pylist()), KINDS[width]))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]})

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


BLOCKS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
BLOCKS_SQL = "file long, block long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write_token_files(ids: DataFrame, path: str, width: int = 4) -> None:
    """Write ``(doc_id, ids)`` at ``path`` in ascending order of doc_id (null first): part n of ``blocks`` goes before part n+1."""
    spark = ids.sparkSession
    by_rank = frequency_ranks(ids, width)
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank.tolist())], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, docs, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def ended() -> pa.RecordBatch:
            control, data = encode_numbers(shared.value[np.frombuffer(b"".join(held), KINDS[width])])
            return pa.RecordBatch.from_pydict({"file": [file], "block": [block], "doc_ids": [docs], "counts": [[len(x) // width for x in held]], "control": [control], "data": [data]}, schema=BLOCKS)

        for batch in batches:
            for doc, x in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                if held and n + len(x) // width > BLOCK:
                    yield ended()
                    block, docs, held, n = block + 1, [], [], 0
                docs.append(doc)
                held.append(x)
                n += len(x) // width
        if held:
            yield ended()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    ordered.mapInArrow(run, BLOCKS_SQL).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian 32-bit) of every document of the files at ``path``."""
    by_rank = np.array([r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks")
    sizes = blocks.select("file", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inside = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("inside"))
    offsets = inside.join(before, "file").select("file", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[k].to_pylist() for k in ("start", "doc_ids", "counts", "control", "data")]
            for start, docs, counts, control, data in zip(*columns):
                ids = shared.value[decode_numbers(control, data, sum(counts))].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                begins = ends - counts
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": docs, "start": start + begins, "n_tokens": counts, "ids": [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]},
                    schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]),
                )

    return blocks.join(offsets, ["file", "block"]).select("start", "doc_ids", "counts", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def to_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Tokenize ``docs`` with the ``tokenizers`` file ``tokenizer`` and write token files; returns where (the shared folder by default).

    The library is called plainly: the string of a special token in a text is that token. Every row is a
    document, repeated ones too; null and empty texts hold the end id alone. An empty table gives files without
    documents. Other columns are ignored.
    """
    import uuid

    path = path or f"{shared_dir(docs.sparkSession)}/sightline/tokens-{uuid.uuid4().hex}"
    width = width_of(tokenizer)
    write_token_files(materialize(tokenize(docs, tokenizer, end_id, width, special=True), "ids"), path, width)
    return path


def with_crc32(files: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``."""
    return files.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
