"""Token counts of flat, unindexed token files by a separator scan.

A file is nothing but ids, each document's followed by the end id; it is read in blocks that know nothing of
documents. A block is searched for the end id at once. What a document has in other blocks follows from a
prefix scan over the blocks of a file: how many ids come before a block, and where the last end before it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .tokenfiles import KINDS

#: Bytes of a block.
BLOCK = 1 << 20
BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("payload", pa.binary()), ("names", pa.list_(pa.int64()))])
BLOCKS_SQL = "file string, block long, payload binary, names array<long>"


def write_flat(ids: DataFrame, path: str, width: int = 2, block: int = BLOCK) -> None:
    """Write ``(doc_id, ids)`` (little-endian, of ``width`` bytes, the end id included) as flat token files.

    Each task writes a file, in blocks of ``block`` bytes that cut documents anywhere. Beside a block stand,
    unread by the scan, the doc_ids of the documents that end in it.
    """
    if block % width:
        raise ValueError("a block has whole ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, n, held, names = f"{TaskContext.get().partitionId():08d}", 0, bytearray(), []

        def row(payload: bytes, ended: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [file], "block": [n], "payload": [payload], "names": [ended]}, schema=BLOCKS)

        for batch in batches:
            for doc, x in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                held += x
                while len(held) > block:
                    yield row(bytes(held[:block]), names)
                    del held[:block]
                    n, names = n + 1, []
                names.append(doc)
        if held:
            yield row(bytes(held), names)

    ids.mapInArrow(run, BLOCKS_SQL).write.option("compression", "zstd").parquet(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Blocks that ``write_flat`` wrote."""
    return spark.read.schema(BLOCKS_SQL).parquet(path)


def read_raw(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks ``file, block, payload`` of raw binary token files; Spark reads a file at a time, so files stay below 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                for n, at in enumerate(range(0, len(content), block)):
                    yield pa.RecordBatch.from_pydict({"file": [file], "block": [n], "payload": [content[at : at + block]]}, schema=pa.schema(list(BLOCKS)[:3]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, payload binary")


FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])


def find_ends(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """``file, block, n, ends``: ids in a block and where the end ids are."""
    kind = KINDS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(p or b"", kind) for p in batch["payload"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"file": batch["file"], "block": batch["block"], "n": [len(x) for x in ids], "ends": [np.flatnonzero(x == end_id) for x in ids]}, schema=FOUND)

    return blocks.select("file", "block", "payload").mapInArrow(run, "file string, block long, n long, ends array<long>")


def scan(found: DataFrame) -> DataFrame:
    """Documents of ``find_ends``: ``file, block, at, start, n_tokens, ended``.

    ``at`` is the document's number among those that end in the block, ``start`` its first id's place in the
    file, ``n_tokens`` its ids without the end id. Ids after a file's last end id are a document that isn't
    ``ended``. Empty files have no documents.
    """
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = placed.withColumn("after", F.col("first") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1) + 1)
    placed = placed.withColumn("open", F.coalesce(F.max("after").over(earlier), F.lit(0)))
    each = placed.select("file", "block", "first", "open", "ends", F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("open")).otherwise(F.col("first") + F.get("ends", F.col("at") - 1) + 1)
    ended = each.select("file", "block", "at", start.alias("start"), (F.col("first") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = placed.groupBy("file").agg(F.max("block").alias("block"), F.sum("n").alias("n"), F.coalesce(F.max("after"), F.lit(0)).alias("start")).where("n > start")
    return ended.unionByName(rest.select("file", "block", F.lit(-1).alias("at"), "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def count_tokens(ids: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """``doc_id, file, start, n_tokens`` of ``(doc_id, ids)``, from flat files written to the shared folder and scanned.

    Repeated rows are documents of their own; a document without ids but the end has none. No rows, no result.
    """
    path = f"{shared_dir(ids.sparkSession)}/sightline/flat-{uuid.uuid4().hex}"
    write_flat(ids, path, width)
    blocks = read_flat(ids.sparkSession, path)
    names = blocks.select("file", "block", F.posexplode("names").alias("at", "doc_id"))
    return scan(find_ends(blocks, end_id, width)).join(names, ["file", "block", "at"]).select("doc_id", "file", "start", "n_tokens")
