"""Recordings as files: what Spark's binary reader tells of them, and their fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at either end that a fingerprint covers.
EDGE = 1 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, mtime`` below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def digest(content: bytes, size: int) -> str:
    h = hashlib.blake2b(str(size).encode(), digest_size=16)
    h.update(content[:EDGE])
    if size > 2 * EDGE:
        h.update(content[-EDGE:])
    return h.hexdigest()


def _digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, size in batches:
        yield pd.Series([digest(c, n) for c, n in zip(content, size)])


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, mtime, fingerprint``; files stay below 2 GB, which is what the reader takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.pandas_udf(_digests, "string")("content", "length").alias("fingerprint"))
