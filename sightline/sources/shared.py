"""The folder that driver and executors share, and folders in it that are made once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sightline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def made_once(spark: SparkSession, path: str, make: Callable[[str], None]) -> str:
    """``path``, which ``make`` fills if it isn't there yet: at another place first, so that a folder is whole or absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        other = f"{path}-{uuid.uuid4().hex}"
        make(other)
        if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(other), at) and not files.exists(at):
            raise OSError(f"{other} can't be renamed to {path}")
    return path


def stamp(df: DataFrame) -> str:
    """A name for the present content of the files behind ``df``: it changes with a file's path, size or time."""
    parts = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, s = parts.select(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
    return f"{n}-{s or 0}"
