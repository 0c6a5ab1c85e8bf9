"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.shared import shared_dir

#: A word: a run of anything but the six ASCII white-space characters (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sightline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; nothing may be read from them afterwards."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if path.getParent().getName() == "sightline":
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(n) for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, prolonged until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_bytes(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of the texts that hold up to about ``most`` bytes together, and one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > most:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if texts:
        yield texts[begin:]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, nulls told from other columns' nulls."""
    return F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns])


def rows_of(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` with a hash in ``kept`` (``_row``, and ``n``, how many rows have it), one of each."""
    row = fresh(df, "_row")
    kept = kept.withColumnRenamed("_row", row)
    found = df.withColumn(row, row_hash(df))
    single = found.join(kept.where("n = 1"), row, "left_semi")
    repeated = found.join(kept.where("n > 1"), row, "left_semi").dropDuplicates([row])
    return single.union(repeated).drop(row)


def binary_rows(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def stream_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 0) -> Iterator[pa.Table]:
    """Runs of equal keys of a partition that is sorted by ``keys``; whole runs only, one table each.

    With ``rows``, consecutive whole runs are handed over together until they hold that many rows.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if not len(starts):
            held = table.to_batches()
            continue
        if rows:
            yield table.slice(0, starts[-1])
        else:
            for a, b in zip(np.r_[0, starts[:-1]], starts):
                yield table.slice(a, b - a)
        held = table.slice(starts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for the undirected edges ``(a, b)`` of longs; root is the smallest node of the component.

    Alternating large-star and small-star rounds, each one aggregate and one join, so that a node with
    very many neighbours is combined before the shuffle and split by adaptive execution after it. Every
    round ends in a table of the shared folder. Loops and repeated edges are allowed; nodes without an
    edge to another node don't appear. Empty input gives an empty result.
    """
    e = materialize(_oriented(edges), "edges")
    seen = _digest(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        e = materialize(_small_star(_large_star(e)), "edges")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger end first, no loops, each edge once."""
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _digest(e: DataFrame) -> tuple[int, int]:
    n, s = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(s or 0)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps it beside the executor's heap otherwise."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, that gives memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def per_batch(f: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` from one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(f(batch), schema=schema)

    return giving_back(run)
