"""Naming tracklets by their nearest gallery vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.config import Matching
from sightline.functions.vectors import dot, normalize

#: Bytes of a gallery that may be broadcast; a larger one is joined by shuffling.
BROADCAST = 32 << 20
#: Vectors of a gallery's block, and of a batch of candidates that one meets.
BLOCK, BATCH = 4096, 1 << 16
#: The candidates' key inside.
SCORED = "_by"


def same_model(column: str, model: str | None) -> Column:
    """Vectors of other weights are invisible when a model is asked for, those of unknown weights too."""
    return F.lit(True) if model is None else F.coalesce(F.col(column) == model, F.lit(False))


def gallery(examples: DataFrame, identities: DataFrame, kind: str, model: str | None = None) -> DataFrame:
    """``identity_id, name, vector`` of the confirmed examples of a kind and model."""
    own = examples.where((F.col("kind") == kind) & same_model("model", model))
    return own.join(identities.select(F.col("id").alias("identity_id"), "name"), "identity_id").select("identity_id", "name", "vector")


def _best_two(scores: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the two identities with the best vectors, and their scores; columns of an identity lie together, from ``firsts`` on."""
    per = np.maximum.reduceat(scores, firsts, axis=1)
    who, n = [], np.arange(len(per))
    for _ in range(min(2, per.shape[1])):
        best = per.argmax(axis=1)
        who.append((best, per[n, best].copy()))
        per[n, best] = -np.inf
    return np.stack([w for w, _ in who], 1), np.stack([v for _, v in who], 1)


def _scored(ids: pa.Array, vectors: pa.Array, blocks: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """``(id, _who, score)``: the best two identities of each vector in each block ``(identities in order, matrix)``."""
    for whos, gallery in blocks:
        codes = whos.dictionary_encode().indices.to_numpy()
        firsts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1]
        for i in range(0, len(vectors), 1024):
            v = vectors.slice(i, 1024)
            who, scores = _best_two(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) @ gallery.T, firsts)
            rows = pa.array(np.repeat(np.arange(i, i + len(v)), who.shape[1]))
            yield pa.RecordBatch.from_arrays([ids.take(rows), whos.take(pa.array(firsts[who].ravel())), pa.array(scores.ravel())], names=[SCORED, "_who", "score"])


def _block(table: pa.Table, row: int) -> tuple[pa.Array, np.ndarray]:
    whos, matrix = table["_whos"].combine_chunks()[row].values, table["_matrix"].combine_chunks()[row].values
    return whos, matrix.flatten().to_numpy(zero_copy_only=False).reshape(len(matrix), -1)


def matches(candidates: DataFrame, known: DataFrame, by: str = "id", p: Matching = Matching(), identity: str = "identity", most_bytes: int = BROADCAST) -> DataFrame:
    """``by, identity, score, lead, reason`` of each candidate ``(by, vector)`` against ``known (identity, vector)``.

    An identity's score is that of its best vector, so many examples don't outvote a good one. The best has
    to reach the threshold, and lead the next one (0 without one) by the margin; of equal ones the smaller identity is
    best. ``identity`` is null with a reason otherwise: also for a null vector, and without a gallery.

    Every candidate meets the whole gallery, as matrix blocks: a task multiplies a batch of candidates by a block and
    keeps the best two identities of each. A gallery of at most ``most_bytes`` is sent to the candidates; the
    blocks of a larger one are joined to batches of them.
    """
    spark, kinds = candidates.sparkSession, (dict(candidates.dtypes)[by], dict(known.dtypes)[identity])
    unit = known.select(F.col(identity).alias("_who"), normalize(F.col("vector")).alias("_known")).where("_who IS NOT NULL AND _known IS NOT NULL")
    size = unit.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("_known")), F.lit(0)).alias("bytes")).first()
    asked = candidates.select(F.col(by).alias(SCORED), normalize(F.col("vector")).alias("_v"))
    unscored = asked.where("_v IS NULL") if size.n else asked
    scored = unscored.select(SCORED, F.lit(None).cast(kinds[1]).alias("_who"), F.lit(None).cast("double").alias("score"))
    if size.n:
        # dealt by vector, so that an identity with very many has them in many blocks
        dealt = unit.withColumn("_block", F.pmod(F.xxhash64("_known"), F.lit(-(-size.n // BLOCK))))
        rows = dealt.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_who", "_known"))).alias("_rows"))
        blocks = rows.select("_block", F.transform("_rows", lambda r: r["_who"]).alias("_whos"), F.transform("_rows", lambda r: r["_known"]).alias("_matrix"))
        vectors, types = asked.where("_v IS NOT NULL"), f"{SCORED} {kinds[0]}, _who {kinds[1]}, score double"
        if size.bytes <= most_bytes:
            table = blocks.toArrow()
            shared = spark.sparkContext.broadcast([_block(table, i) for i in range(table.num_rows)])

            def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield from _scored(batch[SCORED], batch["_v"], shared.value)

            found = vectors.mapInArrow(stream, types)
        else:

            def pair(left: pa.Table, right: pa.Table) -> pa.Table:
                schema = pa.schema([(SCORED, left[SCORED].type), ("_who", right["_whos"].type.value_type), ("score", pa.float64())])
                if not left.num_rows or not right.num_rows:
                    return schema.empty_table()
                left = left.combine_chunks()
                return pa.Table.from_batches(_scored(left[SCORED].combine_chunks(), left["_v"].combine_chunks(), [_block(right, 0)]), schema)

            batches = max(1, -(-vectors.count() // BATCH))
            numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long")))
            of_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size.n // BLOCK) - 1).cast("long")))
            left = vectors.withColumn("_batch", F.pmod(F.xxhash64("_v", F.monotonically_increasing_id()), F.lit(batches))).withColumn("_block", of_blocks)
            right = blocks.withColumn("_batch", numbers)
            found = left.groupBy("_batch", "_block").cogroup(right.groupBy("_batch", "_block")).applyInArrow(pair, types)
        scored = scored.unionByName(found.groupBy(SCORED, "_who").agg(F.max("score").alias("score")))
    w = Window.partitionBy(SCORED).orderBy(F.desc_nulls_last("score"), "_who")
    top = scored.withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("score").over(w), F.lit(0.0))}).where("_n = 1")
    lead = F.col("score") - F.col("_next")
    reason = F.when(F.col("score").isNull(), "no vector" if size.n else "no gallery").when(F.col("score") < p.threshold, "below threshold").when(lead < p.margin, "too close to call")
    return top.select(F.col(SCORED).alias(by), F.when(reason.isNull(), F.col("_who")).alias(identity), "score", lead.alias("lead"), reason.alias("reason"))


def assigned(tracklets: DataFrame, embeddings: DataFrame, known: DataFrame, kind: str, p: Matching = Matching(), model: str | None = None, reassign: bool = False) -> DataFrame:
    """Matches of the tracklets that may be named: unnamed ones, with ``reassign`` also those named automatically, never by hand.

    Bodies name persons only. ``known`` has ``identity, vector``.
    """
    open_ = F.col("identity_id").isNull() | (F.lit(reassign) & (F.col("identity_source") == "auto"))
    may = tracklets.where(open_ & (F.lit(kind != "body") | (F.col("label") == "person"))).select("id")
    vectors = embeddings.where((F.col("kind") == kind) & same_model("model", model)).select(F.col("tracklet_id").alias("id"), "vector")
    return matches(vectors.join(may, "id", "left_semi"), known, "id", p)


def assign_summary(matched: DataFrame) -> DataFrame:
    named = F.col("identity").isNotNull()
    return matched.agg(
        F.count("*").alias("considered"), F.count_if(named).alias("assigned"), F.count_if(F.col("reason") == "too close to call").alias("ambiguous"), F.count_if(F.col("reason") == "below threshold").alias("below")
    )


def enrolled(examples: DataFrame, embeddings: DataFrame, tracklet_id: int, identity_id: int) -> DataFrame:
    """``examples`` with the tracklet's vectors under the identity."""
    new = embeddings.where(F.col("tracklet_id") == tracklet_id).select(F.lit(identity_id).cast("long").alias("identity_id"), "tracklet_id", "kind", "vector", "model")
    return examples.select("identity_id", "tracklet_id", "kind", "vector", "model").unionByName(new)


def orphans(identities: DataFrame, examples: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Identities with neither examples nor sightings."""
    used = examples.select("identity_id").union(tracklets.select("identity_id")).where("identity_id is not null").distinct()
    return identities.join(used, identities["id"] == used["identity_id"], "left_anti")


def unnamed(identities: DataFrame, examples: DataFrame, tracklets: DataFrame, tracklet_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables once a tracklet loses its name: its examples go, and identities that nothing is left of."""
    left = examples.where(~F.col("tracklet_id").eqNullSafe(F.lit(tracklet_id)))
    hit = F.col("id") == tracklet_id
    clear = tracklets.withColumns({c: F.when(~hit, F.col(c)) for c in ("identity_id", "identity_score", "identity_source")})
    gone = orphans(identities, left, clear)
    return identities.join(gone.select("id"), "id", "left_anti"), left, clear


def deleted(identities: DataFrame, examples: DataFrame, tracklets: DataFrame, identity_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without an identity: its examples go with it, its sightings stay without a name."""
    gone = F.col("identity_id").eqNullSafe(F.lit(identity_id))
    clear = tracklets.withColumn("_gone", gone)
    clear = clear.withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in ("identity_id", "identity_score", "identity_source")}).drop("_gone")
    return identities.where(F.col("id") != identity_id), examples.where(~gone), clear


def people(identities: DataFrame, examples: DataFrame, tracklets: DataFrame) -> DataFrame:
    """``id, name, n_examples, n_sightings`` of every identity."""
    a = examples.groupBy("identity_id").agg(F.count("*").alias("n_examples"))
    b = tracklets.groupBy("identity_id").agg(F.count("*").alias("n_sightings"))
    i = identities.select(F.col("id").alias("identity_id"), "name")
    j = i.join(a, "identity_id", "left").join(b, "identity_id", "left").fillna(0, ["n_examples", "n_sightings"])
    return j.select(F.col("identity_id").alias("id"), "name", "n_examples", "n_sightings").orderBy("name", "id")
