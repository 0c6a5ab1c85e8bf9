"""A run over many files in stages: what fails becomes a row, and a later run does only what is left.

A stage is a function from the files that are due and the tables of earlier stages to rows; rows with an ``error`` mark
their file as failed in that stage. Rows and a log are appended to Parquet tables below one path. A file is due in
a stage when all stages before it have done it and this one hasn't; failed files are therefore tried again by the
next run, and rows of a run that was cut off before it was logged are ignored.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.shared import made_once


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()


def attempted(rows: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on the rows of each file; where it raises, one row with the file's key and the ``error``, and nulls."""
    names = [c.split(":")[0].split()[0] for c in schema.split(",")] + ["error"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return f(pdf).assign(error=None).reindex(columns=names)
        except Exception as e:  # one bad file must not stop the run: its row tells what happened
            note = traceback.format_exception_only(e)[-1].strip()
            return pd.DataFrame({key: [pdf[key].iloc[0]], "error": [note]}).reindex(columns=names)

    return rows.groupBy(key).applyInPandas(run, f"{schema}, error string")


class Import:
    """The stages of an import whose tables lie at ``path``; files are told apart by ``key``, of Spark's type ``kind``."""

    def __init__(self, path: str, key: str, kind: str, stages: list[Stage]) -> None:
        self.path, self.key, self.kind, self.stages = path, key, kind, {}
        left = list(stages)
        while left:
            ready = next((s for s in left if all(a in self.stages for a in s.after)), None)
            if ready is None:
                raise ValueError(f"stages wait for each other or for none: {', '.join(s.name for s in left)}")
            self.stages[ready.name] = ready
            left.remove(ready)

    def _log(self, spark: SparkSession) -> DataFrame:
        schema = f"`{self.key}` {self.kind}, stage string, status string, note string, n long, turn int"
        made_once(spark, f"{self.path}/log", lambda at: spark.createDataFrame([], schema).coalesce(1).write.parquet(at))
        return spark.read.schema(schema).parquet(f"{self.path}/log")

    def statuses(self, spark: SparkSession) -> DataFrame:
        """``key, stage, status, note, n, turn`` of the last try of each file in each stage."""
        last = F.max_by(F.struct("status", "note", "n", "turn"), "turn").alias("_l")
        return self._log(spark).groupBy(self.key, "stage").agg(last).select(self.key, "stage", "_l.*")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows of a stage's files that are done."""
        done = self.statuses(spark).where((F.col("stage") == name) & (F.col("status") == "done")).select(self.key, F.col("turn").alias("_turn"))
        rows = spark.read.parquet(f"{self.path}/{name}").where("error IS NULL")
        return rows.join(done, [self.key, "_turn"], "left_semi").drop("_turn", "error")

    def run(self, files: DataFrame) -> None:
        """Each stage once, over the files that are due in it. A table that a stage needs is its predecessors' alone."""
        spark = files.sparkSession
        turn = 1 + (self._log(spark).agg(F.max("turn")).first()[0] or 0)
        for stage in self.stages.values():
            done = self.statuses(spark).where("status = 'done'")
            of = lambda name: done.where(F.col("stage") == name).select(self.key)  # noqa: E731, B023
            due = files
            for earlier in stage.after:
                due = due.join(of(earlier), self.key, "left_semi")
            due = due.join(of(stage.name), self.key, "left_anti")
            rows = stage.run(due, {name: self.table(spark, name) for name in stage.after})
            rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
            rows.withColumn("_turn", F.lit(turn)).write.mode("append").parquet(f"{self.path}/{stage.name}")
            written = spark.read.parquet(f"{self.path}/{stage.name}").where(F.col("_turn") == turn)
            told = written.groupBy(self.key).agg(F.count_if(F.col("error").isNull()).alias("_n"), F.min("error").alias("note"))
            status = F.when(F.col("note").isNull(), "done").otherwise("failed")
            log = due.select(self.key).distinct().join(told, self.key, "left").select(self.key, F.lit(stage.name).alias("stage"), status.alias("status"), "note", F.coalesce("_n", F.lit(0)).cast("long").alias("n"), F.lit(turn).alias("turn"))
            log.write.mode("append").parquet(f"{self.path}/log")

    def summary(self, files: DataFrame, samples: int = 5) -> DataFrame:
        """``stage, done, failed, waiting, rows, notes`` of every stage: files by state, rows of those done, some of the failures' notes."""
        spark = files.sparkSession
        every = spark.createDataFrame([(i, n) for i, n in enumerate(self.stages)], "_i int, stage string")
        known = self.statuses(spark).join(files.select(self.key).distinct(), self.key, "left_semi")
        ok, bad = F.col("status") == "done", F.col("status") == "failed"
        counts = known.groupBy("stage").agg(F.count_if(ok).alias("done"), F.count_if(bad).alias("failed"), F.sum(F.when(ok, F.col("n"))).alias("rows"))
        notes = known.where(bad).groupBy("stage", "note").agg(F.count("*").alias("_c"))
        first = notes.groupBy("stage").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_c")).alias("c"), "note"))), 1, samples).alias("_s"))
        joined = every.join(F.broadcast(counts), "stage", "left").join(F.broadcast(first), "stage", "left").crossJoin(F.broadcast(files.agg(F.count_distinct(self.key).alias("_all"))))  # a row per stage
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        shown = joined.orderBy("_i").select("stage", zero("done").alias("done"), zero("failed").alias("failed"), (F.col("_all") - zero("done") - zero("failed")).alias("waiting"), zero("rows").alias("rows"), F.coalesce(F.transform("_s", lambda s: s["note"]), F.array().cast("array<string>")).alias("notes"))
        return shown


def speech_summary(videos: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of what transcription gave: ``videos (id, has_audio)``, all utterances and those that the speech gate let through.

    A video without utterances is silent; one of which none was clear enough is unclear.
    """
    n = raw.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("_raw"))
    k = kept.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("_kept"), F.sum(F.col("t_end") - F.col("t_start")).alias("_s"))
    j = videos.join(n, "id", "left").join(k, "id", "left").fillna(0, ["_raw", "_kept", "_s"])
    heard = F.coalesce(F.col("has_audio"), F.lit(False))
    return j.agg(
        F.count_if(heard & (F.col("_kept") > 0)).alias("videos"), F.coalesce(F.sum(F.when(heard, F.col("_kept"))), F.lit(0)).alias("utterances"), F.round(F.coalesce(F.sum(F.when(heard, F.col("_s"))), F.lit(0.0)), 1).alias("seconds_of_speech"),
        F.count_if(~heard).alias("skipped_no_audio"), F.count_if(heard & (F.col("_raw") == 0)).alias("skipped_silent"), F.count_if(heard & (F.col("_raw") > 0) & (F.col("_kept") == 0)).alias("skipped_unclear"),
        F.coalesce(F.sum(F.when(heard, F.col("_raw") - F.col("_kept"))), F.lit(0)).alias("discarded"),
    )


def caption_summary(tries: DataFrame) -> DataFrame:
    """One row of ``tries (crop, caption, error)``: a null crop was too small, an error or an empty caption failed."""
    small, bad = F.col("crop").isNull(), F.col("error").isNotNull() | (F.trim(F.coalesce("caption", F.lit(""))) == "")
    return tries.agg(F.count("*").alias("considered"), F.count_if(~small & ~bad).alias("captioned"), F.count_if(small).alias("skipped_small"), F.count_if(~small & bad).alias("failed"))


def analysis_summary(results: DataFrame, tracklets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of ``results (video_id, status, frames)``, and ``label, n`` of the tracklets of analysed videos, the most frequent first."""
    done = results.where("status = 'analyzed'").select("video_id")
    own = tracklets.join(done, "video_id", "left_semi")
    counts = results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("analyzed", "skipped", "failed")], F.coalesce(F.sum(F.when(F.col("status") == "analyzed", F.col("frames"))), F.lit(0)).alias("frames"))
    both = counts.crossJoin(F.broadcast(own.agg(F.count("*").alias("tracklets"))))  # one row each
    return both, own.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
