"""Extensions for streams: the batch operators' semantics on data that keeps coming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.config import Hysteresis


def binned(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, mean and maximum per key and fixed window."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"))
    return w.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "peak")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Point events of a key up to ``gap`` apart as one span."""
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def hysteresis(stream: DataFrame, key: str, t: str, score: str, p: Hysteresis = Hysteresis()) -> DataFrame:
    """Runs as in ``segments.hysteresis_runs``, emitted when a sample below ``p.close`` ends them; samples come in order of ``t`` within a batch.

    The state of a key is the open run: its start and last sample.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(t)
        out = []
        for at, s in zip(rows[t], rows[score]):
            if run is None and s >= p.open:
                run = (float(at), float(at))
            elif run is not None and s >= p.close:
                run = (run[0], float(at))
            elif run is not None:
                out.append((k[0], *run))
                run = None
        state.update(run) if run is not None else (state.remove() if state.exists else None)
        yield pd.DataFrame(out, columns=[key, "start", "end"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start double, end double", "start double, end double", "append", GroupStateTimeout.NoTimeout)
