"""Mixing sources to token targets by entropy balancing.

Each document gets a rate, the expected number of its copies. Among all rates that give every source its
target of tokens and stay within ``most`` copies, those nearest to one copy each are chosen, nearness being
the relative entropy of the tokens. They're the base rate tilted exponentially by the multipliers of the
document's constraints, cut at ``most``; the multipliers minimise a convex dual, which Newton steps solve.
A step is one aggregate over all documents: tokens taken and their slope by constraint. Only these sums, a
row for each source (and each pair of constraints that meet), come to the driver.

Rates become whole copies: the whole part, and one more for the documents whose hash, less the rate's
fraction, lies below their source's threshold. Histograms of the hash settle the thresholds, so that a
source's copies hold its target to within one document; what is left is given to documents that fit in it.
Repeated rows share a hash, so a threshold takes all of them or none: where that leaves a gap, some of the
equal rows at the edge get one more copy, told apart by numbers that are counted per partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

#: Most sources, or values of a further constraint, that a mix may have; their sums are held on the driver.
MOST_VALUES = 100_000
#: Most combinations of values of several constraints; an iteration's sums of each come to the driver.
MOST_CELLS = 1_000_000
#: Bits of the threshold that a source's documents are held against, and most sums that settle some of them at once.
BITS = 30
MOST_SUMS = 1 << 18


@dataclass(frozen=True)
class Target:
    """A source's size and what the mix is to take from it, in tokens."""

    source: str | None
    size: int
    target: float


def water_fill(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float) -> list[Target]:
    """Targets by weight for ``share`` of all tokens.

    Sources are ordered by code point, null last, and weighed by ``weights``, repeating. A target stops at
    ``most`` times its source's size; the excess is shared by weight among the others until none is above.
    A ``share`` beyond ``most`` leaves every target at its stop.
    """
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return [Target(s, sizes[s], float(target[s])) for s in order]


def _lookup(df: DataFrame, on: str, values: list[tuple], schema: str) -> DataFrame:
    """Join a small table of the driver, null-safely; it has at most MOST_VALUES rows."""
    small = df.sparkSession.createDataFrame(values, f"_key string, {schema}")
    return df.join(F.broadcast(small), df[on].eqNullSafe(small["_key"]), "left").drop("_key")


def sized(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of the text; 0 for a null text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def _newton_step(at: np.ndarray, weight: np.ndarray, g: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The step to ``g = 0`` on the values in ``use``, by preconditioned conjugate gradients.

    The second derivative adds ``weight[c]`` at each pair of the values ``at[c]`` of cell c; only its products
    with vectors are formed. With one constraint it's a diagonal and the first iteration ends.
    """
    diagonal = np.zeros(len(g))
    for k in range(at.shape[1]):
        np.add.at(diagonal, at[:, k], weight)
    ridge = 1e-12 * max(1.0, diagonal.max(initial=0))

    def times(x: np.ndarray) -> np.ndarray:
        along, out = weight * x[at].sum(axis=1), ridge * x
        for k in range(at.shape[1]):
            np.add.at(out, at[:, k], along)
        return np.where(use, out, 0.0)

    x, r = np.zeros(len(g)), np.where(use, -g, 0.0)
    end = 1e-12 * float(np.abs(r).max(initial=0))
    z = r / (diagonal + ridge)
    p, rz = z, float(r @ z)
    for _ in range(2 * len(g) + 10):
        if np.abs(r).max(initial=0) <= end or rz <= 0:
            break
        q = times(p)
        a = rz / float(p @ q)
        x, r = x + a * p, r - a * q
        z = r / (diagonal + ridge)
        p, rz = z + (float(r @ z) / rz) * p, float(r @ z)
    return x


def solve(cells: DataFrame, constraints: dict[str, dict[str | None, float]], most: float, steps: int = 60, near: float = 1e-9) -> dict[str, dict[str | None, float]]:
    """Multipliers of ``constraints`` (column to value to target) over ``cells`` with those columns and ``size``.

    Newton on the dual: the gradient is what each value's rates take less its target, the second
    derivative the tokens of documents below ``most``, by pair of values. Steps are halved until the dual falls.
    """
    names = list(constraints)
    index = {(c, v): i for i, (c, v) in enumerate((c, v) for c in names for v in constraints[c])}
    target = np.array([constraints[c][v] for c, v in index])
    lam = np.zeros(len(index))
    reachable = target > 0
    lam[~reachable] = -700.0

    def dual(x: np.ndarray) -> tuple[float, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        df = cells
        for k, c in enumerate(names):
            df = _lookup(df, c, [(v, float(x[index[c, v]])) for v in constraints[c]], f"_l{k} double")
        tilt = sum((F.col(f"_l{k}") for k in range(len(names))), F.lit(0.0))
        cap = math.log(most)
        rate = F.exp(F.least(tilt, F.lit(cap)))
        free = tilt < cap
        rows = df.groupBy(*names).agg(
            F.sum(F.col("size") * rate).alias("t"),
            F.sum(F.when(free, F.col("size") * rate).otherwise(0.0)).alias("s"),
            F.sum(F.col("size") * F.when(free, rate).otherwise(most * (1 + tilt - cap))).alias("v"),
        ).collect()
        at = np.array([[index[c, r[c]] for c in names] for r in rows], np.int64).reshape(-1, len(names))
        t, free_sum = np.array([r["t"] for r in rows], float), np.array([r["s"] for r in rows], float)
        g = np.zeros(len(index))
        for k in range(len(names)):
            np.add.at(g, at[:, k], t)
        return sum(r["v"] for r in rows) - x @ target, g - target, (at, free_sum)

    value, g, h = dual(lam)
    for _ in range(steps):
        if np.abs(g[reachable]).max(initial=0) <= near * max(1.0, target.max(initial=0)):
            break
        step, scale = np.clip(_newton_step(*h, g, reachable), -3, 3), 1.0
        while True:
            new = dual(lam + scale * step)
            if new[0] <= value + 1e-9 * abs(value) or scale < 1e-4:
                break
            scale /= 2
        lam, (value, g, h) = lam + scale * step, new
    return {c: {v: float(lam[index[c, v]]) for v in constraints[c]} for c in names}


def _edges(coins: DataFrame, need: dict[str | None, float]) -> tuple[dict[str | None, int], dict[str | None, float]]:
    """For each source the largest edge so that the rows with ``_k`` below it hold at most ``need``, and what is then left of it.

    The edge's bits are settled a few at a time, each time by sums of the rows between the bounds so far.
    """
    step = max(3, min(12, int(math.log2(MOST_SUMS / max(1, len(need))))))
    low, left, open_ = dict.fromkeys(need, 0), dict(need), set(need)
    width = BITS
    while width and open_:
        bits = min(step, width)
        width -= bits
        bounded = _lookup(coins, "source", [(s, low[s]) for s in open_], "_low long").where((F.col("_k") >= F.col("_low")) & (F.col("_k") < F.col("_low") + (1 << (width + bits))))
        rows = bounded.groupBy("source", F.shiftright(F.col("_k") - F.col("_low"), width).alias("bin")).agg(F.sum("size").alias("n")).collect()
        bins: dict[str | None, dict[int, int]] = {s: {} for s in open_}
        for r in rows:
            bins[r["source"]][r["bin"]] = r["n"]
        for s, found in bins.items():
            for b, n in sorted(found.items()):
                if n > left[s]:
                    low[s] += b << width
                    break
                left[s] -= n
            else:
                low[s] += 1 << (width + bits)
                open_.discard(s)
    return low, left


def _joined(df: DataFrame, on: str, taken_on: list[list[tuple]]) -> DataFrame:
    for n, rows in enumerate(taken_on):
        df = _lookup(df, on, rows, f"_limit{n} double, _edge{n} long")
    return df


def _chosen(df: DataFrame, rounds: int) -> DataFrame:
    """``_more``: whether one of the rounds gives the row one copy more."""
    more = F.lit(False)
    for n in range(rounds):
        more = more | ((F.col("size") <= F.col(f"_limit{n}")) & (F.col("_k") < F.col(f"_edge{n}")))
    return df.withColumn("_more", more).drop(*[f"_{x}{n}" for n in range(rounds) for x in ("limit", "edge")])


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_number``, from 1 within each source: the number within what one task read, after the counts of the tasks before it."""
    held = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ties")
    counts = held.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("source").alias("_of"), F.col("_part").alias("_at"), (F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = held.withColumn("_within", F.row_number().over(Window.partitionBy("source", "_part").orderBy("_seq")))
    joined = within.join(before, within["source"].eqNullSafe(before["_of"]) & (within["_part"] == before["_at"]))
    return joined.withColumn("_number", F.col("_before") + F.col("_within")).drop("_part", "_seq", "_of", "_at", "_before", "_within")


def _last(rest: DataFrame, left: dict[str | None, float], taken_on: list[list[tuple]]) -> list[tuple]:
    """For each source that a gap stays in, the equal rows of ``rest`` of which some come nearest to it.

    ``(source, k, size, h, t, m)``: t of the m rows with that hash and size get one copy more. They're the rows
    whose single copy is nearest to the gap, or those at one of the edges, which a threshold had to leave out whole.
    """
    rest = _lookup(rest, "source", [(s, x) for s, x in left.items()], "_left double").where(F.col("size") > 0)
    gap = F.abs(F.col("size") - F.col("_left"))
    nearest = rest.where(gap < F.col("_left")).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), F.col("_k"))).alias("m")).select("source", "m._k").collect()
    near = {r["source"]: r["_k"] for r in nearest}
    edges = [{s: k for s, _, k in rows} for rows in taken_on]
    names = [f"_e{n}" for n in range(len(edges) + 1)]
    at = _lookup(rest, "source", [(s, *[e.get(s, -1) for e in edges], near.get(s, -1)) for s in left], ", ".join(f"{n} long" for n in names))
    equal = at.where(F.col("_k").isin(*[F.col(n) for n in names])).groupBy("source", "_k", "size", "_h", "_left").agg(F.count("*").alias("m"))
    some = equal.withColumn("t", F.least("m", F.round(F.col("_left") / F.col("size")).cast("long")))
    some = some.withColumn("gap", F.abs(F.col("_left") - F.col("t") * F.col("size"))).where((F.col("t") > 0) & (F.col("gap") < F.col("_left")))
    best = some.groupBy("source").agg(F.min(F.struct("gap", "_k", "size", "_h", "t", "m")).alias("b")).select("source", "b._k", "b.size", "b._h", "b.t", "b.m")
    return [tuple(r) for r in best.collect()]


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, further: dict[str, dict[str | None, float]] | None = None, rounds: int = 3) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``: how often the mix takes each row.

    ``docs`` has ``doc_id, text, source``; the thresholds are settled in ``rounds``, each with smaller documents. Sizes are words; a null text has none. Rows without words get as
    many copies as their source's rate rounds to. ``further`` gives targets of tokens for the values of
    other columns, which tilt the rates along with the sources. The same rows always give the same copies:
    chance comes from a hash of the row's id and text. Rows that repeat an id and a text fare alike, but for
    those of one such group at most in each source, of which some get one copy more. Columns of the names
    above are replaced; other columns stay, whatever their names. An empty table gives no rows.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    given = [c for c in docs.columns if c.lower() not in made]
    place = {c.lower(): f"c{i}" for i, c in enumerate(given)}  # the operator's own names can't be among these
    inner = docs.select(*[docs[f"`{c}`"].alias(place[c.lower()]) for c in given])
    constrained = {"source": "source"} | {f"further{k}": c for k, c in enumerate(further or {})}
    names = list(constrained)
    chance = F.shiftrightunsigned(F.xxhash64(place["doc_id"], place["text"]), 11) / F.lit(float(1 << 53))
    hashed = sized(inner, text=place["text"]).withColumn("_h", chance).withColumns({n: F.col(place[c.lower()]).cast("string") for n, c in constrained.items()})
    slim = materialize(hashed.select(*names, "size", "_h"), "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_VALUES + 1).collect()
    if len(sums) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} sources")
    targets = water_fill({r["source"]: r["n"] for r in sums}, weights, share, most)
    wanted = {t.source: t.target for t in targets}
    # rates depend on these columns alone: documents are added up once, iterations read their sums
    cells = materialize(slim.groupBy(*names).agg(F.sum("size").alias("size")), "cells")
    if further and cells.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of constrained values")
    tilt = solve(cells, {"source": wanted} | {f"further{k}": v for k, v in enumerate((further or {}).values())}, most)

    def rated(df: DataFrame) -> DataFrame:
        for k, n in enumerate(names):
            df = _lookup(df, n, list(tilt[n].items()), f"_t{k} double")
        total = sum((F.coalesce(f"_t{k}", F.lit(0.0)) for k in range(len(names))), F.lit(0.0))
        df = df.withColumn("_rate", F.exp(F.least(total, F.lit(math.log(most)))))
        whole = F.floor(F.col("_rate") + 1e-9)
        return df.drop(*[f"_t{k}" for k in range(len(names))]).withColumn("_whole", whole).withColumn("_k", F.floor((F.col("_h") - (F.col("_rate") - whole) + 1) * (1 << (BITS - 1))).cast("long"))

    # below its source's edge a document gets one copy more, but none beyond most
    coins = rated(slim).where(F.col("_whole") + 1 <= most)
    fixed = {r["source"]: float(r["n"]) for r in rated(slim).groupBy("source").agg(F.sum(F.col("size") * F.col("_whole")).alias("n")).collect()}
    left = {s: max(0.0, t - fixed[s]) for s, t in wanted.items()}
    taken_on = []
    for n in range(rounds):  # what is left goes to documents that are small enough, further up
        small = _lookup(coins, "source", [(s, x) for s, x in left.items()], "_left double").where(F.col("size") <= F.col("_left"))
        if n:
            small = _lookup(small, "source", [(s, k) for s, k in edge.items()], "_from long").where(F.col("_k") >= F.col("_from"))
        limit, before = left, edge if n else dict.fromkeys(left, 0)
        edge, left = _edges(small, left)
        edge = {s: max(k, before[s]) for s, k in edge.items()}
        taken_on.append([(s, float(limit[s]), int(edge[s])) for s in edge])

    # and at last some equal documents more, mostly one, where that comes nearer than what is left
    rest = _chosen(_joined(coins, "source", taken_on), rounds).where(~F.col("_more"))
    last = _last(rest, left, taken_on)

    info = [(t.source, t.size, t.target) for t in targets]
    out = _chosen(_joined(rated(hashed), "source", taken_on), rounds)
    out = _lookup(out, "source", last, "_last long, _last_size long, _last_h double, _some long, _all long")
    out = _lookup(out, "source", info, "source_size long, target double")
    out = out.withColumn("_picked", ~F.col("_more") & F.coalesce((F.col("_k") == F.col("_last")) & (F.col("size") == F.col("_last_size")) & (F.col("_h") == F.col("_last_h")), F.lit(False)))
    if any(t < m for *_, t, m in last):
        part = F.col("_picked") & (F.col("_some") < F.col("_all"))
        ties = _numbered(out.where(part)).withColumn("_picked", F.col("_number") <= F.col("_some")).drop("_number")
        out = out.where(~part).unionByName(ties)
    more = (F.col("_more") | F.col("_picked")) & (F.col("_whole") + 1 <= most)
    out = out.withColumn("copies", (F.col("_whole") + more.cast("int")).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*[F.col(place[c.lower()]).alias(c) for c in given], *made)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it has copies, without the mix's own columns."""
    n = fresh(mixed, "_n")
    return mixed.where("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(n, "size", "source_size", "target", "copies", "taken")
