"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Texts are lower-cased (A-Z), cut into windows of ``window`` bytes and padded with zero bytes. Filters of
several widths slide over the bytes of a window; each filter's largest response over the window, cut at
zero, feeds a softmax over the languages. A filter of width w is w tables of 256 rows, so a response is a
sum of looked-up rows; for prediction neighbouring bytes are looked up together. A document's score for a
language is the mean of its windows' probabilities, weighted by their bytes, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, by_bytes, fresh, only

UNKNOWN = "und"
#: Bytes of texts that are predicted together, unless one text has more.
CHUNK = 1 << 21


@dataclass(frozen=True)
class Params:
    """``per_language`` bounds the labelled documents of a language that are learned from, ``documents`` those
    of all languages together, which share it evenly; ``per_document`` bounds the windows of a document."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    per_language: int = 500
    per_document: int = 4
    documents: int = 100_000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    """``tables[i]`` has the shape (width, 256, filters); byte 0, the padding, gives nothing."""

    params: Params
    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def windows_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts as rows, the text of each and the bytes in each; an empty text has none."""
    n = np.array([-(-len(t) // size) for t in texts], np.int64)
    data = b"".join(t.lower().ljust(k * size, b"\0") for t, k in zip(texts, n.tolist()))
    rows = np.frombuffer(data, np.uint8).reshape(-1, size)
    held = np.full(len(rows), size, np.int64)
    last = np.cumsum(n)[n > 0] - 1
    held[last] -= (n * size - np.array([len(t) for t in texts]))[n > 0]
    return rows, np.repeat(np.arange(len(texts)), n), held


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], params: Params = Params()) -> Model:
    """Adam on the cross entropy; only the position of each filter's largest response gets a gradient."""
    rng = np.random.default_rng(params.seed)
    f, total = params.filters, params.filters * len(params.widths)
    tables = [rng.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in params.widths]
    for t in tables:
        t[:, 0] = 0
    m = Model(params, names, tables, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    held = [*m.tables, m.bias, m.dense, m.offset]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(params.epochs if len(windows) else 0):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), params.batch):
            x, y = windows[order[i : i + params.batch]], labels[order[i : i + params.batch]]
            rows, best, at = np.arange(len(x)), [], []
            for t, w in zip(m.tables, params.widths):
                r = sum(t[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w))
                at.append(r.argmax(axis=1))
                best.append(np.take_along_axis(r, at[-1][:, None, :], 1)[:, 0])
            z = np.concatenate(best, axis=1) + m.bias
            h = np.maximum(z, 0)
            d = _softmax(h @ m.dense + m.offset)
            d[rows, y] -= 1
            d /= len(x)
            back = (d @ m.dense.T) * (z > 0)
            grads = []
            for j, (t, w) in enumerate(zip(m.tables, params.widths)):
                g, own = np.zeros_like(t), back[:, j * f : (j + 1) * f]
                for k in range(w):
                    np.add.at(g[k], (x[rows[:, None], at[j] + k], np.arange(f)[None, :]), own)
                    g[k, 0] = 0
                grads.append(g)
            grads += [back.sum(axis=0), h.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, a, b in zip(held, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= params.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


class Predictor:
    """Applies a model; widths are looked up two bytes at a time."""

    def __init__(self, model: Model) -> None:
        self.m, self.pairs = model, []
        for t in model.tables:
            w = len(t)
            self.pairs.append([(k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, w - 1, 2)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.m.labels)), np.float32)
        for i in range(0, len(x), 64):
            b = x[i : i + 64]
            two = b[:, :-1].astype(np.int32) << 8 | b[:, 1:]
            best = []
            for t, pairs in zip(self.m.tables, self.pairs):
                w = len(t)
                span = b.shape[1] - w + 1
                r = None
                for k, pair in pairs:
                    v = pair.take(two[:, k : k + span], axis=0)
                    r = v if r is None else np.add(r, v, out=r)
                if w % 2:
                    v = t[w - 1].take(b[:, w - 1 : w - 1 + span], axis=0)
                    r = v if r is None else np.add(r, v, out=r)
                best.append(r.max(axis=1))
            h = np.maximum(np.concatenate(best, axis=1) + self.m.bias, 0)
            out[i : i + 64] = _softmax(h @ self.m.dense + self.m.offset)
        return out

    def __call__(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, and its score; ``und`` and 0 for an empty text."""
        x, of, held = windows_of(texts, self.m.params.window)
        total = np.zeros((len(texts), len(self.m.labels)))
        if len(x):
            p = self.probabilities(x) * held[:, None]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[start]] = np.add.reduceat(p, start, axis=0) / np.add.reduceat(held, start)[:, None]
        best = total.argmax(axis=1)
        score = np.clip(total[np.arange(len(texts)), best], 0, 1)
        return [self.m.labels[b] if t else UNKNOWN for b, t in zip(best, texts)], np.where([bool(t) for t in texts], score, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4: those documents are never learned from. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, params: Params = Params()) -> Model | None:
    """Learn from ``text`` and ``lang`` of documents that aren't held out; None where there is nothing to learn from.

    Every language that has a text of a byte is learned. Rows that repeat an id and its text count as one. At most
    ``per_language`` of each, those with the smallest hash of id and text, and at most ``per_document`` windows
    of each, spread over its whole text, come to the driver; the limit on the hash is set by how many distinct
    ones a language has. More languages than ``documents`` are an error, none is left out.
    """
    usable = F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out()
    known = docs.where(usable).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # a rough count does: limits let through half as many again, and a hundred more
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).limit(params.documents + 1).collect()
    if not counts:
        return None
    if len(counts) > params.documents:
        raise ValueError(f"over {params.documents} languages: raise Params.documents")
    each = min(params.per_language, params.documents // len(counts))
    names = sorted(r["lang"] for r in counts)
    share = {r["lang"]: min(1.0, 1.5 * each / r["n"] + 100 / r["n"]) for r in counts}
    limits = docs.sparkSession.createDataFrame([(n, min(int(share[n] * 2**64) - 2**63, 2**63 - 1)) for n in names], "lang string, most long")
    near = known.join(F.broadcast(limits), "lang").where("h <= most").select("lang", "text", "h")
    size, most = params.window, params.per_document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "h": [], "part": []}
            for lang, text, h in zip(batch["lang"].to_pylist(), binary_rows(batch["text"]), batch["h"].to_pylist()):
                n = -(-len(text) // size)
                for k in sorted({i * n // most for i in range(most)}) if n else ():
                    for name, v in zip(out, (lang, h, text[k * size : (k + 1) * size])):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("part", pa.binary())]))

    windows = near.mapInArrow(cut, "lang string, h long, part binary").distinct()
    rows = sorted((r["lang"], r["h"], bytes(r["part"])) for r in windows.collect())
    parts, labels, taken = [], [], {n: set() for n in names}
    for lang, h, part in rows:
        if h in taken[lang] or len(taken[lang]) < each:
            taken[lang].add(h)
            parts.append(part)
            labels.append(names.index(lang))
    return train(windows_of(parts, size)[0], np.array(labels, np.int64), names, params)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from nothing but the text.

    ``und`` and score 0 where the text is null or has no letter, or without a model. Columns of these names
    are replaced; other columns stay.
    """
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    of = _iterated(model, "lang_pred string, score double")
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).otherwise(F.lit(""))
    docs = docs.drop("lang_pred", "score")
    p = fresh(docs, "predicted")
    return docs.withColumn(p, of(lettered)).select("*", f"{p}.lang_pred", f"{p}.score").drop(p)


def _iterated(model: Model, schema: str):
    from collections.abc import Iterator as It

    import pandas as pd

    def run(batches: It[pd.Series]) -> It[pd.DataFrame]:
        apply = Predictor(model)
        for texts in batches:
            names, scores = [], []
            for part in by_bytes([t.encode() for t in texts], CHUNK):
                n, s = apply(part)
                names += n
                scores.append(s)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else []})

    run.__annotations__ = {"batches": It[pd.Series], "return": It[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learns from the same table. Empty input gives no rows."""
    d = only(docs, "doc_id", "text", "lang")
    return predict(d, fit(d, params)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
