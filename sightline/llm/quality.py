"""Quality rules as a short-circuit cascade, in built-in column functions only.

A rule is a condition that rejects a document. Rules are tried on a sample, one at a time: how long it takes
and what part it rejects. They're then asked in the order of rejections per second, and the first that
rejects ends it. The order never changes a verdict, only its cost.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

#: Characters that count as symbols (fixed value of the contract).
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window whose repetition counts.
REPEAT = 8


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(h: Column, size: int) -> Column:
    """Words in windows whose hash is found twice or more in ``h``, the hashes by position."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + size - F.greatest(F.lit(0), a["end"] - p)).cast("long").alias("n"), (p + size).alias("end")), lambda a: a["n"])

    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(placed, covered))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words`` and the counts ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Null texts count as empty. Lines are split at line feeds and count if they have a word. Columns of these
    names are replaced; other columns stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    windows = F.when(
        F.size("words") >= REPEAT, F.transform(F.sequence(F.lit(0), F.size("words") - REPEAT), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(REPEAT)]))
    ).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    h, held = fresh(d, "hashes"), fresh(d, "lines")
    d = d.withColumns({h: windows, held: lines})
    return d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long"),
        "n_lines": F.size(held).cast("long"),
        "n_dup_lines": (F.size(held) - F.size(F.array_distinct(held))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(h), REPEAT),
    }).drop(h, held)


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    """Too few words, or more than ``most_repeated`` per cent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Beyond the base: symbols per word, shouting, repeated lines, length of words, words without a letter."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 5 * F.col("n_symbols") > n),
        Rule("shouting", 2 * (F.size(F.split("text", "[A-Z]", -1)) - 1) > chars),
        Rule("repeated lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("word length", (chars < 2 * n) | (chars > 20 * n)),
        Rule("no letters", 10 * F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))) > 4 * n),
    ]


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """``rules`` by falling rejections per second on ``sample``; of equals, in the given order."""
    rows = max(1, sample.count())

    def rated(rule: Rule) -> float:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects)).first()[0]
        return (rejected + 0.5) / rows / max(1e-6, time.perf_counter() - began)

    for rule in rules[:1]:
        rated(rule)  # the first job pays for what all need
    return sorted(rules, key=lambda r: -rated(r))


def cascade(rules: Sequence[Rule]) -> Column:
    """Whether no rule rejects, asked in the given order. A rule whose condition is null doesn't reject."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(False))
    return verdict.otherwise(F.lit(True)) if rules else F.lit(True)


def judged(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 1000, seed: int = 1) -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept``: not failed at the base, nor rejected by ``rules``.

    About ``sample_rows`` documents that pass the base settle the order of the rules. Null and empty texts
    fail at the base. Rows that repeat get equal verdicts. An empty table gives no rows.
    """
    rules = standard_rules() if rules is None else list(rules)
    docs = docs.drop("base_failed", "kept")
    sample = docs.sample(min(1.0, sample_rows / max(1, docs.count())), seed)
    # filtered once it is a table: a filter on computed columns would be moved below them and compute them anew
    sample = materialize(measured(sample), "sample").where(~base_failed())
    d = measured(docs).withColumn("base_failed", base_failed())
    return d.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered(sample, rules))))
