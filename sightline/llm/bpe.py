"""Byte-level BPE with Spark's higher-order functions.

A word is one match of the splitting pattern. Encoding starts from the ids of its single bytes and folds
merges over that array: of all neighbours whose bytes together are a token, the pair of the lowest rank is
merged, the leftmost of equal ones, until no pair is left. The ranks are a map from a pair of ids to the rank,
and thus the id, of both together: constant arrays, in which a pair's key leads to its entry.

All words of the corpus are counted. A table of a fixed number of places, where a word's place is its hash,
keeps the most frequent words of each place, folded once; a text looks its words up there, and a word that
isn't in its place is folded where it stands, with the same ids. This table and the rank map enter the plan as
scalar subqueries, which Spark turns into literals when it runs, so that plans stay small, neither texts nor ids
are shuffled, and no Python worker runs. Decoding looks the piece of each id up and concatenates them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Places for frequent words, and how many words a place has at most; both bound the table, whatever the corpus.
PLACES, WAYS = 1 << 17, 6
#: Bytes of the longest word that the table takes; a longer one is folded where it stands.
LONGEST = 64
#: What white space is to Unicode; Java's own class has ASCII's alone.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
#: More than any id; its cube fits into a long. A rank of ``_NONE`` is none.
_WIDE = 1 << 20
_NONE = _WIDE - 1
#: What a unit's rank is multiplied by; its place, of 23 bits, by ``_WIDE``.
_RANK = 1 << 43
#: Bytes beyond which a word is cut where no merge can reach across; the ids are the same without.
LONG = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of lines with a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(df: DataFrame, constant: Column, column: str, body: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``column``, made by ``body`` of a scalar subquery, which Spark doesn't take inside of lambdas."""
    name = f"constant_{uuid.uuid4().hex}"
    return df.withColumn(name, constant).withColumn(column, _let(F.col(name), body)).drop(name)


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int | None]]:
    """Shifts and entries: the key of two ids whose bytes together are a token, plus the shift found by the key, leads to the key and their rank.

    Both are found modulo the arrays' sizes; the shifts are such that no two keys share an entry.
    """
    merged = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                merged[a * _WIDE + b] = rank
    shifts: list[int] = [0] * (len(merged) // 2 * 2 + 1)
    entries: list[int | None] = [None] * (len(merged) * 5 // 2 + 7)
    groups: dict[int, list[int]] = {}
    for key in merged:
        groups.setdefault(key % len(shifts), []).append(key)
    for at, keys in sorted(groups.items(), key=lambda x: -len(x[1])):
        for shift in range(len(entries)):
            places = {(key + shift) % len(entries) for key in keys}
            if len(places) == len(keys) and all(entries[i] is None for i in places):
                break
        else:
            raise ValueError("the ranks don't fit into the table")
        shifts[at] = shift
        for key in keys:
            entries[(key + shift) % len(entries)] = key * _WIDE + merged[key]
    return shifts, entries


def side_by_side(ranks: dict[bytes, int]) -> list[bool]:
    """For each two bytes, as a number of 16 bits, whether they're neighbours in any token; elsewhere no merge can reach from one into the other."""
    found = [False] * 65536
    for token in ranks:
        for a, b in zip(token, token[1:]):
            found[a * 256 + b] = True
    return found


def fold(units: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """Ids, int, after all merges of ``units``; ``rank`` of two ids is that of both together, or ``_NONE``.

    A unit is a long of three parts: the rank of its id with the next one, its place, its id. The least unit is
    thus the leftmost pair of the lowest rank. A merge replaces it and its next one by one unit, and ranks the one
    before anew; a unit in front, of an id that no token has, lets every other one have one before it.
    """

    def id_of(unit: Column) -> Column:
        return unit.bitwiseAND(F.lit(_WIDE - 1))

    def merge(q: Column, _: Column) -> Column:
        def at_least(least: Column) -> Column:
            both = F.shiftrightunsigned(least, 43)

            def at_place(at: Column) -> Column:
                def merged(unit: Column, i: Column) -> Column:
                    new = least.bitwiseAND(F.lit(_RANK - _WIDE)) + both + rank(both, id_of(F.get(q, at + 2))) * _RANK
                    old = unit.bitwiseAND(F.lit(_RANK - 1)) + rank(id_of(unit), both) * _RANK
                    return F.when(i == at, new).when(i + 1 == at, old).otherwise(unit)

                return F.filter(F.transform(q, merged), lambda _, i: i != at + 1)

            return F.when(least < _NONE * _RANK, _let(F.array_position(q, least).cast("int") - 1, at_place)).otherwise(q)

        return _let(F.array_min(q), at_least)

    start = F.flatten(F.array(F.array(F.lit(_NONE * _RANK + _NONE)), units))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, merge, lambda q: F.transform(F.slice(q, F.lit(2), F.size(q)), lambda unit: id_of(unit).cast("int")))


def java_pattern(pattern: str) -> str:
    """``pattern`` with white space written out, in and outside of bracketed classes."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        inside = c == "[" or inside and c != "]"
        out += {"\\s": SPACE if inside else f"[{SPACE}]", "\\S": f"[^{SPACE}]"}.get(c, c)
    return out


class Codec:
    """A byte-level BPE with its splitting pattern and ranks; every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, places: int = PLACES) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        shifts, entries = rank_map(ranks)
        self.pattern, self.places, self.n_shifts, self.n_entries = java_pattern(pattern), places, len(shifts), len(entries)
        pieces = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.decode("ISO-8859-1")
        # units of each byte, at place 0, before each byte and at a word's end
        units = [ranks.get(bytes([a, b]), _NONE) * _RANK + ranks[bytes([a])] if b < 256 else _NONE * _RANK + ranks[bytes([a])] for a in range(256) for b in range(257)]
        columns = {
            "shifts": (shifts, pa.int32()),
            "entries": (entries, pa.int64()),
            "units": (units, pa.int64()),
            "beside": (side_by_side(ranks), pa.bool_()),
            "pieces": (pieces, pa.string()),
            "packs": ([i.to_bytes(4, "little").decode("ISO-8859-1") for i in range(len(pieces))], pa.string()),
        }
        self.table = pa.table({k: pa.array([v], pa.list_(kind)) for k, (v, kind) in columns.items()})
        self.constants: DataFrame | None = None

    def constant(self, spark: SparkSession, *names: str) -> Column:
        """One of the arrays made of the ranks, or a struct of several."""
        if self.constants is None:
            self.constants = materialize(spark.createDataFrame(self.table), "ranks")
        return self.constants.select(names[0] if len(names) == 1 else F.struct(*names).alias("ranks")).scalar()

    def merges(self, spark: SparkSession) -> Column:
        return self.constant(spark, "shifts", "entries", "units", "beside")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _place(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.places)).cast("int")

    def word_ids(self, word: Column, known: Column) -> Column:
        """Ids of a word, folded; a long one in stretches between bytes that no token holds side by side."""

        def rank(a: Column, b: Column) -> Column:
            def of_key(key: Column) -> Column:
                entry = F.get(known["entries"], (key + F.get(known["shifts"], key % self.n_shifts)) % self.n_entries)
                return F.least(F.pmod(entry - key * _WIDE, F.lit(1 << 60)), F.lit(_NONE))

            return _let(a * _WIDE + b, of_key)

        def of_codes(codes: Column) -> Column:
            return F.when(F.size(codes) > LONG, cut(codes)).otherwise(folded(codes))

        def folded(codes: Column) -> Column:
            def unit(code: Column, i: Column) -> Column:
                return F.get(known["units"], code * 257 + F.coalesce(F.get(codes, i + 1), F.lit(256))) + i.cast("long") * _WIDE

            return fold(F.transform(codes, unit), rank)

        def cut(codes: Column) -> Column:
            inner = F.filter(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: ~F.get(known["beside"], F.get(codes, i - 1) * 256 + F.get(codes, i)))
            stops = F.concat(inner, F.array(F.size(codes)))

            def stretches(stops: Column) -> Column:
                def one(stop: Column, n: Column) -> Column:
                    return _let(F.coalesce(F.get(stops, n - 1), F.lit(0)), lambda begin: _let(F.slice(codes, begin + 1, stop - begin), folded))

                return F.flatten(F.transform(stops, one))

            return _let(stops, stretches)

        codes = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), F.ascii)
        return _let(codes, of_codes)

    def frequent_words(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``place, way, w, ids``: at each place its ``WAYS`` most frequent words of ``docs``, equally frequent ones by code point. What occurs once, or has over ``LONGEST`` bytes, isn't kept."""
        counts = docs.select(F.explode(self.words(F.col(text))).alias("w")).where(F.octet_length("w") <= LONGEST).groupBy("w").agg(F.count("*").alias("n"))
        way = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "w"))
        best = counts.withColumn("place", self._place(F.col("w"))).withColumn("way", way).where((F.col("way") <= WAYS) & (F.col("n") > 1)).select("place", "way", "w")
        dealt = materialize(best, "words").repartition(-(-self.places * WAYS // 8192))
        return _with(dealt, self.merges(docs.sparkSession), "ids", lambda known: self.word_ids(F.col("w"), known))

    def _table(self, frequent: DataFrame) -> Column:
        """``ws, ids``: the first word of each place, in the order of places, then the second ones, and so on; null where a place has none."""
        places = frequent.sparkSession.range(self.places).select(F.col("id").cast("int").alias("place"))
        words = frequent.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("way", "w", "ids"))).alias("words"))
        entries = places.join(words, "place", "left").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("entries"))

        def flat(name: str) -> Column:
            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WAYS - 1)), lambda k: F.transform("entries", lambda e: F.get(e["words"], k)[name]))).alias(name)

        return materialize(entries.select(flat("w"), flat("ids")), "places").select(F.struct("w", "ids").alias("table")).scalar()

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` with ``ids``, array<int>. A null or empty text has none; a column of that name is replaced."""
        table = self._table(materialize(self.frequent_words(docs, text), "frequent"))

        def encoded(known: Column, frequent: Column) -> Column:
            def all_ids(words: Column) -> Column:
                def one(word: Column, place: Column) -> Column:
                    told = [F.when(F.get(frequent["w"], place + k * self.places) == word, F.get(frequent["ids"], place + k * self.places)) for k in range(WAYS)]
                    return F.coalesce(*told, self.word_ids(word, known))

                return F.flatten(F.zip_with(words, F.transform(words, self._place), one))

            return _let(self.words(F.col(text)), all_ids)

        name = f"frequent_{uuid.uuid4().hex}"
        body = lambda known: _let(F.col(name), lambda frequent: encoded(known, frequent))
        return _with(docs.withColumn(name, table), self.merges(docs.sparkSession), ids, body).drop(name)

    def _joined(self, df: DataFrame, table: str, ids: str, column: str) -> DataFrame:
        """Entries of a table of strings, each character a byte, one after the other, as binary."""
        return _with(df, self.constant(df.sparkSession, table), column, lambda t: F.encode(F.array_join(F.transform(F.col(ids), lambda i: F.get(t, i)), ""), "ISO-8859-1"))

    def decode(self, df: DataFrame, ids: str = "ids", column: str = "decoded") -> DataFrame:
        """``df`` with the bytes of its arrays of ids, binary: the pieces of all of them; ids that no token has give none."""
        return self._joined(df, "pieces", ids, column)

    def packed(self, df: DataFrame, ids: str = "ids", column: str = "packed") -> DataFrame:
        """``df`` with its arrays of this vocabulary's ids as little-endian unsigned 32-bit integers, binary."""
        return self._joined(df, "packs", ids, column)


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: of its ids, and of the bytes they decode to.

    A null or empty text has no ids. Repeated rows give repeated results; an empty table has none. Other columns
    are ignored.
    """
    out = codec.decode(codec.packed(codec.encode(docs.select("doc_id", "text"))))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
