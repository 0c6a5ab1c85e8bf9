"""Packing, hard negatives and the Merkle manifest against brute force, on hard small tables and small parameters."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import merkle, negatives, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, offset string, _number long, part int"
PATH = P.path("byte_bpe_50k.json")


def hard_docs():
    rng = random.Random(5)
    words = ["one", "Two,", "drei\n", "\tvier", "fünf", " six", "sept　", "", "", "<|endoftext|>", "it's", "10.5"]
    texts = [None, "", " ", "  ", " \n \n ", "a  b   c \n d\t \te ", "<|endoftext|>", " <|endoftext|> x", "x" * 20_000, "word " * 5000, "é à «b»   —"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, t, "aa" if i % 2 else None, None if i % 3 == 0 else "s", None if i % 5 == 0 else i, "o", 7, 1) for i, t in enumerate(texts)]
    return [*rows, *[rows[9]] * 3, (None, "twice none", "aa", "s", 1, "o", 7, 1), (None, "twice none", None, None, None, None, None, None), (2**63 - 1, "x", "zz", "s", 2**63 - 1, "o", 7, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_docs(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.text("ab \n\t\x1c 　\u0085é'1.", max_size=30), min_size=1, max_size=20))
@settings(max_examples=300, deadline=None)
def test_spaced_encoder_is_the_library(texts):
    content = open(PATH, encoding="utf-8").read()
    encode, plain = packing.SpacedEncoder.of_worker(content, 4, True), test_spaced_encoder_is_the_library.__dict__.setdefault("plain", Tokenizer.from_file(PATH))
    for t, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("capacity", "shard"), [(2048, 1 << 16), (64, 40)])
def test_pieces_and_packing(docs, library, capacity, shard):
    rows = packing.pack(packing.token_pieces(docs, PATH, 0, capacity), capacity, shard).collect()
    want = Counter()
    for doc, text, *_ in hard_docs():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (math.ceil(len(ids) / capacity) - 1) * capacity
        begins = [0, *range(first, len(ids), capacity)]
        want.update((doc, i, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for i, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= capacity
    tokens = sum(r.length for r in rows)
    assert len(at) <= math.ceil(tokens / capacity) * 1.03 + 3


def test_squares_decide_the_place():
    """Each placement has the least sum of squares of those that an exhaustive look finds, and bins open only when nothing fits."""
    rng = random.Random(2)
    bins, gaps = packing.Bins(30), {}
    for _ in range(400):
        n = rng.randint(1, 30)
        options = {b: g for b, g in gaps.items() if g >= n}

        def squares(b, n=n):
            after = Counter(g - n * (k == b) for k, g in gaps.items())
            return sum(c * c for g, c in after.items() if g)

        least = min(map(squares, options), default=None)
        found, offset = bins.place(n)
        assert (found in options and squares(found) == least and offset == 30 - gaps[found]) if options else (found not in gaps and offset == 0)
        gaps[found] = gaps.get(found, 30) - n


def test_packing_keeps_columns_and_refuses_lengths(spark, docs):
    pieces = spark.createDataFrame([(5, "a", 1, 2), (5, "a", 1, 2), (9, None, None, 3)], "length int, _number string, _shard int, id int")
    out = packing.pack(pieces, 10)
    assert out.columns == ["length", "_number", "_shard", "id", "sequence_id", "offset"]
    assert sorted(r["length"] for r in out.collect()) == [5, 5, 9] and out.select("sequence_id").distinct().count() == 2
    assert packing.pack(pieces.limit(0), 10).count() == 0
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(Exception, match="length"):
        packing.pack(pieces, 8)


def hard_vectors():
    rng = random.Random(4)
    rows = []
    for i in range(240):
        v = [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(5)]
        rows.append((i * 5, v, rng.choice([1, 1, 1, 2, 3, 4 + i]), "x"))
    odd = [(None, [1.0] * 5, 1), (100, None, 1), (200, [1.0] * 5, None), (300, [1.0, None], 1), (400, [float("nan")] * 5, 1), (500, [float("inf"), 1.0], 1), (600, [], 1), (700, [1.0, 1.0], 2), (7, [0.1] * 7, 1), (100, [1.0] * 5, 2)]
    return rows + [(*r, "x") for r in odd] + [rows[0], rows[20], rows[20]]


def brute_negatives(rows, low=80, high=100):
    sound = [(k, i, n, [math.floor(256 * float(x)) for x in v]) for k, (i, v, n, _) in enumerate(rows) if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, n, v in sound:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, x) for x, j, m, w in sound if x != k)
        for p, p_null, pj, *_ in [s for s in scored if s[3] == n][:5]:
            found = [s for s in scored if s[3] != n and low * -p <= 100 * -s[0] <= high * -p][:5]
            out += [(i, None if p_null else pj, r, None if s[1] else s[2], -p, -s[0]) for r, s in enumerate(found, 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<double>, label int, uid string"


@pytest.mark.parametrize("params", [negatives.Params(), negatives.Params(anchors=3, rows=16, width=2, stripe=2)])
def test_hard_negatives(spark, params):
    vectors = spark.createDataFrame(hard_vectors(), VECTORS).repartition(3)
    found = negatives.mine(vectors, F.col("vec_id") % 100 == 0, params)
    want = brute_negatives(hard_vectors())
    assert Counter(map(tuple, found.collect())) == want and len(want) > 50
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    vectors = spark.createDataFrame(hard_vectors(), VECTORS)
    assert negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(vectors, F.lit(None).cast("boolean")).count() == 0
    large = spark.createDataFrame([(0, [2.0**18, 1.0], 1, ""), (1, [2.0**18, 1.0], 1, ""), (2, [2.0**18, 0.5], 2, "")], VECTORS)
    assert [tuple(r) for r in negatives.mine(large, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 2**52 + 2**16, 2**52 + 2**15)]
    with pytest.raises(Exception, match="too large"):
        negatives.mine(vectors.select("vec_id", F.array(F.lit(1e300)).alias("embedding"), "label"), F.col("vec_id") == 0).count()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n_chars, text)])


def brute_tree(leaves):
    """Root, and each leaf's (sibling, left) from below."""
    paths, own, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(own):
            paths[k].append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i % 2 == 1))
        own = [i // 2 for i in own]
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for doc, text, lang, source, n_chars, *_ in rows:
        groups[lang].append((doc is not None, doc or 0, brute_leaf(doc, text, lang, source, n_chars)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([leaf for _, _, leaf in sorted(groups[g])]) for g in names]
    root, upper = brute_tree([t[0] for t in trees])
    return Counter((d if known else None, leaf, t[0], root, tuple(p + up)) for g, t, up in zip(names, trees, upper) for (known, d, leaf), p in zip(sorted(groups[g]), t[1]))


def found_manifest(df, per_part):
    leaves = df.select("doc_id", "lang", merkle.row_leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"), "part", F.lit(1).alias("grp"))
    return merkle.manifest(leaves, "lang", "doc_id", "leaf", per_part)


@pytest.mark.parametrize("per_part", [4, 1 << 18])
def test_manifest(spark, docs, per_part):
    wide = [(i, f"t{i}", "ü" if i < 150 else f"l{i % 9}" if i < 180 else f"own{i}", None, i, None, None, None) for i in range(230)]
    rows = hard_docs() + wide + [wide[3]] * 40
    found = found_manifest(spark.createDataFrame(rows, DOCS).repartition(3), per_part)
    assert found.columns == ["doc_id", "lang", "leaf", "part", "grp", "subroot", "root", "proof"]
    checked = found.select("doc_id", "leaf", "subroot", "root", "proof", merkle.fold(F.col("leaf"), F.col("proof")).alias("folded"), merkle.fold(F.lit("0"), F.col("proof")).alias("wrong"), merkle.siblings_hash(F.col("proof")).alias("p")).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in checked) == brute_manifest(rows)
    assert all(r.folded == r.root != r.wrong and r.p == h(*[s.sibling or "" for s in r.proof]) for r in checked)


def test_manifest_of_one_row_and_of_none(spark, docs):
    assert found_manifest(docs.limit(0), 4).count() == 0
    row = found_manifest(docs.where("doc_id = 7"), 4).first()
    assert row.root == row.subroot == row.leaf and row.proof == []


def test_tampered_query(spark, tmp_path):
    from sightline.llm import queries

    rows = [r for r in hard_docs() if r[0] != 2**63 - 1]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.leaf): r for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    for doc, text, lang, source, n_chars, *_ in rows:
        r = found[doc, brute_leaf(doc, text, lang, source, n_chars)]
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n_chars is not None
        assert r.verified == (not changed) == (r.folded_root == r.root)
