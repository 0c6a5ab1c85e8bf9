"""The training-data operators against brute force, exact round trips and held-out accuracy, on hard small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import bpe, embeddings, htmltext, jaccard, langid, mixing, quality, queries, simhash, substrings, tokencounts, tokenfiles
from sightline.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long"
SMALL = "/root/testdata/sf0.001"


def vocabulary(seed=3, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def hard_rows():
    """Nulls, blanks, repeats, ties, a very long text, marks and accents; columns that clash with inner names."""
    rng, words = random.Random(1), vocabulary()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(30)
    texts = [None, "", " \n\t", "one", "Two words", "É ÀB c!  d\n\ne", shared, shared, shared + " tail", text(5) + " " + shared + "\n" + text(7), shared + " " + shared, text(3000), "x" * 9000, "Ünïcödé 12345 ... #$% <|endoftext|>"]
    rows = [(i, t, "aa" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 1, "f", 7) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, shared, None, None, None, None, None), (20, text(40), "aa", "s1", 1, "f", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_fingerprint(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [w] if 0 < len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots_of(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints_are_brute_forces(docs):
    want = sorted((r[0] is None, r[0] or 0, brute_fingerprint(r[1])) for r in hard_rows())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64) for r in simhash.fingerprints(docs).collect())
    assert got == want


@pytest.mark.parametrize("bucket", [256, 4])
def test_golay_links_connect_what_two_bits_connect(spark, bucket):
    rng = random.Random(bucket)
    fps = {0}
    for _ in range(30):
        c = rng.getrandbits(64)
        fps |= {c} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(12)}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    e = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket)
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) % 2**64).count("1") <= 2]
    want = {n: r for n, r in roots_of(fps, near).items() if any(n in p for p in near)}
    assert got == want


def test_golay_decodes_three_errors():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 500)
    assert (simhash.decode(w) < 1 << 12).all()
    near = simhash.fuzzy_indices(w)
    other = w ^ (1 << rng.integers(0, 23, 500)) ^ (1 << rng.integers(0, 23, 500))
    assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(near, simhash.fuzzy_indices(other)))
    assert set(np.unique((near >= 0).sum(axis=1))) <= {1, 6}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 6)], "a long, b long")
    assert {r["root"] for r in connected_components(e).collect()} == {0}


def test_near_dedup_keeps_one_of_each_group(docs, empty):
    got = simhash.drop_near_duplicates(docs)
    ids = [r["doc_id"] for r in got.collect()]
    assert got.columns == docs.columns and len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 6 in ids and 7 not in ids and None not in ids
    assert simhash.simhash_groups(empty).count() == 0


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, 1), (None, b, 2), (None, b, 2), (None, c, 3), (1, c, 4), (1, d, 5), (1, e, 6), (2, e, 7), (1, e, 8)]
    want = [(None, a, 1), (None, b, 2), (1, c, 4), (1, d, 5)]
    runs = []
    for parts in (1, 5):
        got = [tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(parts)).collect()]
        assert sorted((r for r in got if r[1] != e), key=str) == sorted(want, key=str)
        runs.append([r for r in got if r[1] == e])
    assert runs[0] == runs[1] and len(runs[0]) == 1 and runs[0][0][0] == 1


def planted_rows():
    """Originals, copies changed to similarities about 0.8 to 0.95, one large group, and texts that only share a passage."""
    rng, words = random.Random(5), [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], text(60)
    for i in range(40):
        base = text(rng.randint(30, 300))
        rows.append((i, " ".join(base)))
        for k, gone in enumerate((0.005, 0.012, 0.02, 0.024, 0.03)):
            other = list(base)
            for at in rng.sample(range(len(base)), max(1, round(gone * len(base)))):
                other[at] = rng.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(other)))
    base = text(150)
    for i in range(60):
        other = list(base)
        for at in rng.sample(range(150), 2):
            other[at] = rng.choice(words)
        rows.append((5000 - i, " ".join(other)))
    rows += [(7000 + i, " ".join(passage + text(40))) for i in range(30)]
    twin = " ".join(text(20))
    rows += [(None, " ".join(text(50))), (None, " ".join(text(50))), (3, " ".join(text(50))), (8000, twin), (8000, twin), (8001, twin.upper()), (8002, ""), (8003, None), (8004, "one Word"), (8005, "one  word")]
    rng.shuffle(rows)
    return rows


def brute_kept(rows, least=0.8):
    sets = []
    for d, t in rows:
        w = words_of((t or "").lower())
        sets.append((d is None, d or 0, t or "", frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    kept = []
    for r in sorted(sets, key=lambda r: r[:3]):
        if not any(r[3] == k[3] or len(r[3] & k[3]) >= least * len(r[3] | k[3]) for k in kept):
            kept.append(r)
    return sorted((r[0], r[1], r[2]) for r in kept)


@pytest.mark.parametrize("top", [8, 1])
def test_similar_documents_are_brute_forces(spark, top):
    import corpus_pipeline

    rows = planted_rows()
    d = spark.createDataFrame([(*r, "aa", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = jaccard.drop_similar(d, top=top) if top == 1 else corpus_pipeline.near_dedup(spark, d, "")
    assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in out.select("doc_id", "text").collect()) == brute_kept(rows)
    assert jaccard.drop_similar(d.limit(0)).count() == 0


def test_sketches_never_part_similar_sets():
    """What differs between sketches differs between sets, whatever their sizes; unlike sets are told apart."""
    rng = np.random.default_rng(3)
    for n, m in [(0, 0), (1, 1), (5, 6), (64, 65), (250, 260), (1000, 1200), (1000, 1000)]:
        both = rng.integers(-(2**63), 2**63 - 1, n)
        for own in (0, m // 10, m):
            x, y = (np.unique(np.r_[both, rng.integers(-(2**63), 2**63 - 1, k)]) for k in (own, m - n + own))
            apart = len(np.setxor1d(x, y))
            assert jaccard.differing(jaccard.sketch(x), jaccard.sketch(y)) <= apart
    x, y = (np.unique(rng.integers(-(2**63), 2**63 - 1, 300)) for _ in range(2))
    assert jaccard.differing(jaccard.sketch(x), jaccard.sketch(y)) > 600 // 9


def test_sets_are_made_for_pairs_that_sketches_leave(spark, monkeypatch):
    """Texts that only share a passage are candidates, and no sets are made of them."""
    rng, made = random.Random(6), []
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = text(60), text(100)
    rows = [(i, " ".join(passage + text(60))) for i in range(20)] + [(100, " ".join(base)), (101, " ".join([*base, "end"]))]

    def noted(df, name, write=jaccard.materialize):
        out = write(df, name)
        made.extend(r["set"] for r in out.collect() if name == "sets")
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    kept = {r["doc_id"] for r in jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in rows} - {101}
    assert set(made) == {jaccard.set_id(jaccard.shingles(t.encode())) for d, t in rows if d >= 100}


def test_golay_keys_find_similar_sets(spark):
    """Planted copies at 0.8 and more: pairs within two errors in two segments all meet, and of the close ones nearly all."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), i % 5):
            other[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other) + " end")]
    sets = {d: jaccard.shingles(t.encode()) for d, t in rows}
    first = [(jaccard.set_id(s), d, len(s), int(np.uint64(simhash.majority(s.view(np.uint64))).view(np.int64))) for d, s in sets.items()]
    of = {s: d for s, d, _, _ in first}
    found = {(of[r["b"]], of[r["a"]]) for r in jaccard.key_pairs(spark.createDataFrame(first, "set long, o long, m int, fp long")).collect()}
    bits = {d: fp & (1 << 64) - 1 for _, d, _, fp in first}
    similar = lambda x, y: 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
    close = [d for d in range(0, 600, 2) if similar(sets[d], sets[d + 1])]
    for d in close:
        errors = [((bits[d] ^ bits[d + 1]) >> a & (1 << n) - 1).bit_count() for a, n in simhash.SEGMENTS]
        assert sorted(errors)[1] > 2 or (d, d + 1) in found
    assert len(close) > 250 and all(not (a // 2 != b // 2 and similar(sets[a], sets[b])) for a, b in found)
    met = {n: [(d, d + 1) in found for d in close if d // 2 % 5 == n] for n in range(5)}
    assert sum(met[0]) >= 0.95 * len(met[0]) and sum(map(sum, met.values())) >= 0.8 * len(close)


def brute_removed(rows, length):
    first, out = {}, {}
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows}, key=lambda x: x[:2])
    for k in order:
        w = words_of(k[2])
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (*k[:2], i))
    for known, d, t in order:
        w = words_of(t)
        gone = {i + j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] != (known, d, i) for j in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[known, d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("length,gram,group", [(20, 4, 4096), (5, 2, 2)])
def test_substrings_are_brute_forces(docs, length, gram, group):
    want = brute_removed(hard_rows(), length)
    got = substrings.remove_repeats(docs, length, gram, group).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"] is not None, r["doc_id"] or 0], r["doc_id"]
        if not r["n_removed"]:
            assert r["kept_text"] in [x[1] for x in hard_rows()]


def rows_of_repeated_ids():
    rng, words = random.Random(9), vocabulary(n=2000)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(25) for _ in range(4)]
    ids = [None, None, None, None, 1, 1, 1, 2, 3, 3]
    rows = [(d, f"{text(6 + i)} {shared[i % 4]} {text(9)} {shared[(i + 1) % 3]}") for i, d in enumerate(ids)]
    return [*rows, rows[0], rows[4], (4, rows[5][1]), (1, None), (None, None), (1, "")]


@pytest.mark.parametrize("group", [4096, 2])
def test_substrings_compare_every_text_of_an_id(spark, group):
    import corpus_pipeline

    rows, length = rows_of_repeated_ids(), 20
    place = lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64).item())
    first, want = {}, {}
    order = sorted({r for r in rows if r[1]}, key=place)
    for r in order:
        w = words_of(r[1])
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (r, i))
    for r in set(rows):
        w = words_of(r[1])
        gone = {i + j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] != (r, i) for j in range(length)}
        want[r] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(d, group=group).select("doc_id", "kept_text").collect()
    texts = sorted([(r[0], want[r]) for r in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == texts
    if group == 2:
        whole = spark.createDataFrame([(*r, "aa", str(i), 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        out = corpus_pipeline.substring_dedup(spark, whole, "").collect()
        assert sorted([(r["doc_id"], r["text"], r["source"]) for r in out], key=str) == sorted([(r[0], want[r], str(i)) for i, r in enumerate(rows)], key=str)


def test_workers_give_memory_back_at_a_tasks_end(monkeypatch):
    from sightline.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(calls)))
    texts = pa.RecordBatch.from_pydict({"doc_id": [1], "h": [2], "text": ["a b c d e f"]})
    assert len(list(substrings._anchor_rows(5, 2)(iter([texts])))) == 1 and calls == [0]
    assert list(substrings._tree_rows(5, True)(iter([]))) == [] and calls == [0, 1]
    double = common.per_batch(lambda b: {"x": [2 * x for x in b["x"].to_pylist()]}, pa.schema([("x", pa.int64())]))
    out = list(double(iter([pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)])))
    assert [b["x"][0].as_py() for b in out] == [0, 2, 4] and calls == [0, 1, 2]


def test_substrings_edges(empty, spark):
    assert substrings.remove_repeats(empty).count() == 0
    two = spark.createDataFrame([(1, "a b c d"), (1, "e f g h")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.remove_repeats(two, 2, 2).collect()) == [0, 0]


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_language_edges(docs, empty, spark):
    got = langid.identify(docs).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert [r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), None).collect()] == ["und"]


def library(special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = not special
    return t


def test_word_encoder_is_the_library():
    texts = [r[1] or "" for r in hard_rows()] + ["J̌A ǰ H̱", "İstanbul DON'T we'll", "  wide space", "ab ", "日本語 テキスト"]
    e = tokenfiles.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), 2)
    want = [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in e([t.encode() for t in texts])] == want


def test_plain_encoder_knows_special_tokens(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 2000)
    e = tokenfiles.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), 2, special=True)
    texts = ["a <|endoftext|> b <|startoftext|>c", "x<|endoftext|>y", "<|ENDOFTEXT|> Aa <|endoftext|>", "É<|endoftext|>\u0301", *(" ".join(vocabulary(i)) for i in range(20))]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(e([t.encode()])[0], "<u2").tolist() == library(True).encode(t, add_special_tokens=False).ids
    assert e.held < 20000


def test_numbers_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        assert (tokenfiles.decode_numbers(*tokenfiles.encode_numbers(x), n) == x).all()
    control, data = tokenfiles.encode_numbers(np.array([1, 300, 70000, 1 << 24]))
    assert (len(control), len(data), control[0]) == (1, 10, 0b11100100)


def test_token_files(docs, empty, spark):
    rows = sorted((r[:2] for r in hard_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.array([*e.ids, 1], "<u4") for e in library(True).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    path = tokenfiles.to_token_files(docs, P.path("word_bpe_49k.json"), 1)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path)).collect())
    ends = np.cumsum([len(x) for x in ids])
    assert got == [(int(e) - len(x), len(x), zlib.crc32(x.tobytes())) for e, x in zip(ends, ids)]
    assert tokenfiles.read_token_files(spark, tokenfiles.to_token_files(empty, P.path("word_bpe_49k.json"), 1)).count() == 0


def test_token_counts_across_blocks(docs, spark, tmp_path):
    ids = tokenfiles.tokenize(docs, P.path("word_bpe_49k.json"), 49407, 2)
    tokencounts.write_flat(ids, str(tmp_path / "flat"), 2, 16)
    blocks = tokencounts.read_flat(spark, str(tmp_path / "flat"))
    got = sorted(r["n_tokens"] for r in tokencounts.scan(tokencounts.find_ends(blocks, 49407, 2)).collect())
    assert got == sorted(len(e.ids) for e in library().encode_batch([r[1] or "" for r in hard_rows()], add_special_tokens=False))
    assert {(r["doc_id"], r["n_tokens"]) for r in tokencounts.count_tokens(ids, 49407, 2).where("doc_id = 3").collect()} == {(3, len(library().encode("one").ids))}
    raw = np.array([5, 6, 0, 0, 7, 8, 9], "<u2").tobytes()
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.bin").write_bytes(raw)
    found = tokencounts.scan(tokencounts.find_ends(tokencounts.read_raw(spark, str(tmp_path / "raw"), 4), 0, 2)).orderBy("start").collect()
    assert [(r["start"], r["n_tokens"], r["ended"]) for r in found] == [(0, 2, True), (3, 0, True), (4, 3, False)]


def brute_repeats(w, n=8):
    at = {}
    for i in range(len(w) - n + 1):
        at.setdefault(tuple(w[i : i + n]), []).append(i)
    return len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(n)})


def test_quality_counts_and_order(docs, empty):
    got = {(r["doc_id"], r["text"]): r for r in quality.judged(docs).collect()}
    for d, t, *_ in hard_rows():
        r, w, lines = got[d, t], words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), brute_repeats(w))
        assert r["base_failed"] == (len(w) < 20 or 100 * brute_repeats(w) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.judged(empty).count() == 0
    assert "Python" not in quality.judged(docs)._jdf.queryExecution().executedPlan().toString()


def test_water_fill():
    t = {x.source: x.target for x in mixing.water_fill({"b": 10, "a": 100, None: 1000, "B": 50}, (3, 1, 2), 1.5, 2)}
    assert t["b"] == 20 and t["B"] == 100 and t["a"] <= 200 and sum(t.values()) == pytest.approx(1740)
    assert mixing.water_fill({}, (1,), 1.5, 2) == []


def test_mix(docs, empty, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == len(hard_rows()) and all(r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] for r in got)
    assert all(r["size"] == len(words_of(r["text"])) for r in got)
    assert mixing.mix(empty).count() == 0
    rng = random.Random(8)
    many = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 40)), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    m = mixing.mix(many)
    sums = m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["g"]) <= 40 for r in sums)
    assert sorted(m.select("doc_id", "taken").collect()) == sorted(mixing.mix(many.repartition(7)).select("doc_id", "taken").collect())
    assert mixing.repeat_rows(m).count() == m.agg(F.sum("copies")).first()[0]
    tilted = mixing.solve(many.select("source", F.pmod("doc_id", F.lit(2)).cast("string").alias("par"), F.lit(1).alias("size")), {"source": {"s0": 300.0, "s1": 100.0, "s2": 200.0}, "par": {"0": 400.0, "1": 200.0}}, 2)
    rates = {(s, p): min(2, np.exp(tilted["source"][s] + tilted["par"][p])) for s in ("s0", "s1", "s2") for p in "01"}
    assert sum(100 * v for (s, p), v in rates.items() if s == "s0") == pytest.approx(300, rel=1e-3) and sum(100 * v for (s, p), v in rates.items() if p == "0") == pytest.approx(400, rel=1e-3)


def test_mix_of_repeated_rows_comes_near_its_target(spark):
    rows = [(7, " ".join(["w"] * 10), "a")] * 3000 + [(i, " ".join(["w"] * 5), "b") for i in range(7000)] + [(9, "w w w w", None)] * 400 + [(10, "v " * 6, None)] * 300
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sums) == len(rows) and all(abs(r["t"] - r["g"]) <= 10 for r in sums), sums
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5))
    assert sorted(got.select("doc_id", "taken").collect()) == sorted(again.select("doc_id", "taken").collect())


def test_mix_keeps_columns_of_its_own_names(spark):
    names = ["_last", "_limit0", "_t0", "_h", "_k", "_on", "_whole", "_more", "_key", "_n", "_row", "c0", "further0", "_picked", "a.b"]
    rows = [(i, "one two three", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(docs)
    assert sorted(tuple(r) for r in got.select(*[f"`{c}`" for c in docs.columns]).collect()) == sorted(rows)
    assert mixing.repeat_rows(got).columns == docs.columns


def test_languages_of_repeated_rows_are_learned_once(spark):
    from zlib import crc32

    from pyspark.sql import Row

    repeated = next(i for i in range(50) if crc32(str(i).encode()) % 4 != 2)
    rows = [Row(doc_id=repeated, text="zzz zz zzzz", lang="zz")] * 4000 + [Row(doc_id=i, text=f"the word {i}", lang="en") for i in range(300)] + [Row(doc_id=4, text="", lang="none")]
    params = langid.Params(per_language=20, epochs=1)
    model = langid.fit(spark.createDataFrame(rows), params)
    assert model.labels == ["en", "zz"]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a>Menu</a></ul></nav>
<div class="ad">Buy this, now.</div><article><h1>Head &amp; line</h1><p>A  long
paragraph, with <b>bold</b>text; and more.<p>Short.<br>Line<script>var a="</p>";</script></article>
<aside>Side, bar.</aside><div id="comments"><p>Nice, really nice, article, I think.</p></div><form>F</form><footer>&copy;</footer></body>"""


def test_html(spark):
    assert htmltext.main_text(PAGE) == "Head & line A long paragraph, with boldtext; and more. Short. Line"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>Only, this."), (1, "u", PAGE), (4, "u", "<<>>&#x41;&bogus; <div" + "<div>" * 500 + "deep, text")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got[1:3]] == [(2, 0), (3, 0)] and got[3]["text"] == "Only, this." and got[0]["text"] == got[4]["text"] and all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_names_on_holders_say_nothing():
    article = "<article><h1>Title</h1><p>" + "This, surely, is a sentence of the article. " * 6 + "</p><p>Short.</p></article>"
    rest = "<nav><ul><li>A<li>B</ul></nav>%s<footer>(c) 2020, some footer text, all rights reserved.</footer>" % article
    want = htmltext.main_text(rest)
    assert want.startswith("Title This") and want.endswith("article. Short.")
    for wrap in (
        '<html class="no-js cookie-consent"><body>%s</body></html>', '<body class="single right-sidebar">%s</body>', '<div data-id="ad 7">%s</div>', '<div title="the hidden gem">%s</div>',
        '<div class="with-header">%s</div>', '<div class="search-results related">%s</div>', "<p title=don't>%s", '<div class="related">%s</div>', "<form id=f>%s</form>",
    ):
        assert htmltext.main_text(wrap % rest) == want, wrap
    comments = "<div class='comments'>" + "<p>A long comment, indeed, a very long one. And more, more.</p>" * 9 + "</div>"
    assert htmltext.main_text(rest + comments) == htmltext.main_text(rest.replace("</article>", comments + "</article>")) == want
    assert htmltext.main_text(rest.replace("article>", "div>") + comments) == want
    assert htmltext.main_text("<nav>A, b.</nav><footer>C, d.</footer>") == ""


def test_html_ratios_decide():
    prose = "<div><p>" + "Prose, with commas, and stops. " * 9 + "</p><p>More prose, which is shorter.</p></div>"
    links = "<ul>" + "<li><a>Link</a></li>" * 12 + "</ul>"
    page = f"<div><span>Breaking</span>{links}</div>{prose}<div>{links}</div>"
    found, doubtful = htmltext.nodes(page)
    assert not doubtful and htmltext.main_text(page).count("Link") == 0 and htmltext.main_text(page).endswith("which is shorter.")
    index, score = htmltext.path_scores(found)
    names = [n.path for n in found]
    sizes = [[len(n.text) for n in found if n.path == x] for x in names]
    stops = [[sum(c in ",.()" for c in n.text) for n in found if n.path == x] for x in names]
    kernel = {d: np.exp(-d * d / 2) for d in range(-3, 4)}
    smooth = lambda v: [sum(k * v[min(max(i + d, 0), len(v) - 1)] for d, k in kernel.items()) / sum(kernel.values()) for i in range(len(v))]
    fused = [a * b for a, b in zip(smooth([sum(x) / len(x) for x in sizes]), smooth([sum(x) / len(x) + 1 for x in stops]))]
    for i, x in enumerate(names):
        same = [f for f, y in zip(fused, names) if x == y]
        assert score[index[i]] == pytest.approx(sum(same) / len(same))


def test_html_articles_that_are_no_content():
    article = "<article><h1>Title</h1><p>" + "This, surely, is a sentence of the article. " * 6 + "</p><p>Short.</p></article>"
    want = htmltext.main_text(f"<body>{article}</body>")
    comment = "<p>A long comment, indeed, a very long one, with commas. And more, more of it, here.</p>"
    for more in (
        f'<div class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body">{comment}</article></li></ol></div>',
        f'<section id="comments"><article>{comment}</article><article>{comment}</article></section>', f'<article class="comment">{comment}</article>',
        '<div class="related-posts"><article class="card"><h3>Another one, to read</h3><p>See, and read, this.</p></article></div>', '<div class="legal">\u00a9 2024 Example, Inc. All rights reserved.</div>',
    ):
        assert htmltext.main_text(f"<body>{article}{more}</body>") == want, more
        assert htmltext.main_text(f"<body><main>{article}{more}</main></body>") == want, more
    # the first article clears the name of what holds it, whatever follows
    assert htmltext.main_text(f'<body><div class="related">{article}{article}</div></body>') == f"{want} {want}"


def test_html_long_and_none(spark):
    long = "<div class=a>" * 2000 + "<p>" + "word, " * 200_000
    assert htmltext.main_text(long) == ("word, " * 200_000).strip()
    assert htmltext.main_text("<" * 50_000) == "<" * 50_000 and htmltext.main_text('<p a="' * 20_000) == ""
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_html_keeps_the_content_of_whole_pages():
    p = "<p>Long, plain text, that is content.</p>"
    want = "Long, plain text, that is content."
    for page in (
        f"<html><head><title>T</title><meta charset=u><body>{p}</body></html>",
        f"<html><head><link rel=x><div>{p}</div>",
        f"<head><title>T</title>{want}",
        f"<html class='no-ads has-menu'><body class='has-sidebar'>{p}</body></html>",
        f"<body class='sidebar'><main id=comments>{p}</main></body>",
        f"<article class='post with-comments'>{p}</article>",
        f"<div class='col no-sidebar' data-id='ad'>{p}</div>",
        f"<div title='a hidden path' data-x=\"display: none\">{p}</div><img alt='the hidden one'>",
    ):
        assert htmltext.main_text(page) == want, page
    for struck in ("class='x ad'", "class=cookie-notice", "ID='nav_menu'", "role = navigation", "hidden", "HIDDEN=''", "aria-hidden='true'", "style='color:red; display : none'"):
        assert htmltext.main_text(f"<body>{p}<div {struck}>Bought, sold, and so on.</div></body>") == want, struck
    assert htmltext.main_text(f"<html><head><title>T</title><template><div>X, y.</div></template></head><body>{p}") == want


def brute_links(rows, least=0.98):
    out = {}
    uniq = list({(i, lab, None if v is None else tuple(v)) for i, lab, v in rows})
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, lab, v in uniq]
    edges = []
    for a, (i, la, v) in enumerate(uniq):
        n = 0
        for b, (j, lb, w) in enumerate(uniq):
            if a != b and ok[a] and ok[b] and la == lb and len(v) == len(w):
                x, y = np.float32(v).astype(float), np.float32(w).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n += 1
                    edges.append((i, j))
        out[i] = n
    roots = roots_of(list(out), edges)
    return {i: (n, roots[i]) for i, n in out.items()}


@pytest.mark.parametrize("chunk,grid", [(4096, 1), (8, 1), (4096, 2), (8, 5), (2, 3)])
def test_embeddings_are_brute_forces(spark, chunk, grid):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 12))
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(base)]
    centre = rng.normal(size=12)
    rows += [(100 + k, 1, [float(x) for x in centre + rng.normal(size=12) * 0.12]) for k in range(60)]
    rows += [(200, 1, rows[40][2]), (201, 1, rows[40][2]), (202, None, rows[40][2]), (203, 1, None), (204, 1, [0.0] * 12), (205, 1, [float("nan")] * 12), (206, 1, [1.0, None]), (207, 1, []), (208, 1, [1.0]), (209, 1, [2.0])]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, label int, embedding array<float>").withColumn("node", F.lit(1))
    got = embeddings.embedding_groups(df, embeddings.Params(held=chunk * 12, grid=grid)).collect()
    want = brute_links(rows)
    assert len(got) == len(rows) + 1 and {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_empty(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_bpe_is_the_librarys(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, places=40)
    want = {}
    for d, t, *_ in hard_rows():
        ids = np.array(e.encode_ordinary(t or ""), "<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = bpe.round_trip(docs, codec).collect()
    assert len(got) == len(hard_rows()) and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert bpe.round_trip(empty, codec).count() == 0
    texts = ["abc" * 700, "q7Zx" * 300 + "日本語" * 100, " \u00a0\u3000\u2003 x\u2028\n\n  y", "\x1c\x00 a\x1fb", "aaaaaaaaaaa", "x" * 49, "don't we'LL 12345\r\n\t!!??", "naïve Ünï"]
    odd = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = codec.packed(codec.decode(codec.encode(odd), column="b"), column="p").collect()
    for r in out:
        want = e.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == want and bytes(r["b"]).decode() == texts[r["doc_id"]] and bytes(r["p"]) == np.array(want, "<u4").tobytes()
    assert "Python" not in bpe.round_trip(docs, codec)._jdf.queryExecution().executedPlan().toString()


def test_columns_named_as_inner_ones_stay(spark):
    d = spark.createDataFrame([(1, "some words here", "aa", "p", 3, 4)], "doc_id long, text string, lang string, predicted string, hashes int, lines int")
    assert langid.predict(d, langid.fit(d)).select("predicted").first()[0] == "p"
    assert tuple(quality.judged(d).select("hashes", "lines").first()) == (3, 4)


def test_every_language_is_learned(spark):
    d = spark.createDataFrame([(i, f"text of {i}", f"l{i % 7}") for i in range(40)], "doc_id long, text string, lang string")
    assert len(langid.fit(d, langid.Params(documents=7, epochs=1)).labels) == 7
    with pytest.raises(ValueError):
        langid.fit(d, langid.Params(documents=6))


def test_newton_steps_solve_the_second_derivative():
    rng = np.random.default_rng(2)
    at = np.stack([rng.integers(0, 5, 60), rng.integers(5, 9, 60)], axis=1)
    weight, use = rng.random(60), np.arange(9) != 3
    rows = np.zeros((60, 9))
    rows[np.arange(60)[:, None], at] = 1
    h, g = rows.T @ (weight[:, None] * rows), rows.T @ rng.normal(size=60)
    g = np.where(use, h @ np.where(use, rng.normal(size=9), 0), 0)
    step = mixing._newton_step(at, weight, g, use)
    assert np.allclose((h @ step)[use], -g[use], atol=1e-8) and not step[~use].any()
    assert np.allclose(mixing._newton_step(at[:, :1], weight, h.diagonal()[:9] * (np.arange(9) < 5), np.arange(9) < 5)[:5], -1)


def test_every_number_has_a_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)


def test_pipeline_runs_all_stages(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_table_of_words_is_two_flat_arrays(spark):
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, places=4)
    d = spark.createDataFrame([(1, "some words some more words and some wordiness wordiness")], "doc_id long, text string")
    frequent = codec.frequent_words(d)
    table = spark.range(1).select(codec._table(frequent).alias("t")).first()["t"]
    assert len(table["w"]) == len(table["ids"]) == 4 * bpe.WAYS
    at = {r["w"]: r["ids"] for r in frequent.collect()}
    assert {w: i for w, i in zip(table["w"], table["ids"]) if w is not None} == at and " some" in at
    assert {table["w"][(r["way"] - 1) * 4 + r["place"]] for r in frequent.collect()} == set(at)
