"""Embedding near-duplicates where ids repeat over labels and vectors, and in double precision."""

import math
from collections import defaultdict

import pytest

from sightline.llm import embeddings


def cosine(a, b):
    unit = lambda v: [x / max(map(abs, v)) for x in v]
    a, b = unit(a), unit(b)
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def brute(rows):
    """Links of each distinct (id, label, vector), and components of ids."""
    kinds = sorted({(i, n, tuple(v)) for i, v, n in rows})
    links, near = defaultdict(int), defaultdict(set)
    for a in kinds:
        for b in kinds:
            if a[0] != b[0] and a[1] == b[1] and cosine(a[2], b[2]) >= 0.98:
                links[a] += 1
                near[a[0]].add(b[0])
    root = {}
    for i in sorted({k[0] for k in kinds}):
        seen, left = {i}, [i]
        while left:
            for j in near[left.pop()] - seen:
                seen.add(j)
                left.append(j)
        root[i] = min(seen)
    return sorted((i, links[i, n, tuple(v)], root[i], root[i] == i) for i, v, n in rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_one_id_with_vectors_in_two_labels(spark, kind):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 2), (6, [1.0, 0.0], 1), (7, [1.0, 0.001], 1), (8, [0.0, 1.0], 3), (9, [-1.0, 0.0], 2), (6, [1.0, 0.0], 1)]
    found = embeddings.embedding_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_doubles_are_compared_as_doubles(spark):
    rows = [(1, [1e300, 1.0], 1), (2, [3e300, 0.0], 1), (3, [1.0, 1e-300], 1), (4, [0.0, 1e-300], 1), (5, [0.0, 2.0], 1)]
    # on either side of the threshold by less than a float can tell
    a = math.acos(0.98)
    rows += [(10, [1.0, 0.0], 2), (11, [math.cos(a - 1e-9), math.sin(a - 1e-9)], 2), (12, [math.cos(a + 1e-9), -math.sin(a + 1e-9)], 2)]
    found = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, found.collect())) == brute(rows)
