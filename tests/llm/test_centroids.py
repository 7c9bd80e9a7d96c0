"""Centroid clustering against plain whole-number k-means."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractus.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k, rounds=5, length=64):
    """Rows (vec_id, list) with Python's own integers."""
    kept = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == length and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    c = [list(v) for _, _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, (d, at) in found if at == j) for j in range(len(c))}
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, (d, j) in found], key=str)


def vectors(n, seed=0, spread=0.02):
    r = np.random.default_rng(seed)
    near = r.normal(size=(6, 64)) / 8
    return [(i, [float(x) for x in (near[i % 6] + r.normal(size=64) * spread).astype(np.float32)]) for i in range(n)]


def run(spark, rows, **kw):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = centroids.clusters(d.select("*", *[F.lit("clash").alias(c) for c in ("v", "dots", "cluster", "distance", "n")]), **kw)
    assert got.columns == COLUMNS
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("k", [1, 8, 40])
def test_equals_plain(spark, k):
    rows = vectors(150, k)
    assert run(spark, rows, n=k) == plain(rows, k)


def test_edges(spark):
    rows = vectors(12) + [(20, None), (21, []), (22, [1.0] * 63), (23, [1.0] * 65), (24, [None] + [0.0] * 63),
                          (25, [float("nan")] + [0.0] * 63), (26, [float("inf")] + [0.0] * 63), (27, [0.0] * 64),
                          (28, [-0.001] * 64), (3, vectors(12)[3][1]), (3, vectors(12)[3][1]), (None, [0.5] * 64), (None, [0.5] * 64)]
    assert run(spark, rows) == plain(rows, 40)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [0.25 * (i % 2)] * 64) for i in range(30)]   # two distinct vectors, eight centroids
    got = run(spark, rows, n=8)
    assert got == plain(rows, 8) and len({r[1] for r in got}) <= 2


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (None, [1.0] * 64)]) == []


def test_large_components_are_exact():
    r = np.random.default_rng(1)
    v, old, new = (r.integers(-centroids.LARGEST, centroids.LARGEST, (n, 64)) for n in (20, 5, 5))
    new[1], new[2, 3:] = old[1], old[2, 3:]
    dots = centroids.Change(old, new).apply(v, centroids.Change(None, old).apply(v, None))
    assert dots.tolist() == [[sum(int(a) * int(b) for a, b in zip(x, c)) for c in new] for x in v]
    cluster, distance = centroids.Change(old, new).nearest(v, dots)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in new] for x in v]
    assert cluster.tolist() == [e.index(min(e)) for e in exact] and distance.tolist() == [min(e) for e in exact]


def test_repeats_itself_over_any_layout(spark):
    rows = vectors(200, 3, 0.3)
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    a, b = (sorted(map(tuple, centroids.clusters(x, n=10).collect())) for x in (d.coalesce(1), d.repartition(13)))
    assert a == b
