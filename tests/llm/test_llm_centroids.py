"""Centroid clustering against plain loops over Python integers."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import centroids
from tablescout.llm.frames import work_folder

D = 64


def whole(x):
    return math.floor(x * 256) if abs(x) < 2.0**52 else int(x) * 256


def brute(rows, k=40, rounds=5):
    kept = [
        (i, [whole(x) for x in v])
        for i, v in rows
        if v is not None and len(v) == D and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = [r for r in kept if r[0] is not None]
    now = [v for _, v in sorted(named, key=lambda r: (sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    if not now:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((far(v, c), n) for n, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, n) in zip(kept, assign(), strict=True):
            groups.setdefault(n, []).append(v)
        for n, g in groups.items():
            now[n] = [sum(column) // len(g) for column in zip(*g, strict=True)]
    last = assign()
    sums = {}
    for d, n in last:
        sums[n] = sums.get(n, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    return [
        (i, n, fits(d), fits(sums[n]), fits(sum(sums.values())),
         sha256(",".join(map(str, now[n])).encode()).hexdigest())
        for (i, _), (d, n) in zip(kept, last, strict=True)
    ]


def run(spark, rows, **options):
    df = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string"
    ).repartition(3)
    return centroids.cluster(df, work_folder(spark, "centroids"), **options)


def same(got, expected):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    around = rng.normal(size=(12, D)) * 0.2
    rows = [(i, (around[i % 12] + rng.normal(size=D) * 0.05).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # copies
    rows += [(5, rows[9][1]), (5, rows[5][1])]  # repeated ids
    return rows


def test_against_plain_loops(spark, vectors):
    odd = [
        (2000, None), (2001, []), (2002, [1.0]), (2003, [None] + [0.0] * (D - 1)),
        (2004, [math.nan] + [0.0] * (D - 1)), (2005, [math.inf] + [0.0] * (D - 1)),
        (2006, [0.0] * D), (None, [0.5] * D), (2007, [0.0] * (D + 1)),
    ]
    rows = vectors + odd
    got = run(spark, rows)
    assert got.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]
    same(got.collect(), brute(rows))


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] * D) for i in range(60)]  # most centroids start equal
    same(run(spark, rows).collect(), brute(rows))


def test_components_of_any_size(spark, vectors):
    rows = vectors[:60] + [
        (3000, [1e300] + [0.0] * (D - 1)), (3001, [-1e30, 2e5] + [0.0] * (D - 2)), (3002, [1.5e5] * D)
    ]
    same(run(spark, rows).collect(), brute(rows))


def test_few_and_none(spark):
    rows = [(1, [0.25] * D), (2, [-0.25] * D)]
    same(run(spark, rows).collect(), brute(rows))
    assert run(spark, []).collect() == []
    assert run(spark, [(None, [0.0] * D)]).collect() == []


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = centroids.cluster(df, work_folder(spark, "centroids")).collect()
    same(got, brute([(r["vec_id"], r["embedding"]) for r in df.collect()]))


def test_bounds_leave_few_to_verify():
    rng = np.random.default_rng(1)
    around = rng.normal(size=(40, D)) * 60
    rows = np.floor(around[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, D)) * 5).astype(np.int64)
    centers = np.floor(around).astype(np.int64)
    axes = centroids.rotation(rows.astype(float))
    lead, rest, square = centroids.reduced(rows, axes)
    c_lead, c_rest, _ = centroids.reduced(centers, axes)
    exact = ((rows[:, None] - centers) ** 2).sum(axis=2)
    bound = ((lead[:, None] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2
    assert (bound <= exact + 1e-3).all()
    best, distance = centroids.nearest(rows, lead, rest, square, centers, axes)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert (bound <= distance[:, None]).mean() < 0.1
