"""Clusters: against plain k-means on whole numbers, with ties, empty clusters and odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, width, k, rounds, scale=1024):
    """(rows by id: cluster and distance; centroids): every vector against every centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [list(v) for _, v in first]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centres


def check(spark, rows, width, k=4, rounds=5, parts=3, schema=SCHEMA):
    want, centres = plain(rows, width, k, rounds)
    got, found = centroids.cluster(spark.createDataFrame(rows, schema).repartition(parts), width=width, k=k, rounds=rounds)
    rows = centroids.with_digest(got, found).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in rows) == want
    assert [[int(x) for x in c] for c in found] == centres
    by = {}
    for _, c, d in want:
        by[c] = by.get(c, 0) + d
    for r in rows:
        assert r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()
    return want


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    check(spark, [(i, [float(np.float32(rng.gauss(i % 5, 1))) for _ in range(3)]) for i in range(300)], 3, k=6)


def test_ties_and_copies(spark):
    rng = random.Random(4)
    check(spark, [(i, [float(rng.randrange(-2, 3)) for _ in range(2)]) for i in range(200)], 2, k=7, rounds=4)
    check(spark, [(i, [1.0, 1.0]) for i in range(20)], 2)  # equal centroids: empty clusters stay


def test_a_third_in_one_place(spark):
    rng = random.Random(6)
    check(spark, [(i, [0.5, 0.5] if i % 3 else [rng.gauss(0, 3), rng.gauss(0, 3)]) for i in range(150)], 2, schema="vec_id long, embedding array<double>")


def test_large_components(spark):
    check(spark, [(i, [2e4 * i, -1e4 * (i % 7)]) for i in range(40)], 2, schema="vec_id long, embedding array<double>")


def test_scan_stops_only_beyond_twice_the_distance():
    """Nearest centroids whatever the start; distances are looked up for fewer than all."""
    rng = np.random.default_rng(1)
    rows, centres = rng.integers(-50, 50, (500, 2)).astype(float), rng.integers(-50, 50, (9, 2)).astype(float)
    order = centroids.neighbours(centres)
    full = ((rows[:, None] - centres[None]) ** 2).sum(2)
    seen = []
    plain_squared = centroids.squared
    centroids.squared = lambda x, c: (seen.append(len(x)), plain_squared(x, c))[1]
    try:
        for start in (np.zeros(500, int), rng.integers(0, 9, 500), full.argmin(1)):
            seen.clear()
            best, distance = centroids.place(rows, start, centres, order)
            assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()
        assert sum(seen) < 0.6 * 500 * 9
    finally:
        centroids.squared = plain_squared


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [5.0, 2.0]), (7, [5.0, 2.0]), (8, [])]
    assert len(check(spark, rows, 2)) == 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "c", "n", "distance", "sums")})
    assert centroids.cluster(df, width=2)[0].count() == 3
    empty, found = centroids.cluster(df.limit(0), width=2)
    assert empty.count() == 0 and len(found) == 0 and centroids.with_digest(empty, found).count() == 0
    nameless = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 2.0])], SCHEMA)
    assert [r["cluster"] for r in centroids.cluster(nameless, width=2)[0].collect()] == [0, 0]


def test_results_are_described():
    assert "Defined results" in centroids.__doc__
