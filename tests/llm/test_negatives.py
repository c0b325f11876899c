"""Hard negatives: against a plain version, with ties, odd rows, several waves and large components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, scale=256):
    """Sorted result rows for (vec_id, vector, label)."""
    able = {}
    for i, v, y in rows:
        if None in (i, v, y) or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (y, [math.floor(scale * x) for x in v])
        able[i] = min(able.get(i, new), new)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (y, v) in able.items():
        if a % every:
            continue
        all_scores = sorted(((-score(v, w), i, z) for i, (z, w) in able.items() if i != a))
        for s, p, _ in [x for x in all_scores if x[2] == y][:5]:
            hard = [(n, t) for t, n, z in all_scores if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(hard)]
    return sorted(out)


def random_rows(seed, n=400, width=6, labels=3):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.choice([rng.gauss(0.3, 1), rng.randrange(3)]))) for _ in range(width)], rng.randrange(labels)) for i in rng.sample(range(-100, 2 * n), n)]


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine(df, **more).collect())


@pytest.mark.parametrize("wave", [3, 16_384])
@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_version(spark, seed, wave):
    rows = random_rows(seed)
    want = plain(rows)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5), wave=wave) == want and len(want) > 20


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 20)] + [(100 + i, [0.75, 0.0], 1) for i in range(20)]
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert [r[:4] for r in got if r[0] == 0] == [(0, p, k, 99 + k) for p in (1, 2, 3, 4, 5) for k in (1, 2, 3)]
    assert got == plain(rows)


def test_blocks_smaller_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 2)
    monkeypatch.setattr(negatives, "ROWS", 7)
    rows = random_rows(9, n=150)
    assert mined(spark.createDataFrame(rows, SCHEMA), every=10) == plain(rows, every=10)


def test_a_third_of_all_rows_alike(spark):
    rows = random_rows(5, n=300) + [(1000 + i, [1.0] * 6, 1) for i in range(150)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [1e8, 3.0], 0), (1, [1e5, 2.5], 0), (2, [9e4, 1.5], 1), (3, [9e4, 1.25], 1), (4, [2e4, 1.0], 1), (5, [3e-3, 1.0], 0)]
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)
    top = negatives._scores(np.array([[2.0**62]]), np.array([[2.0**62], [-(2.0**62)]]))
    assert top.tolist() == [[2**63 - 1, -(2**63) + 1]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0], 0), (50, None, 0), (100, [1.0], None), (150, [nan, 1.0], 0), (200, [1.0, inf], 1), (250, [1.0, None], 1), (300, [], 0), (0, [1.0, 1.0, 2.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.75, 0.75], 1), (3, [0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df.withColumns({c: F.lit("x") for c in ("v", "r", "list", "score", "rank", "id")})) == plain(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id is null")) == []
    assert negatives.mine(df.limit(0)).dtypes == negatives.mine(df).dtypes


def test_merging_is_associative():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 9, (4, 60)), np.arange(60)
    whole, parts = negatives.Best(4, 5), [negatives.Best(4, 5) for _ in range(3)]
    whole.add(np.arange(4), scores.astype(np.int64).copy(), ids)
    for i, b in enumerate(parts):
        b.add(np.arange(4), scores[:, i::3].astype(np.int64).copy(), ids[i::3])
    for at in range(4):
        every = sorted((-s, i) for b in parts for s, i in zip(b.scores[at].tolist(), b.ids[at].tolist()))[:5]
        assert every == [(-s, i) for s, i in zip(whole.scores[at].tolist(), whole.ids[at].tolist())]


def test_results_are_described():
    assert "Defined results" in negatives.__doc__
