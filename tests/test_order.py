"""Medians of groups of any size, pages of any depth, reach by bitmaps, components in few rounds."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, order


def test_medians_equal_plain_ones(spark):
    rng = random.Random(1)
    groups = {"wide": [rng.choice([1e308, -1e308, 1e-300, 0.0, rng.gauss(0, 1)]) for _ in range(900)], "same": [7.0] * 700, "even": [1.0, 2.0, 10.0, 20.0], "odd": [3.0, 1.0, 2.0], "ties": [float(rng.randrange(3)) for _ in range(801)], None: [rng.expovariate(1e-3) for _ in range(500)], "outlier": [rng.random() for _ in range(400)] + [1e300] * 3, "one": [4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("nothing", None), ("odd", float("nan"))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, v double").repartition(5)
    want = {g: statistics.median(vs) for g, vs in groups.items()}
    for gathered in (1, 20, 100_000):
        got = {r["g"]: r["m"] for r in order.medians(df, "g", "v", "m", gathered).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], rel_tol=1e-15) for g in want), gathered
    assert order.medians(df.limit(0), "g", "v").count() == 0


def test_one_group_holds_all_rows(spark):
    df = spark.range(60_000).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 60_000).cast("double").alias("v"))
    assert order.medians(df, "g", "v", gathered=100).collect()[0]["median"] == 29_999.5


def test_deep_pages_read_their_range_only(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(500), i, f"r{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, id long, v string").repartition(6)
    pages = order.Pages.lay(df, ["a", "id"], str(tmp_path / "p"), rows_a_range=700)
    want = sorted(rows)
    for number in (0, 1, 35, 123, 249, 250, 10_000):
        assert [tuple(r) for r in pages.page(number).collect()] == want[number * 20 : number * 20 + 20]
    assert len(pages.page(200).inputFiles()) == len(pages.table.inputFiles())  # files are listed ...
    plan = pages.page(200)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_range" in plan.split("PartitionFilters")[1][:200]  # ... but pruned by range
    assert len({r for r in range(len(pages.starts)) if pages.starts[r][0] < 4020 and 4000 < pages.starts[r][0] + pages.starts[r][2]}) <= 2
    assert order.Pages.lay(df.limit(0), ["a"], str(tmp_path / "e")).page(0).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_reach_by_bitmaps(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(160)] + [(500, i) for i in range(300, 420)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {x: len((near[x] | {z for y in near[x] for z in near[y]}) - {x}) for x in near}
    df = graph.neighbours(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"]: r["reached"] for r in graph.reached(df).collect()} == want


def test_reach_lists_no_pairs_of_nodes(spark):
    near = graph.neighbours(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")
    plan = graph.reached(near)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert "bit_or" in plan and joins and not any("other" in line for line in joins)


@pytest.mark.parametrize("remnant", [0, 50_000])
def test_rounds_of_components_have_a_bound(spark, monkeypatch, remnant):
    """A path with shuffled ids and a star: the smallest reachable node, in at most 2 log2(n) rounds, and estimated sizes that do not grow."""
    monkeypatch.setattr(graph, "REMNANT", remnant)
    n = 3000
    place = list(range(n))
    random.Random(7).shuffle(place)
    edges = [(place[i], place[i + 1]) for i in range(n - 1)] + [(5000, 5001 + i) for i in range(2000)]
    labels, sizes = [], []
    plain_stored = graph.stored

    def spy(df, label):
        labels.append(label)
        sizes.append(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return plain_stored(df, label)

    monkeypatch.setattr(graph, "stored", spy)
    out = graph.components(spark.range(9000, 9002).union(spark.range(1)), spark.createDataFrame(edges, "a long, b long"))
    full = graph.components(spark.createDataFrame([(i,) for e in edges for i in e], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {(r["id"], r["component"]) for r in out.collect()} == {(0, 0), (9000, 9000), (9001, 9001)}
    assert {(r["id"] < n, r["component"]) for r in full.collect()} == {(True, 0), (False, 5000)}
    assert labels.count("components-round") <= 2 * 2 * math.log2(len(edges)) and max(sizes[8:]).bit_length() <= max(sizes[:8]).bit_length()


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    none = spark.createDataFrame([("a", "a"), ("a", None)], "a string, b string")
    assert sorted(map(tuple, graph.components(nodes, none).collect())) == [("a", "a"), ("b", "b")]
