"""The stored index against the search that reads every text."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, search

FIELDS = [("name", "name", 3.0), ("tags", "tags", 2.5), ("evidence", "body", 0.75)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = "robot robotics arm skin sensors TouchPad drone quadrotor maps mapping warehouse logistic logistics gripper alpine simulation simulators a of the grasps navigat navigation xy".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i, said(4), said(3) or None, said(40), rng.choice([None, 1.0, 2.0])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, name string, tags string, body string, final_score double")


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    return index.TextIndex.build(docs, FIELDS, "id", str(tmp_path_factory.mktemp("index") / "x"), postings_a_file=500)


@pytest.mark.parametrize("query", ["tactile robot", "map", "mapping the warehouse", "robot robot arm", "navigation simulators drone", "nowhere to be found", "of the"])
def test_equals_search(docs, stored, monkeypatch, query):
    monkeypatch.setattr(index, "FIRST_BLOCKS", 1)
    want = [(r["id"], r["relevance"], r["matched"] if "matched" in r else None) for r in search.search(docs, FIELDS, query).collect()]
    got = [(r["id"], r["relevance"], r["matched"] if "matched" in r else None) for r in stored.search(docs, FIELDS, query).collect()]
    assert got == want or (query == "of the" and len(got) == len(want))
    if query != "of the":
        kept = F.col("id") % 3 == 0
        want = [(r["id"], r["relevance"], r["matched"]) for r in search.search(docs, FIELDS, query, kept).collect()]
        for k in (1, 7, 1000):
            assert [(r["id"], r["relevance"], r["matched"]) for r in stored.search(docs, FIELDS, query, kept, k=k).collect()] == want[:k]


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "DOCUMENTS_A_BLOCK", 10)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 2)
    df = spark.createDataFrame([(i, "drone robot" if i % 37 == 0 else "robot") for i in range(500)], "id long, name string")
    fields = [("name", "name", 3.0)]
    made = index.TextIndex.build(df, fields, "id", str(tmp_path / "i"))
    read = []
    scores = index.TextIndex._scores
    monkeypatch.setattr(index.TextIndex, "_scores", lambda self, p, *a: (read.append(p.select("block").distinct().count()), scores(self, p, *a))[1])
    best = made.best("drone robot", 1).collect()
    assert read[0] == 2 and sum(read) < 20 and {r["key"] for r in best} == {i for i in range(500) if i % 37 == 0}


def test_filter_on_tokens_reaches_the_scan(stored):
    plan = stored.hits("mapping drone")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "canon" in pushed and ("In(canon" in pushed or "EqualTo(canon" in pushed) and "StringStartsWith(canon" in pushed
