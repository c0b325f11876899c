"""Exact copies: against plain Python, the Bloom filter's promise, and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact


def plain(rows):
    """doc_id -> (keep_id, group_size) of rows (id, text) with distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    texts = ["", None, " \t", "a b", "ab", "a\x0bb ", "a b", "𝒳 y", "𝒳y  ", "x" * 100_000, "x" * 99_999 + " x"] + ["".join(rng.choice("ab \n") for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    got = exact.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "doc_id", "text").collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["keep_id"])


def test_a_third_in_one_group(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact.mark(df).groupBy("group_size", "kept").count().collect()
    assert {(r["group_size"], r["kept"], r["count"]) for r in got} == {(1, True, 20_000), (10_000, True, 1), (10_000, False, 9_999)}


def test_filter_finds_all_repeated_and_passes_most(spark):
    df = spark.range(50_000).select("id", F.xxhash64(F.col("id") % 49_000).alias("h"), F.col("id").alias("row"), F.lit(1).alias("n_chars"), F.lit("").alias("text_sha256")).repartition(9)
    blocks = exact.blocks_for(50_000)
    maybe = exact.may_repeat(df, exact.repeated_bits(exact.marks(df, blocks)), blocks).where("maybe")
    assert maybe.where("id < 1000 or id >= 49000").count() == 2000 and maybe.count() < 2000 + 0.01 * 50_000


def test_filter_has_a_bound():
    assert exact.blocks_for(10**12) * exact.BLOCK == exact.MAX_BITS and exact.blocks_for(0) == 1


def test_full_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(exact, "MAX_BITS", exact.BLOCK)
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50_000).cast("string").alias("text"))
    assert exact.mark(df).where("kept").count() == 50_000


def test_only_rows_that_may_repeat_are_shuffled_with_digests(spark):
    df = spark.range(1000).select(F.col("id").alias("row"), F.col("id"), F.xxhash64("id").alias("h"), F.lit(1).alias("n_chars"), F.lit("").alias("text_sha256"))
    bits = spark.createDataFrame([(0, [0] * 1024)], "block int, words array<long>")
    plan = exact.may_repeat(df, bits, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_odd_rows(spark):
    rows = [(None, "a"), (None, "a "), (3, "a"), (3, "a"), (4, "b"), (4, "c"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_exact_id", "_exact_sha", "kept", "row", "h", "id", "group_size", "words", "block")})
    got = exact.mark(df)
    assert got.count() == 7 and got.where("group_size = 4").select("keep_id").distinct().collect()[0][0] is None  # the longest has no id
    assert got.where("kept").count() == 4 == exact.keep_one(df).count()
    assert exact.keep_one(df).columns == df.columns
    assert sorted(r["text"] or "" for r in exact.keep_one(df).collect()) == ["", "a ", "b", "c"]
    assert exact.mark(df.limit(0)).count() == 0 == exact.keep_one(df.limit(0)).count()


def test_names_as_ids(spark):
    df = spark.createDataFrame([("x", "1"), ("y", "1 ")], "name string, body string")
    assert [(r["name"], r["kept"]) for r in exact.mark(df, "name", "body").orderBy("name").collect()] == [("x", False), ("y", True)]


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert [tuple(r) for r in exact.keep_one(df).collect()] == [(1, "a")]
