import itertools
import random
import re

import numpy as np
import pytest

from tessera.llm import neardup


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]) if w else frozenset()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets], key=str)


def corpus(seed):
    """Groups of near copies around a base, chains, templates that are alike but not enough, exact copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(400))
    rows, at = [], 0

    def add(words):
        nonlocal at
        rows.append((at, " ".join(words)))
        at += 1

    for _ in range(6):
        base = [word() for _ in range(120)]
        add(base)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = word()
            add(copy)
        add([w.upper() for w in base])
        chain = base
        for _ in range(5):
            chain = [*chain[3:], word(), word(), word()]
            add(chain)
    template = [word() for _ in range(100)]
    for _ in range(15):
        add([*template, *(word() for _ in range(rng.randrange(10, 30)))])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "TWO\twords"), (1005, "one"), (None, "x y z a"), (1006, "É é"), (1007, "é é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.link(df, words=k, percent=percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows, k, percent)


def test_settles_mixed_buckets(spark, monkeypatch):
    """With no links to hubs at all, the pass over the rarest shingles must find every link."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    calls = []
    plain = neardup.confirm

    def none_at_first(pairs, sets, percent):
        calls.append(1)
        return plain(pairs.limit(0) if len(calls) == 1 else pairs, sets, percent)

    monkeypatch.setattr(neardup, "confirm", none_at_first)
    got = neardup.link(df, words=3, percent=85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows, 3, 85)


def test_repeated_ids_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (5, b + " x"), (7, a + " y"), (9, "c d e f g h")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, label int")
    got = neardup.link(df, words=3, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (1, 1), (5, 1), (7, 1), (9, 9)]
    kept = neardup.keep_one(df, words=3, percent=85)
    assert kept.columns == ["doc_id", "text", "label"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 1, 9]
    assert neardup.link(df.limit(0)).count() == 0


def test_pigeonhole_guarantee():
    """Signatures that differ in up to 2m - 1 places share a key."""
    rng = np.random.default_rng(9)
    chunks = neardup.chunks_for(85)
    places = chunks * neardup.SYMBOLS
    base = rng.integers(0, 2**16, (400, places)).astype(np.uint16)
    near = base.copy()
    for row in near:
        at = rng.choice(places, neardup.distance_bound(chunks), replace=False)
        row[at] += 1
    a, b = neardup.chunk_keys(base, chunks), neardup.chunk_keys(near, chunks)
    assert (a == b).any(axis=1).all()
    assert not np.intersect1d(a, neardup.chunk_keys(rng.integers(0, 2**16, (400, places)).astype(np.uint16), chunks)).size
