"""The index of similar names against all pairs."""

import random

import pytest

from tessera.functions.text import jaro_winkler_of
from tessera.operators import similar


def made(rng, n):
    syllables = "an be ro li ka mi so tu ve ne ja ho gi fe da zu pa er il us".split()
    names = {"".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) + " " + "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(n)}
    for x in list(names)[: n // 3]:  # misspelled
        i = rng.randrange(len(x) - 1)
        names.add(rng.choice([x[:i] + x[i + 1 :], x[:i] + x[i + 1] + x[i] + x[i + 2 :], x + "s", x[:i] + "x" + x[i:]]))
    return names


@pytest.mark.parametrize("threshold", [0.82, 0.88, 0.92, 1.0])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    names = sorted(made(rng, 250) | {"a", "b", "ab", "ba", "abc", "aaaa", "aaab", "é", "日本", "日本語", "x y", "aa"})
    df = spark.createDataFrame([(x,) for x in names] + [("",), (None,), (names[0],)], "name string")
    want = {(a, b, jaro_winkler_of(a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if jaro_winkler_of(a, b) >= threshold}
    assert {tuple(r) for r in similar.similar_names(df, threshold).collect()} == want and (want or threshold == 1.0)


def test_few_candidates(spark):
    """Of all pairs of names at most one in twenty is compared, in blocks of a first letter too."""
    names = sorted(made(random.Random(9), 600))
    df = spark.createDataFrame([(x,) for x in names], "name string")
    blocks = sum(a[0] == b[0] for i, a in enumerate(names) for b in names[i + 1 :])
    for threshold in (0.92, 0.88):
        found = similar.candidates(df, threshold).collect()
        assert sum(r["l"][0] == r["r"][0] for r in found) <= 0.05 * blocks and len(found) <= 0.05 * len(names) ** 2 / 2


def test_thresholds_have_a_floor(spark):
    with pytest.raises(ValueError):
        similar.candidates(spark.createDataFrame([("a",)], "name string"), 0.7)
