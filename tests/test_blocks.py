"""Linkage over blocks, against rules that are tried on every two records."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded_share
from tessera.functions.text import jaro_winkler_of, jaro_winkler_table
from tessera.operators import blocks, identity

HELD = "record_id string, first_name string, last_name string, name_norm string, email_norms array<string>, email_domain string, org_norm string, country_code string, github_login string, keywords array<string>"


def _people(n=90):
    rng = random.Random(4)
    maybe = lambda x, p=0.8: x if rng.random() < p else None
    out = []
    for i in range(n):
        first, last = rng.choice(["ann", "anna", "bea", "", "zoë"]), rng.choice(["li", "lee", "meier", "maier"])
        name, mail = maybe(f"{first} {last}"), f"{rng.choice(['ann', 'a.lee', 'bea'])}{rng.choice(['', '@x.org', '@y.org'])}"
        login = maybe(rng.choice(["annli", "annalee", "beameier", "zoëli", ""]), 0.4)
        out.append((f"r{i * 37 % n:03}", maybe(first), maybe(last, 0.5), name, maybe([mail]), maybe(rng.choice("xyz"), 0.3), maybe(rng.choice("op")), maybe("CH"), login, maybe(rng.sample("abcde", rng.randrange(5)))))
    return out


def _rules(a, b):
    plain = [x[3].replace(" ", "") if x[3] is not None else None for x in (a, b)]
    same = lambda i: a[i] is not None and a[i] == b[i]
    initial = a[1] is not None and b[1] is not None and a[1][:1] == b[1][:1]
    login = any(x and x == y for x, y in ((a[8], plain[1]), (b[8], plain[0])))
    return same(2), same(5), initial and same(6), login


def _levels(a, b):
    name = None if a[3] is None or b[3] is None else 4 if a[3] == b[3] else sum(jaro_winkler_of(a[3], b[3]) >= x for x in identity.NAME_LEVELS)
    mail = None
    if a[4] and b[4]:
        (e, f), (u, v) = (a[4][0], b[4][0]), (a[4][0].split("@")[0], b[4][0].split("@")[0])
        mail = 4 if e == f else 3 if u == v else 2 if jaro_winkler_of(e, f) >= identity.EMAIL_LEVEL else int(jaro_winkler_of(u, v) >= identity.EMAIL_LEVEL)
    same = lambda i: None if a[i] is None or b[i] is None else int(a[i] == b[i])
    shared = len(set(a[9] or ()) & set(b[9] or ()))
    return name, mail, same(6), same(7), None if not a[9] or not b[9] else 2 if shared >= 3 else int(shared >= 1)


def _want():
    people = sorted(_people())
    pairs = [(a, b) for i, a in enumerate(people) for b in people[i + 1 :]]
    return {(a[0], b[0]): (_rules(a, b), _levels(a, b)) for a, b in pairs if any(_rules(a, b))}


def test_similarities_of_many_texts():
    rng = random.Random(3)
    for letters, most in (("ab", 6), ("abcdé漢\0", 16), ("abc", 33), ("ab", 70)):
        a, b = ([*("".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(40)), "", "a"] for _ in range(2))
        want = np.array([[jaro_winkler_of(x, y) for y in b] for x in a])
        assert (jaro_winkler_table(a, b) == want).all()
        at = np.arange(42), np.arange(42)[::-1]
        assert (jaro_winkler_table(a, b, at) == want[at]).all()


@pytest.mark.parametrize("members", [4, 1_000])
def test_each_pair_of_blocks_once(spark, members):
    """Blocks cut into ranges and whole ones; pairs of several rules, logins that name each other, and unknown values."""
    got = blocks.compared_pairs(spark.createDataFrame(_people(), HELD), identity.NAME_LEVELS, identity.EMAIL_LEVEL, members=members).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(left=l, right=r, **dict(zip(blocks.LEVELS, levels))) for (l, r), (_, levels) in _want().items()]))


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Neither by g04_linkage nor by what reads its pairs: shuffles come before the pairs."""
    plan = identity.linkage(spark.createDataFrame(_people(), HELD))._jdf.queryExecution().executedPlan().toString()
    made = plan.index("FlatMapGroupsInArrow")
    assert "Exchange" not in plan[:made] and "Join" not in plan[:made] and "Sort" not in plan[:made]


def test_shares_are_rounded_as_databases_do(spark):
    values = [0.0, 1.0, 0.1234565, 0.12345649999, 2.5e-6, 0.5, 0.9999995, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded_share(F.col("x"), 6)).collect()]
    assert got == [np.floor(v * 1e6 + 0.5) / 1e6 for v in values]


@pytest.mark.parametrize("members", [4, 1_000])
def test_patterns_are_counted_where_pairs_are_made(spark, members):
    found = blocks.counted_patterns(spark.createDataFrame(_people(), HELD), identity.NAME_LEVELS, identity.EMAIL_LEVEL, members=members)
    got = Counter()
    for r in found.collect():
        got[tuple(r[x] for x in blocks.RULES), tuple(r[x] for x in blocks.LEVELS)] += r["pairs"]
    assert got == Counter(_want().values())
    plan = identity.patterns(spark.createDataFrame(_people(), HELD))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") and "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_settled_pairs_are_left_out_where_pairs_are_made(spark):
    people = spark.createDataFrame(_people(), HELD)
    linked = people.where("org_norm = 'o' and country_code = 'CH' and last_name = 'li'").selectExpr("min(record_id) over () as left", "record_id as right").where("left < right")
    active = people.where("last_name = 'meier'").selectExpr("record_id", "'p' as person_id")
    got = identity.undecided_linkage(people, linked, active)
    want = identity.undecided(identity.linkage(people), people, linked, active)
    assert sorted(map(tuple, got.select("left", "right", "band").collect())) == sorted(map(tuple, want.select("left", "right", "band").collect()))
    assert 0 < got.count() < len(_want())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]
