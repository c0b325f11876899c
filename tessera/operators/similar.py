"""Similarity joins of names: an index that lists only pairs which can reach a Jaro-Winkler similarity.

For a similarity of t, two names whose first l letters agree (l at most 4) need a Jaro similarity of j = (t - l/10) / (1 - l/10).
Jaro counts m matching letters, and (m/n + m/k + 1) / 3 is the most that names of n and k letters can then have. So they share at least
o = (3j - 1) n k / (n + k) letters, each as often as it is in both. Letters (with the number of the occurrence) of a
name are put in order of their rarity. Of two sets that share o elements, the first n - o + 2 and k - o + 2 in that order share
two at least: every pair of letters out of these is a key, together with both lengths and, for l = 4, the first letters. Pairs
that meet are then held to the bound with the letters that they do share, and only what passes is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaro_winkler
from tessera.operators.skew import heavy_keys, join_split
from tessera.operators.storage import stored

LEAST = 0.82  # below it four letters in common would need no more than a Jaro similarity that earns no bonus
COMMON = 2  # letters of a key


def _jaro_needed(threshold: float, prefix: int) -> float:
    return (threshold - 0.1 * prefix) / (1 - 0.1 * prefix)


def _shared_needed(n: Column, k: Column, threshold: float, prefix: int) -> Column:
    """Letters that names of these lengths must share at least; rounding may only lower it."""
    share = 3 * _jaro_needed(threshold, prefix) - 1
    return F.ceil(share * n * k / (n + k) - 1e-9).cast("int")


def letters(name: Column) -> Column:
    """The letters of a name, each with the number of its occurrence."""
    each = F.split(name, "")
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, 1, i + 1), lambda x: x == c)).cast("string")))


def _keys(sorted_letters: Column, n: Column, name: Column, threshold: float, prefix: int) -> Column:
    """Keys of a name against names of every length that is near enough."""
    share = 3 * _jaro_needed(threshold, prefix) - 1
    least, most = F.greatest(F.lit(1), F.ceil((share - 1) * n - 1e-9)), F.floor(n / (share - 1) + 1e-9)

    def against(k: Column) -> Column:
        need = _shared_needed(n, k, threshold, prefix)
        together = F.least(F.lit(COMMON), need)
        first = F.slice(sorted_letters, 1, F.greatest(F.lit(0), F.least(n, n - need + together)))
        head = F.concat_ws(" ", F.lit(str(prefix)), F.least(n, k).cast("string"), F.greatest(n, k).cast("string"), *([F.substring(name, 1, 4)] if prefix == 4 else []))
        pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.xxhash64(head, a, b))))
        alone = F.transform(first, lambda a: F.xxhash64(head, a))
        return F.when(together >= COMMON, pairs).otherwise(alone)

    return F.flatten(F.transform(F.sequence(least.cast("int"), F.greatest(least, most).cast("int")), against))


def candidates(names: DataFrame, threshold: float) -> DataFrame:
    """(l, r) of distinct names (column ``name``), l < r, that may reach the threshold. Names of one key, of which a few may be
    shared by very many, are met in many tasks."""
    if not LEAST <= threshold <= 1:
        raise ValueError(f"thresholds from {LEAST} to 1 only")
    cut = names.where("name <> ''").select("name").distinct().withColumn("letters", letters(F.col("name")))
    cut = stored(cut.withColumn("id", F.monotonically_increasing_id()), "similar-letters")
    rare = stored(cut.select(F.explode("letters").alias("x")).groupBy("x").agg(F.count("*").alias("df")), "similar-rarity")  # one row a letter and occurrence
    ranked = cut.select("id", "name", F.explode("letters").alias("x")).join(rare, "x").groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("s"))
    slim = ranked.select("id", "name", F.transform("s", lambda y: y["x"]).alias("sorted"), F.length("name").alias("n"))
    keys = F.array_distinct(F.concat(*(_keys(F.col("sorted"), F.col("n"), F.col("name"), threshold, p) for p in (3, 4))))
    keyed = stored(slim.select("id", F.explode(keys).alias("key")), "similar-keys")
    met = join_split(keyed.select("key", F.col("id").alias("a")), keyed.select("key", F.col("id").alias("b")), "key", "a", heavy_keys(keyed, "key")).where("a < b")
    pairs = stored(met.select("a", "b").distinct(), "similar-met")  # a pair meets under several keys
    side = lambda k, name, set_: cut.select(F.col("id").alias(k), F.col("name").alias(name), F.col("letters").alias(set_))
    both = pairs.join(side("a", "p", "x"), "a").join(side("b", "q", "y"), "b")
    shared, n, k = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    prefix = F.lit(0)
    for i in range(1, 5):
        prefix = F.when(F.substring("p", 1, i) == F.substring("q", 1, i), i).otherwise(prefix)
    most = (shared / n + shared / k + 1) / 3
    near = both.where(most + 0.1 * prefix * (1 - most) >= threshold - 1e-9)
    return near.select(F.least("p", "q").alias("l"), F.greatest("p", "q").alias("r"))


def similar_names(names: DataFrame, threshold: float) -> DataFrame:
    """(l, r, similarity) of all distinct names (column ``name``) that reach the threshold."""
    return candidates(names, threshold).withColumn("similarity", jaro_winkler("l", "r")).where(F.col("similarity") >= threshold)
