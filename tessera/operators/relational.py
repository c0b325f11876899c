"""Filters, joins, folds, windows and set operations that jobs and queries share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import global_rank, page, running_total  # noqa: F401
from tessera.operators.skew import HEAVY_KEYS, HEAVY_ROWS, PARTS, copied_rows, heavy_keys, in_parts, join_split
from tessera.operators.storage import stored

# ---- projections and filters --------------------------------------------------------------------


def typed(variant: Column, path: str, kind: str) -> Column:
    """A value out of a variant, null where it is missing or of another type. JSON booleans are no numbers."""
    raw = F.try_variant_get(variant, path, "variant")
    is_bool = F.schema_of_variant(raw) == "BOOLEAN"
    got = F.try_variant_get(variant, path, kind)
    return got if kind in ("boolean", "string", "variant") else F.when(~F.coalesce(is_bool, F.lit(False)), got)


def good_and_rejected(df: DataFrame, valid: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """One parse, two outputs: rows that pass, and the rest with a reason."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("reason", reason)


def rejects(df: DataFrame, source: Column, natural_key: Column, reason: Column) -> DataFrame:
    """Rows that did not pass as (source, natural_key, reason, row as JSON), one for each source and key: the last by reason."""
    rows = df.select(source.alias("source"), natural_key.cast("string").alias("natural_key"), reason.alias("reason"), F.to_json(F.struct(*df.columns)).alias("payload"))
    return rows.groupBy("source", "natural_key").agg(F.max(F.struct("reason", "payload")).alias("r")).select("source", "natural_key", "r.reason", "r.payload")


def reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that fail, in order; a check that is null does not fail."""
    return F.filter(F.array(*(F.when(failed, F.lit(name)) for name, failed in checks)), lambda x: x.isNotNull())


# Accounts that are programs.
BOTS = "dependabot renovate github-actions greenkeeper snyk-bot imgbot allcontributors codecov pre-commit-ci web-flow weblate".split()


def bots(login: Column, kind: Column, denied: Sequence[str] = BOTS) -> Column:
    """Of kind Bot, marked ``[bot]``, or on the list."""
    return F.coalesce(kind == "Bot", F.lit(False)) | login.endswith("[bot]") | F.regexp_replace(F.lower(login), r"\[bot\]$", "").isin(*denied)


def row_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose JSON text contains a string, whatever the case."""
    return df.where(F.instr(F.lower(F.to_json(F.struct(*df.columns))), needle.lower()) > 0)


def since(df: DataFrame, column: str, watermark: Column) -> DataFrame:
    return df.where(F.col(column) >= watermark)


def wire(df: DataFrame, json_columns: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Rows as they leave: nested columns as JSON text, some columns left out."""
    return df.select(*(F.to_json(c).alias(c) if c in json_columns else F.col(c) for c in df.columns if c not in drop))


def json_rows(df: DataFrame) -> DataFrame:
    """A table as one column of JSON rows, unknown values included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def leading_columns(columns: Sequence[str], most: int = 8, ids: int = 2) -> list[str]:
    """Columns worth showing: few ids, then the named ones first."""
    first = [c for c in columns if any(x in c for x in ("name", "title", "status", "score"))]
    rest = [c for c in columns if c not in first]
    id_like = [c for c in rest if c.endswith(("_id", "key", "_hash"))][:ids]
    return [*id_like, *first, *(c for c in rest if not c.endswith(("_id", "key", "_hash")))][:most]


# ---- joins ------------------------------------------------------------------------------------


def left_flagged(left: DataFrame, right: DataFrame, on: Sequence[str], flag: Column) -> DataFrame:
    """Left join whose flag belongs to the condition: rows without a flagged match stay."""
    return left.join(right.where(flag), list(on), "left")


def union_of_pairs(rules: dict[str, DataFrame]) -> DataFrame:
    """Pairs of several equality joins. A join with OR between keys would compare all rows; a union of joins does not."""
    out = None
    for name, pairs in rules.items():
        part = pairs.withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def equal_pairs(df: DataFrame, key: str, on: Sequence[str], split: bool = False) -> DataFrame:
    """(left, right) of rows that agree on all of ``on``, nulls apart, left < right. With ``split`` the pairs of a group with a
    large part of all rows are made in many tasks. Where only components matter, ``skew.stars`` makes a row a member."""
    slim = df.select(F.col(key).alias("_k"), *on).dropna(subset=list(on))
    if split:
        packed = stored(slim.select("_k", F.struct(*on).alias("_on")), "pairs")  # read three times
        heavy = heavy_keys(packed, "_on")
        return join_split(packed.toDF("left", "_on"), packed.toDF("right", "_on"), "_on", "left", heavy, rows=copied_rows(packed, "_on", heavy)).where("left < right").select("left", "right", "_on.*")
    a, b = slim.withColumnRenamed("_k", "left"), slim.withColumnRenamed("_k", "right")
    return a.join(b, list(on)).where("left < right").select("left", "right", *on)


def overlap_pairs(df: DataFrame, key: str, array: str) -> DataFrame:
    """(left, right, shared): rows whose arrays share an element, with the smallest one. The pairs of an element with a large
    part of all rows are made in many tasks."""
    flat = df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(array)).alias("shared")).where(F.col("shared").isNotNull())
    flat = stored(flat, "overlap")  # read several times
    heavy = heavy_keys(flat, "shared")
    a, b = flat.withColumnRenamed("_k", "left"), flat.withColumnRenamed("_k", "right")
    return join_split(a, b, "shared", "left", heavy, rows=copied_rows(flat, "shared", heavy)).where("left < right").groupBy("left", "right").agg(F.min("shared").alias("shared"))


def first_match(left: DataFrame, right: DataFrame, on, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each left row with its first match in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return left.join(right, on).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def alias_lookup(df: DataFrame, by: str, table: DataFrame, value: str, floor: float) -> DataFrame:
    """``value`` by alias, else by canonical name, else the floor. ``table``: name, aliases, value."""
    alias = table.select(F.explode("aliases").alias("_a"), F.col("name").alias("_n1"), F.col(value).alias("_v1"))
    alias = first_wins_by(alias, "_a", "_n1")
    name = first_wins_by(table.select(F.col("name").alias("_n2"), F.col(value).alias("_v2")), "_n2", "_v2")
    out = df.join(alias, df[by] == F.col("_a"), "left").join(name, df[by] == F.col("_n2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2", F.lit(floor))).drop("_a", "_n1", "_v1", "_n2", "_v2")


def first_wins_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def artifact_pairs(members: DataFrame, artifact: str, person: str) -> DataFrame:
    """Pairs of distinct persons on one artifact, smaller id first, with the artifact and both sides' columns (a_, b_). The
    pairs of an artifact with a large part of all members are made in many tasks."""
    members = stored(members, "members")  # read several times
    heavy = heavy_keys(members, artifact)
    rest = [c for c in members.columns if c not in (artifact, person)]
    a = members.select(artifact, F.col(person).alias("person_a"), *(F.col(c).alias(f"a_{c}") for c in rest))
    b = members.select(artifact, F.col(person).alias("person_b"), *(F.col(c).alias(f"b_{c}") for c in rest))
    return join_split(a, b, artifact, "person_a", heavy, rows=copied_rows(members, artifact, heavy)).where("person_a < person_b")


def shared_counts(members: DataFrame, artifact: str, person: str) -> tuple[DataFrame, int]:
    """(person_a, person_b, n): on how many artifacts two persons are, smaller id first; and the number of pairs counted. Members
    and pairs are put together in tasks of a bounded number of rows, as their numbers are known before."""
    slim = members.select(artifact, person).dropna()
    slim = in_parts(slim, [artifact], slim.count()).distinct().withColumn("_n", F.count("*").over(Window.partitionBy(artifact)))
    slim = stored(slim, "shared-members")  # read several times
    every = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("ends")).first()
    large = slim.where(F.col("_n") > max(HEAVY_ROWS, every["rows"] // HEAVY_KEYS))
    a, b = slim.select(artifact, F.col(person).alias("person_a")), slim.select(artifact, F.col(person).alias("person_b"))
    rows, pairs = every["rows"] + (PARTS - 1) * large.count(), every["ends"] // 2
    met = join_split(a, b, artifact, "person_a", large.select(artifact).distinct(), rows=rows).where("person_a < person_b").select("person_a", "person_b")
    return in_parts(met, ["person_a", "person_b"], pairs).groupBy("person_a", "person_b").agg(F.count("*").alias("n")), pairs


# ---- folds ------------------------------------------------------------------------------------


def first_known(value: str, order: str | Column) -> Column:
    """Aggregate: the first non-null value in order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order) if isinstance(order, str) else order))


def ordered_union(array: str, order: str) -> Column:
    """Aggregate: elements of arrays, rows in order, each element once."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(array), F.array().cast("array<string>")).alias("a"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda x: x["a"])))


def conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, values): fields with more than one distinct value in a group."""
    sets = df.groupBy(key).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns))
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("values")) for c in columns))
    return sets.select(key, F.explode(fields).alias("x")).select(key, "x.field", "x.values").where(F.size("values") > 1)


def fingerprint(df: DataFrame, most: int = 1000) -> DataFrame:
    """One hash of all rows, whatever their order: a tree over the row hashes. Its depth follows the number of rows, so that
    a node gathers about ``most`` row hashes, or 256 hashes of nodes below."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    depth = max(1, math.ceil(math.log(max(1, df.count()) / most, 256)))
    nodes = df.select(row.alias("h")).groupBy(F.substring("h", 1, 2 * depth).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256)
    for level in range(depth - 1, 0, -1):
        nodes = nodes.groupBy(F.substring("b", 1, 2 * level).alias("p")).agg(joined.alias("h")).withColumnRenamed("p", "b")
    return nodes.agg(joined.alias("fingerprint"))


def profile(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Counts of rows that meet each condition, by key."""
    return df.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in checks.items()), F.count("*").alias("total"))


# ---- windows and order ------------------------------------------------------------------------


def with_share(df: DataFrame, value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with the share of known values (of the groups ``within``) at or below the row's own; null stays null.
    Rows are counted by value first, so the running sum is over distinct values only."""
    keys = list(within)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = [*(F.col(k) for k in keys), F.col(value)]
    running = running_total(counts, order, F.col("_n"), "_upto")
    if keys:
        groups = running.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.max("_upto").alias("_end"))
        both = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), "_start", "_end")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        shares = running.join(both, same)
    else:
        shares = running.crossJoin(F.broadcast(running.agg(F.lit(0).alias("_start"), F.max("_upto").alias("_end"))))  # one row
    shares = shares.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(value).alias("_value"), ((F.col("_upto") - F.col("_start")) / (F.col("_end") - F.col("_start"))).alias(name))
    on = [*(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col(value) == F.col("_value")]
    return df.join(shares, on, "left").drop("_value", *(f"_k_{k}" for k in keys))


def keep_first_per(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(kept, ejected): the first row of each group, and the others."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def core_contributors(df: DataFrame, group: str, amount: str, tie: str, ranks: int = 10, cap: int = 5, least: int = 3, share: float = 0.05) -> DataFrame:
    """Contributors within the first ranks who reach max(least, ceil(share x total)), ``cap`` at most."""
    by_group = Window.partitionBy(group)
    ranked = df.withColumn("total", F.sum(amount).over(by_group)).withColumn("rank", F.row_number().over(by_group.orderBy(F.desc(amount), tie)))
    enough = F.greatest(F.lit(least), F.ceil(share * F.col("total")))
    return ranked.where((F.col("rank") <= min(ranks, cap)) & (F.col(amount) >= enough))


def top_members(df: DataFrame, group: str, share: str, tie: str, most: int = 8, digits: int = 4) -> DataFrame:
    """The largest shares of a group with weights that sum to one."""
    w = Window.partitionBy(group)
    kept = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc(share), tie))).where(F.col("_n") <= most).drop("_n")
    total = F.sum(share).over(w)
    return kept.withColumn("weight", F.round(F.when(total > 0, F.col(share) / total).otherwise(0.0), digits))


def ranked(df: DataFrame, score: str, tie: str, most: int | None = None) -> DataFrame:
    """Best first, unknown scores last, ties by id."""
    out = df.orderBy(F.desc_nulls_last(score), tie)
    return out if most is None else out.limit(most)


def rank_changes(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Ranks by two scores and the places gained."""
    first = global_rank(df, [F.desc_nulls_last(before), F.col(key)], "rank_before")
    return global_rank(first, [F.desc_nulls_last(after), F.col(key)], "rank_after").withColumn("gained", F.col("rank_before") - F.col("rank_after"))


# ---- sets -------------------------------------------------------------------------------------


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(a, b, *rest).unionAll(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def case_folded_options(df: DataFrame, array: str, order: str) -> DataFrame:
    """Distinct elements of arrays, whatever their case; the first spelling in order stands for all."""
    flat = df.select(F.col(order).alias("o"), F.posexplode(array).alias("p", "v"))
    return flat.groupBy(F.lower("v").alias("folded")).agg(F.min_by("v", F.struct("o", "p")).alias("option")).select("option")
