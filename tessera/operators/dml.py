"""Keyed writes as DataFrame rewrites: upserts with change detection and suppression, flips, erasure, backfill.

Every function returns the new version of a table (or only its changed rows); the caller writes it once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ids import key_hash

INSERTED, UPDATED, UNCHANGED = "inserted", "updated", "unchanged"


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with equal keys the last in ``order``; rows with a null key never match anything and go."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))
    return df.dropna(subset=list(keys)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def comparable(df: DataFrame, name: str, alias: str) -> Column:
    """A column in a form that null-safe equality accepts: nested and variant values as JSON."""
    kind = df.schema[name].dataType
    c = F.col(f"{alias}.{name}")
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else c


def suppress(staged: DataFrame, suppressed: DataFrame, key: str, source: Column | str | None = None) -> DataFrame:
    """Rows whose (source, hash of key) is not suppressed. ``suppressed``: source, key_hash."""
    return staged.join(suppressed, _suppression(staged, suppressed, key, source), "left_anti")


def suppressed_rows(staged: DataFrame, suppressed: DataFrame, key: str, source: Column | str | None = None) -> DataFrame:
    return staged.join(suppressed, _suppression(staged, suppressed, key, source), "left_semi")


def _suppression(staged: DataFrame, suppressed: DataFrame, key: str, source) -> Column:
    match = key_hash(staged[key]) == suppressed["key_hash"]
    if source is not None:
        match = match & (suppressed["source"] == (staged[source] if isinstance(source, str) else source))
    return match


def _once(keys: Sequence[str]) -> Column:
    """True; an error where several rows have one (known) key, since no order between them is known."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    message = F.concat_ws(" ", F.lit("several staged rows have the key"), *(F.col(k).cast("string") for k in keys))
    return F.when(known & (F.count("*").over(Window.partitionBy(*keys)) > 1), F.raise_error(message).cast("boolean")).otherwise(True)


def _differs(target: DataFrame, staged: DataFrame, keys: Sequence[str], hash_column: str | None) -> Column:
    """Whether row ``s`` is another than ``t``: by content hash where there is one, else by any other column, null-safe."""
    if hash_column in target.columns:
        return F.coalesce(F.col(f"t.{hash_column}") != F.col(f"s.{hash_column}"), F.lit(False))
    same = F.lit(True)
    for c in target.columns:
        if c not in keys:
            same = same & comparable(target, c, "t").eqNullSafe(comparable(staged, c, "s"))
    return ~same


def upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str], hash_column: str | None = "content_hash") -> DataFrame:
    """The merged table with ``action``. A staged row updates its match when the two differ; it is inserted when nothing
    matches. One full join on the keys, null keys apart. Several staged rows of one key are an error."""
    columns = target.columns
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), staged.select(*columns).withColumn("_s", _once(keys)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    changed = _differs(target, staged, keys, hash_column)
    action = F.when(F.col("t._t").isNull(), INSERTED).when(F.col("s._s").isNotNull() & changed, UPDATED).otherwise(UNCHANGED)
    joined = t.join(s, on, "full").withColumn("action", action)
    take_new = F.col("action").isin(INSERTED, UPDATED)
    return joined.select(*(F.when(take_new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns), "action")


def changes(target: DataFrame, staged: DataFrame, keys: Sequence[str], hash_column: str | None = "content_hash") -> DataFrame:
    """The staged rows that an upsert would insert or change, with ``action``: the delta alone. ``target`` needs the keys and
    the content hash, or all columns where there is none."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), staged.withColumn("_s", _once(keys)).alias("s")
    action = F.when(F.col("t._t").isNull(), INSERTED).when(_differs(target, staged, keys, hash_column), UPDATED)
    joined = s.join(t, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "left").withColumn("action", action)
    return joined.where(F.col("s._s") & F.col("action").isNotNull()).select(*(F.col(f"s.{c}") for c in staged.columns), "action")


def upsert_counts(target: DataFrame, staged: DataFrame, keys: Sequence[str], hash_column: str | None = "content_hash", suppressed: DataFrame | None = None, key: str | None = None, source=None) -> DataFrame:
    """One row: staged, suppressed, inserted, updated, skipped_unchanged."""
    guarded = suppress(staged, suppressed, key, source) if suppressed is not None else staged
    merged = upsert(target, guarded, keys, hash_column)
    done = merged.agg(F.count_if(F.col("action") == INSERTED).alias("inserted"), F.count_if(F.col("action") == UPDATED).alias("updated"))
    blocked = suppressed_rows(staged, suppressed, key, source) if suppressed is not None else staged.limit(0)
    sizes = staged.agg(F.count("*").alias("staged")).crossJoin(blocked.agg(F.count("*").alias("suppressed")))
    return sizes.crossJoin(done).withColumn("skipped_unchanged", F.expr("staged - suppressed - inserted - updated"))


def overlay(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge on read: rows of ``changes`` replace rows of ``base`` with their keys, and the rest is added."""
    return base.join(changes.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` in some column, null-safe."""
    b, a = before.withColumn("_was", F.lit(True)).alias("b"), after.alias("a")
    same = F.lit(True)
    for c in after.columns:
        same = same & comparable(after, c, "a").eqNullSafe(comparable(before, c, "b"))
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "left")
    return joined.where(F.col("b._was").isNull() | ~same).select("a.*")


def append_latest(history: DataFrame, new: DataFrame, keys: Sequence[str], flag: str = "is_latest") -> DataFrame:
    """History with ``new`` added as latest; earlier latest rows of the same keys are turned off."""
    hit = new.select(*keys).distinct().withColumn("_hit", F.lit(True))
    old = history.join(hit, list(keys), "left").withColumn(flag, F.col(flag) & F.col("_hit").isNull()).select(*history.columns)
    return old.unionByName(new.withColumn(flag, F.lit(True)).select(*history.columns))


def latest(history: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of each key, whatever the flags say."""
    return first_wins(history, keys, order)


def invalidate(scores: DataFrame, affected: DataFrame, keys: Sequence[str], flag: str = "is_latest") -> DataFrame:
    """Scores whose keys are affected lose their flag."""
    hit = affected.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return scores.join(hit, list(keys), "left").withColumn(flag, F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(flag))).select(*scores.columns)


def erase(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], subjects: DataFrame, subject: str) -> dict[str, DataFrame]:
    """Each table without rows whose key columns (any of them) name a subject. ``keys``: table -> columns."""
    out = {}
    for name, df in tables.items():
        for c in keys.get(name, ()):
            df = df.join(subjects.select(F.col(subject).alias(c)).distinct(), c, "left_anti").select(*df.columns)
        out[name] = df
    return out


def suppression_rows(subjects: DataFrame, source: Column, key: str) -> DataFrame:
    """What to remember of erased keys: source and hash only."""
    return subjects.select(source.alias("source"), key_hash(subjects[key]).alias("key_hash")).distinct()


@dataclass
class Erasure:
    """What an erasure changes: tables without the subjects, and what remains of them."""

    tables: dict[str, DataFrame]
    suppressed: DataFrame  # source, key_hash
    tombstones: DataFrame  # subject_id, erased_at
    audit: DataFrame  # table, rows taken out


def erasure_plan(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], subjects: DataFrame, key: str, source: Column, subject_id: str, erased_at: Column) -> Erasure:
    """The whole plan from one list of subjects: every table without them, their keys as hashes, a tombstone a subject, and the
    number of rows that each table loses."""
    audit = None
    for name, columns in keys.items():
        df, hit = tables[name], F.lit(False)
        for i, c in enumerate(columns):
            df = df.join(subjects.select(F.col(key).alias(c)).distinct().withColumn(f"_hit{i}", F.lit(True)), c, "left")
            hit = hit | F.coalesce(f"_hit{i}", F.lit(False))
        counted = df.agg(F.count_if(hit).alias("rows")).select(F.lit(name).alias("table"), "rows")
        audit = counted if audit is None else audit.unionByName(counted)
    tombstones = subjects.select(F.col(subject_id).alias("subject_id")).distinct().withColumn("erased_at", erased_at)
    return Erasure(erase(tables, keys, subjects, key), suppression_rows(subjects, source, key), tombstones, audit)


def backfill(facts: DataFrame, links: DataFrame, on: str, value: str) -> DataFrame:
    """Facts whose cached ``value`` differs from their active link's, with the new value: changed rows only."""
    new = links.where(F.col("status") == "active").select(on, F.col(value).alias("_new"))
    joined = facts.join(new, on)
    return joined.where(~F.col(value).eqNullSafe(F.col("_new"))).withColumn(value, F.col("_new")).select(*facts.columns)


def transition(df: DataFrame, when: Column, state: str, at: Column, actor: str, history: str = "history", column: str = "state", allowed: Iterable[str] | None = None) -> DataFrame:
    """Rows that meet ``when`` (and stand in an allowed state) move to ``state``; the step is added to their history."""
    move = when if allowed is None else when & F.col(column).isin(*allowed)
    step = F.struct(F.lit(state).alias("state"), at.alias("ts"), F.lit(actor).alias("actor"))
    grown = F.array_append(F.coalesce(F.col(history), F.array().cast(df.schema[history].dataType)), step.cast(df.schema[history].dataType.elementType))
    return df.withColumn(history, F.when(move, grown).otherwise(F.col(history))).withColumn(column, F.when(move, state).otherwise(F.col(column)))
