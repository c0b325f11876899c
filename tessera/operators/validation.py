"""Constraint checks: each is a DataFrame of violations (check, key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import in_parts


def _violations(df: DataFrame, name: str, key: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), key.cast("string").alias("key"))


def foreign_key(name: str, child: DataFrame, column: str, parent: DataFrame, target: str) -> DataFrame:
    """Rows whose parent is not there. Both sides are dealt by key into parts of a bounded number of rows; of a part the parents'
    keys are held, and children, of which a key may have very many, pass by."""
    held, known = child.select(column).where(F.col(column).isNotNull()), parent.select(F.col(target).alias(column))
    rows = max(held.count(), known.count())
    lost = in_parts(held, [column], rows).join(in_parts(known, [column], rows).hint("shuffle_hash"), column, "left_anti")
    return _violations(lost, name, F.col(column))


def unique(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that several rows have. Most have one, so rows are dealt by key before they are counted."""
    slim = df.select(*columns)
    twice = in_parts(slim, list(columns), slim.count()).groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return _violations(twice, name, F.concat_ws("/", *columns))


def one_of(name: str, df: DataFrame, column: str, values: Sequence, key: str) -> DataFrame:
    return _violations(df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)), name, F.col(key))


def in_range(name: str, df: DataFrame, column: str, low: float, high: float, key: str) -> DataFrame:
    return _violations(df.where((F.col(column) < low) | (F.col(column) > high)), name, F.col(key))


def one_flagged(name: str, df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """At most one row of a group carries the flag."""
    return unique(name, df.where(flag), columns)


def unit_length(name: str, df: DataFrame, column: str, key: str, tolerance: float = 1e-3) -> DataFrame:
    norm = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return _violations(df.where(F.abs(F.sqrt(norm) - 1) > tolerance), name, F.col(key))


def recomputed(name: str, df: DataFrame, column: str, expression: Column, key: str) -> DataFrame:
    """Stored values that differ from what the expression gives."""
    return _violations(df.where(~F.col(column).eqNullSafe(expression)), name, F.col(key))


def summary(checks: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """(check, violations) for every check, 0 where all is well."""
    spark = checks[0].sparkSession
    every = spark.createDataFrame([(n,) for n in names], "check string")
    found = None
    for c in checks:
        found = c if found is None else found.unionByName(c)
    return every.join(found.groupBy("check").agg(F.count("*").alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("violations"))
