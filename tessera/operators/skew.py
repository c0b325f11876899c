"""Joins of many rows to one row a key, where a few keys may hold a large part of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import stored

HEAVY_KEYS, HEAVY_ROWS = 10_000, 100
PARTS = 64  # parts that the rows of a heavy key are dealt into
PART_ROWS = 1_000_000  # rows that one task sorts or groups
PART_MEMBERS = 500  # rows of a part that meet all others of their group
PART_PAIRS = 16  # pairs that a task makes for each row that it may sort


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` to be sent to all workers if it has at most so many rows, which are counted first; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than HEAVY_ROWS rows and more than a HEAVY_KEYS-th of all rows. There are fewer than HEAVY_KEYS of
    them, whatever the table, so they may be sent to all workers."""
    least = max(HEAVY_ROWS, df.count() // HEAVY_KEYS)
    return df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key)


def in_parts(df: DataFrame, on: list[str], rows: int, most: int | None = None) -> DataFrame:
    """``df`` of so many rows dealt by ``on`` into parts of about ``most`` rows (PART_ROWS), so that what a task sorts or groups does not grow
    with the table. Spark itself puts parts together by their packed size, which says little of what they take unpacked, and
    reads a small file in one task whatever is to be done with its rows. Tables that are one part stay as they are."""
    most = most or PART_ROWS
    if rows <= most:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / most)), *on)


def parts_of_pairs(members: int) -> int:
    """Parts that are enough for the pairs of a group of so many rows: each row of a group is copied to all of its parts, and a
    part of PART_MEMBERS rows meets them all."""
    return max(1, min(PARTS, math.ceil(members / PART_MEMBERS)))


def copied_rows(df: DataFrame, key: str, heavy: DataFrame, dealt: int = PARTS) -> int:
    """Rows that ``join_split`` makes of ``df`` as its right side."""
    return df.count() + (dealt - 1) * df.join(F.broadcast(heavy), key, "left_semi").count()


def join_split(left: DataFrame, right: DataFrame, key: str, by: str, heavy: DataFrame, how: str = "inner", rows: int = 0, dealt: int = PARTS) -> DataFrame:
    """``left`` joined to ``right``, which has few rows a key. Rows of ``left`` with a heavy key are ``dealt`` into so many parts by the
    hash of ``by``, and rows of ``right`` with such keys go to all of these. The join is by sorting: sizes are estimated without
    the copies of ``right``, and packed, so that Spark would send to all workers, through the driver, what does not fit there.
    With ``rows``, the number of the larger side's rows, copies included, each task sorts a bounded number of them."""
    marks = F.broadcast(heavy.select(F.col(key), F.lit(True).alias("_heavy")))
    part = F.when(F.col("_heavy"), F.pmod(F.xxhash64(by), F.lit(dealt)).cast("int")).otherwise(0)
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(dealt - 1))).otherwise(F.array(F.lit(0)))
    placed = left.join(marks, key, "left").withColumn("_part", part).drop("_heavy")
    copied = right.join(marks, key, "left").withColumn("_part", F.explode(parts)).drop("_heavy")
    placed, copied = (in_parts(x, [key, "_part"], rows) for x in (placed, copied))
    return placed.join(copied.hint("merge"), [key, "_part"], how).drop("_part")


def stars(df: DataFrame, key: str, on: list[Column | str]) -> DataFrame:
    """(left, right) from the smallest key of each group of rows that agree on ``on`` to each other key of it: as
    connected as all pairs of the group, and one row a member. Groups are split where they are heavy."""
    slim = df.select(F.col(key).alias("right"), F.struct(*on).alias("_on")).where(" and ".join(f"_on.{c} is not null" for c in on)).distinct()
    slim = stored(slim, "stars")  # read three times
    centres = slim.groupBy("_on").agg(F.min("right").alias("left"), F.max("right").alias("_last")).where("left <> _last").drop("_last")
    return join_split(slim, centres, "_on", "right", heavy_keys(slim, "_on")).where("left <> right").select("left", "right", "_on.*")
