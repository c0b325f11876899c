"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed pseudo-random order, form blocks. The fluid schedule gives every source that has blocks
left a share of each slot in proportion to its weight; when a source runs out, the others go on with their weights
from there. At virtual time v source i has had min(w_i v, blocks of i) blocks, and the slot at v is the sum of these:
all exact, in whole numbers, for any weights. Block j is released at the slot in which the fluid schedule begins it and
due by the slot in which it ends it; taking the earliest deadline among the released blocks fills every slot and keeps
each source within less than one block of its fluid share at every slot.

A block is a fixed part of the table (one BLOCKS-th), so the schedule that the driver plans has about BLOCKS entries,
and one for each source, whatever the rows: its work is in O(n log n) of these.

Defined results: rows without source are a source of their own; rows that repeat share the order of their
hashes and each keep a position; every row is kept; a weight that is missing or not above 0 counts as the least
there is; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cmp_to_key
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1 << 18  # blocks of a table, about
BROADCAST_SOURCES = 200_000  # sources whose sizes are sent to all workers up to here, else joined by a shuffle
ROWS_A_BUCKET = 1000  # rows that are ordered together, about; a source has as many buckets as it needs


class Fluid:
    """The fluid schedule of whole-number weights and blocks: when each source has had how much."""

    def __init__(self, weights: list[int], blocks: list[int]):
        self.weights, self.blocks = weights, blocks
        order = sorted((i for i, n in enumerate(blocks) if n), key=cmp_to_key(lambda a, b: blocks[a] * weights[b] - blocks[b] * weights[a]))
        self.ends = order  # sources in the order in which they run out
        self.over, self.rate = [0], [sum(weights[i] for i in order)]  # blocks of those gone, weight of those left
        for i in order:
            self.over.append(self.over[-1] + blocks[i])
            self.rate.append(self.rate[-1] - weights[i])

    def slot(self, source: int, count: int) -> tuple[int, int]:
        """The slot, as numerator and denominator, at which the source has had ``count`` blocks."""
        w = self.weights[source]
        low, high = 0, len(self.ends)
        while low < high:  # sources that run out before: blocks / weight below count / w
            k = (low + high) // 2
            i = self.ends[k]
            if self.blocks[i] * w < count * self.weights[i]:
                low = k + 1
            else:
                high = k
        return self.over[low] * w + count * self.rate[low], w


def schedule(weights: list[int], blocks: list[int]) -> list[np.ndarray]:
    """The slots of the blocks of each source: earliest deadline first among released blocks."""
    fluid = Fluid(weights, blocks)
    out = [np.zeros(n, np.int64) for n in blocks]
    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release of the next
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            over, w = fluid.slot(i, j + 1)
            heapq.heappush(ready, (-(-over // w), i, j, over // w))
        _, i, j, following = heapq.heappop(ready)
        out[i][j] = slot
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, (following, i, j + 1))
    return out


@dataclass
class Schedule:
    """Where each block of each source goes."""

    names: list
    slots: list[np.ndarray]  # of each source
    block: int
    short: list[int] = field(default_factory=list)  # slots of blocks that are not full, ascending
    missing: list[int] = field(default_factory=list)  # rows missing up to and with each of them

    def before(self, slot: int) -> int:
        """Rows in the slots before ``slot``."""
        k = bisect_left(self.short, slot)
        return slot * self.block - (self.missing[k - 1] if k else 0)


def whole_numbers(weights: list) -> list[int]:
    """Weights (integers, fractions, decimals or floats) in exact proportion."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact)) if exact else 1
    return [int(w * scale) for w in exact]


def plan(counts: dict, weights: dict, block: int | None = None) -> Schedule:
    """counts: rows of each source; weights: its target weight; block: rows of a block, if not a BLOCKS-th of all."""
    block = block or max(1, -(-sum(counts.values()) // BLOCKS))
    names = sorted(counts, key=lambda s: (s is not None, str(s)))
    least = min((w for w in weights.values() if w and w > 0), default=1)
    target = [w if (w := weights.get(s)) and w > 0 else least for s in names]
    blocks = [-(-counts[s] // block) for s in names]
    out = Schedule(names, schedule(whole_numbers(target), blocks), block)
    lacking = sorted((int(out.slots[i][-1]), -counts[s] % block) for i, s in enumerate(names) if counts[s] % block)
    out.short = [s for s, _ in lacking]
    out.missing = np.cumsum([m for _, m in lacking]).tolist() if lacking else []
    return out


def numbered(df: DataFrame, source: str, key: str) -> tuple[DataFrame, dict]:
    """(row, source, rank): each row of ``df`` as a struct, so that no name of its columns matters, with its place in its
    source by the hash of its key; and the rows of each source, of which the driver holds one number each. Sources are
    cut into buckets by hash, numbered by themselves and then offset, so no source is handled whole."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), df[source].alias("source"), df[key].alias("key"))
    sizes = packed.groupBy("source").agg(F.count("*").alias("n"))
    counts = {r["source"]: r["n"] for r in sizes.collect()}
    spread = sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") / ROWS_A_BUCKET).alias("spread"))
    marked = packed.join(F.broadcast(spread) if len(counts) <= BROADCAST_SOURCES else spread, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("h", F.xxhash64(F.lit("mix"), F.col("key").cast("string")))
    marked = marked.withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("spread")).cast("int")).drop("spread")
    groups = marked.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    offsets = groups.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("s", "b", F.coalesce("before", F.lit(0)).alias("before"))
    within = marked.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "key")) - 1)
    joined = within.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("row", "source", (F.col("rank") + F.col("before")).alias("rank")), counts


def root_weights(counts: dict) -> dict:
    """Target weights in proportion to the square root of a source's rows: large sources are toned down."""
    return {s: n**0.5 for s, n in counts.items()}


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights=root_weights, block: int | None = None, prefix: str = "") -> DataFrame:
    """All columns of ``df`` with ``block`` (of the source), ``slot`` (of the block) and ``position`` (of the row,
    0 on, without gaps), which replace columns of these names; ``prefix`` goes before theirs. ``weights``: of each source, or a function of their row counts."""
    ranked, counts = numbered(df, source, key)
    planned = plan(counts, weights(counts) if callable(weights) else weights, block)
    number = {s if s is None else str(s): i for i, s in enumerate(planned.names)}

    @F.pandas_udf("struct<block long, slot long, position long>")
    def place(names: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = []
        for s, r in zip(names.tolist(), ranks.tolist()):
            at, rest = divmod(r, planned.block)
            slot = int(planned.slots[number[s]][at])
            out.append((at, slot, planned.before(slot) + rest))
        return pd.DataFrame(out, columns=["block", "slot", "position"])

    placed = ranked.select("row", place(F.col("source").cast("string"), F.col("rank")).alias("at"))
    made = {f"{prefix}{c}": c for c in ("block", "slot", "position")}
    return placed.select(*(F.col(f"row.`{c}`") for c in df.columns if c not in made), *(F.col(f"at.{c}").alias(name) for name, c in made.items()))


def in_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Rows laid out by position: partitions are ranges of it, sorted within."""
    return mixed.repartitionByRange(F.col(position)).sortWithinPartitions(position)
