"""Exact duplicates by two passes over a Bloom filter; only rows whose hash may be repeated are shuffled.

1. Texts are read once: the digest of the normalised text (white space of ASCII deleted), its length and the row's number
   are stored, and from there on no text moves.
2. First pass: every task marks ``PROBES`` bits a row in a filter cut into blocks of ``BLOCK`` bits, and hands on, block by
   block, the places it has marked and those it has marked more than once. Merged, a block keeps the bits that were
   marked at least twice. A text that is there twice has marked all its bits twice, wherever its rows lie: none is missed.
3. Second pass: a row whose bits are not all marked twice is alone with its text for certain and passes straight
   through. The others are grouped by digest; groups of very many rows are split over tasks.

The filter has BITS bits a row up to MAX_BITS (32 MiB, so it may be broadcast whatever the table). Beyond 16 million rows
its bits are shared by more rows: more of them are shuffled, 40 bytes each, and the result stays exact. About one in
200 unique texts is shuffled in vain up to there.

Defined results: null texts count as empty; of equal texts the row with the most code points stays, then the smallest id,
rows without id last; of repeated rows with one id exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import absent, drop_stored, map_rows, stored
from tessera.operators.skew import HEAVY_KEYS, HEAVY_ROWS, join_split

BITS, MAX_BITS, PROBES = 16, 1 << 28, 3
BLOCK = 1 << 16  # places within a block are 16-bit numbers
HELD = 1 << 19  # rows whose places a task holds before it hands them on
#: Characters that do not count.
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def blocks_for(rows: int) -> int:
    """Blocks of the filter: a power of two."""
    return max(1, min(MAX_BITS, 1 << max(0, (BITS * rows - 1).bit_length())) // BLOCK)


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 48).bitwiseAND(F.lit(blocks - 1)).cast("int")


def places_of(hashes: np.ndarray) -> np.ndarray:
    """The places of each hash in its block, rows x PROBES: its three lower 16-bit parts."""
    return np.stack([(hashes >> np.uint64(16 * i)) & np.uint64(BLOCK - 1) for i in range(PROBES)], axis=1).astype(np.uint16)


def marks(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, once, more): places that a task has marked, and those it has marked more than once."""

    def hand_on(hashes: list[np.ndarray]) -> list:
        h = np.concatenate(hashes)
        block = ((h >> np.uint64(48)) & np.uint64(blocks - 1)).astype(np.int64)
        at, n = np.unique((block[:, None] * BLOCK + places_of(h)).ravel(), return_counts=True)
        owner, start = np.unique(at // BLOCK, return_index=True)
        once = [x.astype(np.uint16).tobytes() for x in np.split(at % BLOCK, start[1:])]
        more = [(x[m > 1] % BLOCK).astype(np.uint16).tobytes() for x, m in zip(np.split(at, start[1:]), np.split(n, start[1:]))]
        return [owner.tolist(), once, more]

    def rows(parts: Iterator[dict]):
        held, count = [], 0
        for part in parts:
            held.append(np.array(part["h"], np.int64).view(np.uint64))
            count += len(part["h"])
            if count >= HELD:
                yield hand_on(held)
                held, count = [], 0
        if count:
            yield hand_on(held)

    return map_rows(digests.select("h"), "block int, once binary, more binary", rows)


def repeated_bits(marked: DataFrame) -> DataFrame:
    """(block, words): the bits of each block that were marked at least twice, as 64-bit words; blocks without any are left out."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        seen, twice = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
        for once, more in zip(group["once"], group["more"]):
            at = np.frombuffer(once, np.uint16)
            twice[at[seen[at]]] = True
            seen[at] = True
            twice[np.frombuffer(more, np.uint16)] = True
        words = np.packbits(twice, bitorder="little").view(np.int64)
        return pd.DataFrame({"block": [key[0]], "words": [words]} if twice.any() else {"block": [], "words": []})

    return marked.groupBy("block").applyInPandas(merge, "block int, words array<long>")


def may_repeat(digests: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """``digests`` with ``maybe``: whether all bits of the row are marked twice."""
    place = lambda i: F.shiftrightunsigned("h", 16 * i).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    hit = lambda p: F.expr("bit_get(words[{0} div 64], {0} % 64) = 1".format(p))
    probed = digests.withColumn("block", _block(F.col("h"), blocks)).withColumns({f"p{i}": place(i) for i in range(PROBES)})
    joined = probed.join(F.broadcast(bits), "block", "left")  # MAX_BITS at most
    every = hit("p0")
    for i in range(1, PROBES):
        every = every & hit(f"p{i}")
    return joined.select("row", "id", "n_chars", "text_sha256", F.coalesce(every, F.lit(False)).alias("maybe"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id (id of the row that stays), group_size, kept, text_sha256."""
    slim = docs.select(docs[key].alias("id"), F.length(F.coalesce(docs[text], F.lit(""))).cast("long").alias("n_chars"), F.sha2(normalised(docs[text]), 256).alias("text_sha256"))
    digests = stored(slim.withColumn("h", F.xxhash64("text_sha256")).withColumn("row", F.monotonically_increasing_id()), "exact-digests")
    total = digests.count()
    blocks = blocks_for(total)
    bits = stored(repeated_bits(marks(digests, blocks)), "exact-filter")
    probed = stored(may_repeat(digests, bits, blocks), "exact-probed")
    maybe, alone = probed.where("maybe"), probed.where("not maybe")
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("without"), "id", "row")).alias("first")
    groups = stored(maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), first).select("text_sha256", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "exact-groups")
    many = groups.where(F.col("group_size") > max(HEAVY_ROWS, total // HEAVY_KEYS)).select("text_sha256")
    placed = join_split(maybe, groups, "text_sha256", "row", many).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    passed = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    out = stored(passed.unionByName(placed).withColumnRenamed("id", key), "exact-result")
    for done in (digests, bits, probed, groups):
        drop_stored(done)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are. Texts do not move, but for rows that share
    both id and text with the row that stays."""
    an_id, sha, n, stays = (absent(docs, f"_exact_{c}") for c in ("id", "sha", "n", "stays"))
    marked = mark(docs, key, text).where("group_size > 1").select(F.col(key).alias(an_id), F.col("text_sha256").alias(sha), "kept")
    spread = marked.groupBy(an_id, sha).agg(F.count("*").alias(n), F.max("kept").alias(stays))
    spread = stored(spread.where(f"not {stays} or {n} > 1"), "exact-changed")
    same = F.col(f"`{key}`").eqNullSafe(F.col(an_id)) & (F.sha2(normalised(F.col(f"`{text}`")), 256) == F.col(sha))
    rest = docs.join(spread, same, "left_anti")
    again = spread.where(stays)
    if again.isEmpty():
        return rest
    longest = F.row_number().over(Window.partitionBy(an_id, sha).orderBy(F.desc(F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))))))
    return rest.unionByName(docs.join(again, same).withColumn(n, longest).where(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns)))
