"""Document fingerprints from closed syncmers.

A k-mer (over UTF-8 bytes) is chosen when its smallest inner s-mer lies at its first or last position. The
choice depends on the k-mer alone, so a passage gets the same anchors wherever it stands.

Two texts are alike by positional matching of all their anchors: an anchor of one matches the anchor of the other
with its hash (repeated ones in order), and counts if the anchor before or after it matches at the same shift of
positions. The likeness is the share of counted matches in the anchors of both. What is written as a fingerprint is a
sketch of fixed size: the smallest anchor hash of each of ``BINS`` bins.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, and two empty ones are alike (1.0);
a text shorter than a k-mer is one anchor; a lone anchor needs no neighbour; equal texts have equal fingerprints
and a likeness of 1.0. Rows with equal ids follow each other in order of their texts; a null id comes first. Ids that are not
whole numbers follow each other in their own order.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import is_whole, map_rows, with_numbers

K, S = 12, 5
BINS, HEX = 64, 6
ROWS_A_PART = 4000  # least rows of a stretch of neighbouring ids
PARTS_A_PARTITION = 8  # stretches for each shuffle partition, at most: they are read one row after another, so they may be long

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LETTER = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ ((np.arange(1, 257, dtype=np.uint64) * _ODD[1]) >> np.uint64(29))


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and 64-bit hashes of the closed syncmers of ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < K:
        return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), np.uint64)
    letters = _LETTER[np.frombuffer(data, np.uint8)]
    width = n - S + 1
    h = letters[:width].copy()
    for j in range(1, S):
        h *= _MIX
        h += letters[j : j + width]
    h ^= h >> np.uint64(31)
    h *= _ODD[0]
    h ^= h >> np.uint64(27)
    span = K - S + 1
    low, have = h, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    count = n - K + 1
    at = np.flatnonzero((h[:count] == low) | (h[span - 1 : span - 1 + count] == low))
    mixed = h[at] * _ODD[1] + h[at + S - 1] * _ODD[2] + h[at + K - S] * _MIX
    mixed ^= mixed >> np.uint64(32)
    return at, mixed * _ODD[0]


def bins_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins that hold anchors, and the smallest hash of each."""
    hashes = np.sort(hashes)
    where, first = np.unique(hashes >> np.uint64(64 - 6), return_index=True)
    return where.astype(np.int64), (hashes[first] >> np.uint64(34)) & np.uint64(0xFFFFFF)


def write(bins: tuple[np.ndarray, np.ndarray]) -> str:
    """Fixed-width hexadecimal values, ``-`` for empty bins; an empty text gives an empty string."""
    if not len(bins[0]):
        return ""
    out = ["-" * HEX] * BINS
    for b, v in zip(bins[0].tolist(), bins[1].tolist()):
        out[b] = f"{v:06x}"
    return "".join(out)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Keys of anchors: their hashes mixed with how often they came before."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    at = np.arange(len(ordered))
    begins = np.ones(len(ordered), bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    times = np.empty(len(ordered), np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(begins, at, 0))).astype(np.uint64)
    return hashes + times * _ODD[0]


class Anchors:
    """The anchors of a text: positions and hashes, and the keys and positions in order of the keys, made once for all comparisons."""

    def __init__(self, data: bytes):
        self.positions, self.hashes = syncmers(data)
        self._sorted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._sorted is None:
            keys = _numbered(self.hashes)
            order = np.argsort(keys)
            self._sorted = keys[order], self.positions[order], order
        return self._sorted


def likeness(a: Anchors, b: Anchors) -> float:
    """Positional likeness of two sets of anchors."""
    n, m = len(a.positions), len(b.positions)
    if not n or not m:
        return float(n == m)
    keys, positions, order = a.sorted
    others, places, _ = b.sorted
    at = np.searchsorted(others, keys)
    at[at == m] = 0
    met = others[at] == keys
    shift = np.full(n + 2, np.iinfo(np.int64).max)
    shift[order[met] + 1] = places[at[met]] - positions[met]
    own = shift[1:-1]
    counted = (own != np.iinfo(np.int64).max) & ((own == shift[:-2]) | (own == shift[2:]) | (min(n, m) == 1))
    both = int(np.count_nonzero(counted))
    return both / (n + m - both)


def anchors(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per anchor: ``key``, its byte position and its hash, for positional matching by a join on the hash."""
    keyed = df.select(df[key].alias("k"), df[text].alias("t"))

    def rows(parts):
        for part in parts:
            for k, t in zip(part["k"], part["t"]):
                at, h = syncmers((t or "").encode("utf-8"))
                yield [[k] * len(at), at.tolist(), h.view(np.int64).tolist()]

    return map_rows(keyed, f"{key} {keyed.schema['k'].dataType.simpleString()}, position long, hash long", rows)


def by_neighbour(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt into stretches of ascending ids, each followed by the first row of the next stretch (``halo``),
    the last by the very first: every row then stands beside its successor, with one shuffle of the texts. The borders
    are the least ids of range partitions of the ids alone; the driver holds some for each shuffle partition."""
    order = F.coalesce(df[key].cast("long"), F.lit(-(2**63)))
    keyed = df.select(order.alias("o"), df[key].alias("k"), df[text].alias("t"))
    ids = df.select(order.alias("o"))
    count = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = max(1, min(PARTS_A_PARTITION * count, ids.count() // ROWS_A_PART))
    tops = ids.repartitionByRange(parts, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o")).collect()
    first, *cuts = sorted(r["o"] for r in tops) or [0]

    part, is_cut = _part(F.col("o"), cuts)
    here = F.struct(part.alias("part"), F.lit(False).alias("halo"))
    before = F.when(is_cut, F.struct((part - 1).alias("part"), F.lit(True).alias("halo")))
    around = F.when(F.col("o") == first, F.struct(F.lit(len(cuts)).alias("part"), F.lit(True).alias("halo")))
    places = F.filter(F.array(here, before, around), lambda x: x.isNotNull())
    dealt = keyed.withColumn("p", F.explode(places)).select("p.part", "p.halo", "o", "k", "t")
    return dealt.repartition(count, "part").sortWithinPartitions("part", "halo", "o", "t")


def _part(o: Column, cuts: list[int]) -> tuple[Column, Column]:
    """The number of cuts at or below ``o`` and whether ``o`` is a cut: first every n-th cut is compared, then those
    between two of them, n being the root of their number."""
    if not cuts:
        return F.lit(0), F.lit(False)
    step = max(1, int(len(cuts) ** 0.5))
    borders = F.array(F.lit(cuts[0]).cast("long")) if len(cuts) == 1 else F.lit(cuts).cast("array<long>")
    tops = cuts[step - 1 :: step]
    coarse = F.size(F.filter(F.array(F.lit(tops[0]).cast("long")) if len(tops) == 1 else F.lit(tops).cast("array<long>"), lambda c: c <= o)) * step
    below = coarse + F.size(F.filter(F.slice(borders, coarse + 1, F.lit(step)), lambda c: c <= o))
    return below, (below > 0) & (F.element_at(borders, F.greatest(below, F.lit(1))) == o)


def edited_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last quarter (in code points, rounded
    down) is replaced by the start of the next text."""
    if not is_whole(df, key):
        ranked, ids = with_numbers(df.select(key, text), key)
        named = edited_pairs(ranked, key, text).join(ids, F.col(f"`{key}`") == F.col("rank"), "left")
        return named.select(F.col("id").alias(key), *(c for c in named.columns if c not in (key, "rank", "id")))
    dealt = by_neighbour(df, key, text)

    def rows(parts):
        held = None
        for batch in parts:
            out = []
            for part, halo, k, t in zip(batch["part"], batch["halo"], batch["k"], batch["t"]):
                t = t or ""
                found = Anchors(t.encode("utf-8"))
                if held is not None:
                    before, own, sketch = held[1:]
                    q = len(before) // 4
                    edited = (before[: len(before) - q] + t[:q]).encode("utf-8")
                    changed = Anchors(edited)
                    out.append((held[0], len(before), hashlib.sha256(edited).hexdigest(), sketch, write(bins_of(changed.hashes)), likeness(own, changed), likeness(own, found)))
                held = None if halo else (k, t, found, write(bins_of(found.hashes)))
            yield list(zip(*out)) if out else [[] for _ in range(7)]

    return map_rows(dealt, f"{key} {df.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", rows)
