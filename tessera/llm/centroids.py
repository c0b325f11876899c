"""Clusters of vectors around centroids by Sort-means on whole numbers.

1. Kept vectors are scaled to whole numbers (held as doubles) and stored. The first centroids are the vectors with the
   smallest hashes of their ids.
2. Each round the other centroids of every centroid are sorted by their distance from it. A vector starts from its centroid
   of the round before, and looks at the others in that order only while they are within twice its distance to
   that one: by the triangle inequality none beyond can be nearer. The stop is strict, so that ties are seen and go to
   the smaller number.
3. A round is one pass over the stored table, which writes each vector with its new centroid and, at the end of a task, one
   row of sums a centroid. The next centroids are exact floors of those sums, of which the driver holds one row a
   centroid. No vector moves between tasks, so a cluster of any size is no load on one task.

Squared distances of whole numbers below 2^53 are exact in float64; vectors with larger components go through whole
numbers of any size.

Defined results: only vectors of ``width`` components, none null or non-finite, are kept; with fewer vectors than centroids
there are as many centroids as vectors; equal vectors may be several centroids, of which the first gets them all;
components beyond 2^62 count as that, and sums that a long cannot hold as its ends; vectors without id are placed
but found no cluster (where none has an id, the smallest vector does); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, stored
from tessera.llm.negatives import usable, whole

CENTROIDS, ROUNDS = 8, 10
ROWS = 8192  # vectors placed at a time
_EXACT = 2.0**53
_LONG = 2**63 - 1

#: A row is a vector with its centroid, or (``n`` set) the sums of a centroid over a task.
SCHEMA = "id {id}, v array<double>, c int, distance long, n long, sums array<decimal(38,0)>, spread decimal(38,0)"


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centre, as whole numbers: int64, or Python's where they could be larger."""
    reach = max(float(np.abs(rows).max(initial=0)), float(np.abs(centre).max(initial=0)))
    if 4 * reach * reach * max(1, rows.shape[1]) < _EXACT:
        apart = rows - centre
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    apart = to_int(rows) - to_int(centre)
    return (apart * apart).sum(axis=1)


def neighbours(centres: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each centre the others as (squared distance, number), nearest first."""
    out = []
    for c in range(len(centres)):
        apart = squared(centres, centres[c])
        out.append(sorted((int(apart[o]), o) for o in range(len(centres)) if o != c))
    return out


def place(rows: np.ndarray, before: np.ndarray, centres: np.ndarray, order: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and squared distance of each row, from its centre ``before``."""
    best, distance = before.copy(), None
    for c in np.unique(before):
        mine = np.flatnonzero(before == c)
        x = rows[mine]
        start = squared(x, centres[c])
        near, at, reach = start.copy(), np.full(len(mine), c), 4 * start  # squares, so twice is four times
        going = np.arange(len(mine))
        for apart, other in order[c]:
            going = going[reach[going] >= apart]
            if not len(going):
                break
            d = squared(x[going], centres[other])
            better = (d < near[going]) | ((d == near[going]) & (other < at[going]))
            near[going[better]], at[going[better]] = d[better], other
        if distance is None:
            distance = np.zeros(len(rows), near.dtype)
        if near.dtype == object and distance.dtype != object:
            distance = distance.astype(object)
        best[mine], distance[mine] = at, near
    return best, np.zeros(0, np.int64) if distance is None else distance


def _decimal(x: int) -> Decimal:
    return Decimal(max(-(10**38) + 1, min(10**38 - 1, int(x))))


def assigned(vectors: DataFrame, centres: np.ndarray, with_sums: bool = True) -> DataFrame:
    """One pass: vectors with their centroids, and a row of sums a task and centroid."""
    order, width, k = neighbours(centres), centres.shape[1], len(centres)
    schema = SCHEMA.format(id=vectors.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, spread = np.zeros((k, width), object), np.zeros(k, np.int64), [0] * k
        form = None
        for batch in batches:
            form = pa.schema([("id", batch.schema.field("id").type), ("v", batch.schema.field("v").type), ("c", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("spread", pa.decimal128(38, 0))])
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                best, distance = place(rows, part["c"].to_numpy().astype(np.int64), centres, order)
                exact = float(np.abs(rows).max(initial=0)) * len(rows) < _EXACT
                for c in np.unique(best):
                    mine = best == c
                    counts[c] += int(mine.sum())
                    spread[c] += sum(distance[mine].tolist())
                    total = rows[mine].sum(axis=0) if exact else np.vectorize(int, otypes=[object])(rows[mine]).sum(axis=0)
                    sums[c] += np.array([int(x) for x in total], object)
                held = [min(_LONG, int(d)) for d in distance] if distance.dtype == object else distance
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array(best, pa.int32()), pa.array(held, pa.int64()), *(pa.nulls(part.num_rows, form.field(f).type) for f in ("n", "sums", "spread"))], schema=form)
        if form is not None and with_sums:
            some = [c for c in range(k) if counts[c]]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(some), form.field("id").type), pa.nulls(len(some), form.field("v").type), pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), pa.array([int(counts[c]) for c in some], pa.int64()),
                pa.array([[_decimal(x) for x in sums[c]] for c in some], pa.list_(pa.decimal128(38, 0))), pa.array([_decimal(spread[c]) for c in some], pa.decimal128(38, 0)),
            ], schema=form)

    return vectors.mapInArrow(run, schema)


def moved(placed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres of the next round: exact floors of sum / count; a centre without vectors stays."""
    parts = placed.where("n is not null").select("c", "n", F.posexplode("sums").alias("i", "s"))
    got = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # one row a centroid and component
    out = centres.copy()
    for r in got:
        out[r["c"], r["i"]] = float(int(r["s"]) // r["n"])
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: ``key``, cluster, distance, cluster_inertia, inertia; the final centroids)."""
    v = df[vector]
    kept = df.where(usable(v) & (F.size(v) == width)).select(df[key].alias("id"), whole(v, scale).alias("v"), F.lit(0).alias("c"))
    table = stored(kept, "centroids-vectors")
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = table.where(F.col("id").isNotNull()).orderBy(h, "v").select("v").limit(k).collect()
    if not first:
        first = table.orderBy("v").select("v").limit(1).collect()
    centres = np.array([r["v"] for r in first], float).reshape(len(first), width)
    if not len(centres):
        empty = table.select(F.col("id").alias(key), F.col("c").alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")))
        return empty, centres
    for number in range(rounds + 1):
        placed = stored(assigned(table.select("id", "v", "c"), centres) if number == 0 else assigned(table.where("n is null").select("id", "v", "c"), centres), "centroids-round")
        drop_stored(table)
        table = placed
        if number < rounds:
            centres = moved(placed, centres)
    held = lambda s: F.least(s, F.lit(_LONG)).cast("long")
    spreads = table.where("n is not null").groupBy("c").agg(F.sum("spread").alias("s"))  # one row a centroid
    total = spreads.agg(F.sum("s").alias("all"))
    sums = F.broadcast(spreads.crossJoin(F.broadcast(total)).select("c", held(F.col("s")).alias("cluster_inertia"), held(F.col("all")).alias("inertia")))
    out = stored(table.where("n is null").select("id", "c", "distance").join(sums, "c").select(F.col("id").alias(key), F.col("c").alias("cluster"), "distance", "cluster_inertia", "inertia"), "centroids-result")
    drop_stored(table)
    return out, centres


def digests(centres: np.ndarray) -> list[str]:
    """The digest of each centroid: its components as decimal numbers, joined by commas."""
    return [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres]


def with_digest(clustered: DataFrame, centres: np.ndarray, column: Column | None = None) -> DataFrame:
    found = digests(centres)
    named = F.array(*map(F.lit, found)) if found else F.array(F.lit(""))
    return clustered.withColumn("centroid_sha256", F.get(named, F.col("cluster") if column is None else column))
