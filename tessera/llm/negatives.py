"""Hard negatives by blocked dense matrix products of anchors against all rows.

1. Vectors are turned into whole numbers held as doubles and stored once, one row an id.
2. Anchors are dealt into waves of about ``WAVE`` by a hash, so that what is sent to the workers has a bound whatever the
   table. A task turns batches of candidates into matrices, orders them by id, and multiplies blocks of anchors with them in
   float64: products and sums of whole numbers below 2^53 are exact. Rows with larger components go through whole numbers of
   any size instead.
3. First pass: each task keeps the five best rows of an anchor's own label and hands them on when it ends; lists of several
   tasks merge by rank, as the best five of all are among the best five of each.
4. Second pass: for each anchor and positive the best rows of other labels whose scores lie in the window, in the same way.

Higher scores come first, ties by the smaller id.

Defined results: rows without id, label or vector, and vectors with a null or a non-finite component take no part; a
shorter vector counts as ending in zeros; of rows that share an id the smallest by label, then vector counts; components
beyond 2^62 count as that, and scores that a long cannot hold as its ends; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, stored

WAVE = 16_384  # anchors sent to the workers at a time, about
BLOCK = 1024  # anchors of one product
ROWS = 4096  # candidates of one product
POSITIVES = 5
LARGEST = float(2**62)
_NONE = -(2**63)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles that hold whole numbers."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.call_function("floor", scale * x.cast("double")).cast("double"))))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width, shorter rows filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers of 64 bits, held at their ends."""
    width = anchors.shape[1]
    most = (float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))) * max(1, width)
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    exact = lambda m: np.vectorize(int, otypes=[object])(m)
    large = np.clip(exact(anchors) @ exact(rows).T, -(2**63) + 1, 2**63 - 1) if width else np.zeros((len(anchors), len(rows)))
    return large.astype(np.int64)


class Best:
    """The best ``k`` (score, id) of each of a number of lists, by descending score and ascending id."""

    def __init__(self, lists: int, k: int):
        self.scores = np.full((lists, k), _NONE, np.int64)
        self.ids = np.full((lists, k), np.iinfo(np.int64).max, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row for each list ``at``, a column for each of ``ids``, which ascend; _NONE where a row does not count."""
        k = self.scores.shape[1]
        able = scores.max(axis=1, initial=_NONE)
        met = (able > _NONE) & (able >= self.scores[at, k - 1])
        at, scores = at[met], scores[met]
        if not len(at):
            return
        all_scores, all_ids = [self.scores[at]], [self.ids[at]]
        here = np.arange(len(at))
        for _ in range(min(k, scores.shape[1])):  # argmax finds the first of equals: the smallest id
            first = scores.argmax(axis=1)
            all_scores.append(scores[here, first][:, None])
            all_ids.append(np.where(all_scores[-1] == _NONE, np.iinfo(np.int64).max, ids[first][:, None]))
            scores[here, first] = _NONE
        s, i = np.hstack(all_scores), np.hstack(all_ids)
        order = np.lexsort((i, ~s), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, id, score) of all that is held."""
        at, place = np.nonzero(self.scores > _NONE)
        return at, self.ids[at, place], self.scores[at, place]


def _pass(candidates: DataFrame, sent: Broadcast, lists: int, k: int, pick: Callable) -> DataFrame:
    """(list, id, score): the best ``k`` of each list over all candidates of a task. ``pick(wave, start, scores, labels, ids)``
    gives (lists, masked scores) for anchors from ``start`` on."""
    width = sent.value["vectors"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, best = sent.value, Best(lists, k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = part["vec_id"].to_numpy()
                order = np.argsort(ids)
                rows, labels, ids = _matrix(part["v"], width)[order], part["label"].to_numpy()[order], ids[order]
                for a in range(0, len(w["ids"]), BLOCK):
                    scores = _scores(w["vectors"][a : a + BLOCK], rows)
                    for at, masked in pick(w, a, scores, labels, ids):
                        best.add(at, masked, ids)
        at, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["list", "id", "score"])

    return candidates.mapInArrow(run, "list long, id long, score long")


def _same(w: dict, a: int, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray):
    mine = slice(a, a + len(scores))
    fits = (w["labels"][mine][:, None] == labels[None]) & (w["ids"][mine][:, None] != ids[None])
    yield np.arange(a, a + len(scores)), np.where(fits, scores, _NONE)


def _in_window(w: dict, a: int, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray):
    mine = slice(a, a + len(scores))
    other = np.where(w["labels"][mine][:, None] != labels[None], scores, _NONE)
    for p in range(w["low"].shape[1]):
        low, high = w["low"][mine, p][:, None], w["high"][mine, p][:, None]
        yield np.arange(a, a + len(scores)) * w["low"].shape[1] + p, np.where((other >= low) & (other <= high), other, _NONE)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each list over all tasks, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def prepared(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v): usable rows, one an id."""
    slim = rows.select(rows[key].cast("long").alias("vec_id"), label.cast("long").alias("label"), rows[vector].alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    one = slim.withColumn("v", whole(F.col("v"), scale)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def mine(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, every: int = 50, scale: int = 256, positives: int = POSITIVES, negatives: int = 3, window: tuple[int, int] = (50, 95), wave: int = WAVE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor (ids divisible by
    ``every``) and each of its first ``positives`` of the same label, the first ``negatives`` of other labels whose score
    lies between ``window`` percent of the positive's."""
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    table = stored(prepared(rows, key, vector, label, scale), "negatives-rows")
    sizes = table.agg(F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    width, waves = sizes["width"] or 0, max(1, -(-sizes["anchors"] // wave))
    low, high = window
    kept: list[DataFrame] = []
    for number in range(waves):
        some = table.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == number)).orderBy("vec_id").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        ids, n = some["vec_id"].to_numpy(), some.num_rows
        anchors = {"ids": ids, "labels": some["label"].to_numpy(), "vectors": _matrix(some["v"].combine_chunks(), width)}
        sent = spark.sparkContext.broadcast(anchors)
        first = stored(merged(_pass(table, sent, n, positives, _same), positives), "negatives-positives")
        sent.unpersist()
        got = first.select("list", "rank", "score").toArrow()  # ``positives`` an anchor of the wave
        # The window's bounds as whole numbers; where there is no positive, nothing lies between.
        lows, highs = np.full((n, positives), 2**63 - 1, np.int64), np.full((n, positives), -(2**63) + 1, np.int64)
        at, place = got["list"].to_numpy(), got["rank"].to_numpy() - 1
        lows[at, place] = [-(-low * s // 100) for s in got["score"].to_pylist()]
        highs[at, place] = [high * s // 100 for s in got["score"].to_pylist()]
        sent = spark.sparkContext.broadcast(anchors | {"low": lows, "high": highs})
        found = merged(_pass(table, sent, n * positives, negatives, _in_window), negatives)
        named = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(n)), "anchor_id": pa.array(ids)}))  # one wave
        pairs = first.join(F.broadcast(named), F.col("list") == F.col("anchor")).select((F.col("list") * positives + F.col("rank") - 1).alias("list"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        kept.append(stored(found.join(pairs, "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-result"))
        sent.unpersist()
        drop_stored(first)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    drop_stored(table)
    if not kept:
        return spark.createDataFrame([], empty)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
