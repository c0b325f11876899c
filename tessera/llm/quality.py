"""Quality by hierarchical empirical Bayes.

A logistic model on the shape of a text (fitted on a bounded sample of labelled rows of each class, with its intercept
set to the shares of the classes among all labels) gives each document its evidence. Soft counts of good documents,
summed by host and by path, give posteriors: a path is shrunk toward its host and a host toward the global rate, the
more the fewer documents it has, with prior strengths from the spread between groups. The posterior of a document is
its evidence with the global rate replaced by the rate of its path, in which the document itself is not counted, so
nothing is used twice.

Texts are read once: their log-odds are written beside the other columns before sums are taken.

Defined results: a null text counts as empty and has the features of an empty text; a null host or path is a group of its own;
labels that are null or neither 0 nor 1 are not used; without labelled rows of both kinds, or for an empty table,
fixed coefficients are used; all rows get a score, repeated rows the same.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, stored

#: Labelled rows of each class that the model is fitted on, at most: those with the smallest checksums of their ids.
SAMPLE = 4000
#: Documents whose posterior is at least this stay.
THRESHOLD = 0.35
GROUPS_BROADCAST = 200_000  # groups sent to all workers up to here, else joined by a shuffle

_RUNS = re.compile(r"[^\w\s]{2,}")
NAMES = ("letters", "upper", "marks", "runs", "digits", "pipes", "distinct", "repeats", "word", "lines", "same_lines", "short", "spaces")


def shape(text: str | None) -> list[float]:
    """Shares between 0 and 1 that describe a text."""
    t = text or ""
    n = max(1, len(t))
    words = t.split()
    m = max(1, len(words))
    lines = [x for x in t.split("\n") if x.strip()]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", t)))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", t)))
    marks = sum(map(len, re.findall(r"[^\w\s]+", t)))
    runs = len(_RUNS.findall(t))
    digits = sum(map(len, re.findall(r"\d+", t)))
    repeats = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        letters / n, upper / max(1, letters), min(1.0, 3 * marks / n), min(1.0, runs / m), digits / n,
        min(1.0, t.count("|") / m), (len(set(words)) / m) ** 0.5, repeats / m, min(1.0, n / m / 20),
        min(1.0, len(lines) / m), 1 - len(set(lines)) / max(1, len(lines)), 1 / (1 + m / 10), min(1.0, 2 * (n - letters - marks - digits) / n),
    ]


def expanded(x: list[float]) -> list[float]:
    """Shares, their roots and their squares."""
    return [*x, *(math.sqrt(max(0.0, v)) for v in x), *(v * v for v in x)]


@dataclass
class Model:
    coefficients: list[float]  # intercept first

    def logit(self, x: list[float]) -> float:
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], expanded(x)))
        return max(-12.0, min(12.0, z))


#: Where there is nothing to fit: texts of symbols, capitals, bars or repetition score low.
UNFITTED = Model([4.0, *(-6.0 if n in ("upper", "runs", "pipes", "repeats", "same_lines") else 0.0 for n in NAMES), *[0.0] * (2 * len(NAMES))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> list[float]:
    """Newton steps on the penalised likelihood of standardised features."""
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
    a = np.hstack([np.ones((len(x), 1)), (x - middle) / scale])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    out = w[1:] / scale
    return [float(w[0] - out @ middle), *map(float, out)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Fit on labelled rows, at most SAMPLE a class; only texts and labels are used. The sample has other shares of the
    classes than all labels, so the intercept is moved by the difference of log-odds."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).groupBy("k").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.crc32(F.col("k").cast("string"))
    # Two times SAMPLE ids at most are sent to the workers.
    picked = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(order, "k").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").select("t", "y")

    def rows(parts):
        for part in parts:
            yield [[expanded(shape(t)) for t in part["t"]], part["y"]]

    got = map_rows(sample, "x array<double>, y int", rows).collect()
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return UNFITTED
    coefficients = _logistic(np.array([r["x"] for r in got]), y)
    coefficients[0] += math.log(counts[1] / min(SAMPLE, counts[1])) - math.log(counts[0] / min(SAMPLE, counts[0]))
    return Model(coefficients)


def evidence(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Log-odds of each text."""

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series([model.logit(shape(t)) for t in texts])

    return logit(docs[text])


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean rate and prior strength from the spread of group means (moments, weighted by documents)."""
    r = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("q")).first()
    if not r["n"]:
        return 0.5, 10.0
    mean = min(0.999, max(0.001, r["good"] / r["n"]))
    between = r["q"] - r["n"] * mean * mean  # sum of n (group mean - mean)^2
    sampled = mean * (1 - mean) * max(0, r["g"] - 1)
    scale = r["n"] - r["nn"] / r["n"]
    variance = max(0.0, (between - sampled) / scale) if scale > 0 else 0.0
    return mean, min(1e4, max(2.0, mean * (1 - mean) / variance - 1)) if variance > 1e-9 else 1e4


def score(docs: DataFrame, model: Model, host: Column, path: Column, text: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of ``docs`` with ``evidence`` (log-odds from the text), ``site_rate`` (posterior of
    its path without the document) and ``posterior``, which replace columns of these names; ``prefix`` goes before
    theirs. Sums by path are taken before the shuffle, so one large host costs no more than others."""
    names = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.lit(None).cast("struct<none: int>")
    marked = stored(docs.select(row.alias("row"), host.cast("string").alias("host"), path.cast("string").alias("path"), evidence(docs, model, text).alias("z")), "quality-evidence").withColumn("soft", 1 / (1 + F.exp(-F.col("z"))))
    narrow = stored(marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("good")), "quality-sites")
    hosts = narrow.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rate, strength = _strength(hosts)
    _, inner = _strength(narrow)
    above = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    sites = narrow.join(above, F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("p"), "n", "good", "host_n", "host_good")
    few = narrow.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    joined = marked.join(F.broadcast(sites) if few else sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    # Sums without the document itself; rounding must not take them below 0.
    without = lambda total: F.greatest(F.lit(0.0), F.col(total) - F.col("soft"))
    of_host = (without("host_good") + strength * rate) / (F.col("host_n") - 1 + strength)
    out = joined.withColumn("rate", (without("good") + inner * of_host) / (F.col("n") - 1 + inner))
    odds = F.log(F.col("rate") / (1 - F.col("rate"))) - math.log(rate / (1 - rate))
    made = {f"{prefix}evidence": F.col("z"), f"{prefix}site_rate": F.col("rate"), f"{prefix}posterior": 1 / (1 + F.exp(-(F.col("z") + odds)))}
    return out.select(*(F.col(f"row.`{c}`") for c in names if c not in made), *(c.alias(name) for name, c in made.items()))


def keep_good(docs: DataFrame, model: Model, host: Column, path: Column, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches the threshold, with their own columns only."""
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    kept = score(docs, model, host, path, text, prefix).where(F.col(f"{prefix}posterior") >= threshold)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
