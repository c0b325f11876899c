"""Completions and embeddings as pluggable column functions, tables of answers in their place, and their metering.

A model is any function from a text column to a column: an Arrow function that calls a service, a lookup, or the
deterministic stand-in. Plans take it as an argument, so nothing here talks to a network.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.documents import hashed_embedding
from tessera.functions.text import first_line

Model = Callable[[Column], Column]


@runtime_checkable
class Source(Protocol):
    """Rows by table since a cursor, as ``ingest.drain`` takes them."""

    def fetch(self, cursor: str | None) -> dict[str, DataFrame]: ...


@runtime_checkable
class Sink(Protocol):
    """Takes staged rows of one table."""

    def upsert(self, staged: DataFrame, **options: object) -> object: ...


#: Raw rows to the observed columns of records; the inputs of a run to long score rows (venture_id, category, score, kinds).
Normaliser = Callable[[DataFrame], DataFrame]
Scorer = Callable[[dict], DataFrame]


def hashed(size: int = 1024) -> Model:
    """The stand-in for an embedding model: equal texts get equal unit vectors."""
    return lambda text: hashed_embedding(text, size)


def answered(prompts: DataFrame, prompt: str, answers: DataFrame, fallback: Model | None = None) -> DataFrame:
    """``prompts`` with ``answer`` from a table of answers (prompt_hash, answer), which is the cache of a model's calls; prompts
    without answer go to ``fallback``, or stay null."""
    known = answers.groupBy("prompt_hash").agg(F.max("answer").alias("_known"))
    out = prompts.withColumn("prompt_hash", F.sha2(prompt, 256)).join(known, "prompt_hash", "left")
    value = F.col("_known") if fallback is None else F.coalesce("_known", fallback(F.when(F.col("_known").isNull(), F.col(prompt))))
    return out.withColumn("answer", value).drop("_known")


def profile_embeddings(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, embedding) of every row with a text."""
    return df.where(F.col(text).isNotNull()).select(key, model(F.col(text)).alias("embedding"))


def headlines(facts: DataFrame, key: str, fact: str, order: str, model: Model) -> DataFrame:
    """(key, headline): a person's facts in order of precedence, as one prompt to a model."""
    prompt = facts.where(F.col(fact).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, fact))), lambda x: x[fact]), "; ").alias("_prompt"))
    return prompt.select(key, model(F.col("_prompt")).alias("headline"))


def metered(calls: DataFrame, stage: str, prompt: str, tokens: str) -> DataFrame:
    """(stage, tag, calls, tokens): calls by stage and the first line of their prompts."""
    return calls.groupBy(F.col(stage).alias("stage"), first_line(F.col(prompt)).alias("tag")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))
