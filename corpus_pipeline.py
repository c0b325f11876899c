"""The corpus pipeline over documents: toxicity, quality, near duplicates, mixing, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``; their decisions are the rows that stay and, in mixing, the order of the rows.
Spark does not read part files in the order of their rows, so the last stage gives each row its place in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, neardup, quality, toxicity
from tessera.llm.common import drop_stored, stored, table, temporary
from tessera.llm.queries import WORD_VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects. Rows held out of the toxicity query are held out here too."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose posterior quality is low."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, F.col("source"), F.col("lang"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_one(docs)


def place(docs: DataFrame) -> DataFrame:
    """``docs`` with their positions in the mix. These follow from the ids and sources alone, not from the order of the rows."""
    return mixing.mix(docs, prefix="_mix_")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    mixed = place(docs)
    return mixing.in_order(mixed, "_mix_position").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, with ``position`` in the mix, laid out by it."""
    keyed = docs.select(F.struct("doc_id", "source").alias("_row"), "text")
    encoded = stored(bpe.encode_column(keyed, "_row", "text", WORD_VOCABULARY).select("_row.*", "n_tokens", "ids_sha256", "decoded_sha256"), "pipeline-encoded")
    placed = place(encoded).withColumnRenamed("_mix_position", "position")
    return mixing.in_order(placed).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses none of the stages; tests hold each against a plain Python version of it on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. Tables that a stage needed go when its rows are written, and its rows when the next
    stage's are: the result of the last one stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            drop_stored(before)
        before = docs
    return mixing.in_order(docs)
