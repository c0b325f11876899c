"""Readers: JSON lines, snapshots, link archives, Parquet by path, feeds, documents. All give DataFrames with declared schemas."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.catalog import Table

MOST_TEXT = 20_000  # characters kept of a document's text


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a schema; a missing file is an empty table, blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def snapshot(spark: SparkSession, folder: str, tables: dict[str, Table]) -> dict[str, DataFrame]:
    """All tables of a folder, lazily."""
    return {n: jsonl(spark, f"{folder}/{n}.jsonl", t.schema) for n, t in tables.items()}


class UnknownFormat(ValueError):
    pass


def links(spark: SparkSession, path: str) -> DataFrame:
    """A link archive by its extension: Parquet, JSON array, or gzipped JSON array."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".json", ".json.gz")):
        return spark.read.json(path, multiLine=True)
    raise UnknownFormat(path)


def parquet_sql(spark: SparkSession, path: str, projection: str = "*", where: str = "true") -> DataFrame:
    """A Parquet path as a table of a SQL statement."""
    return spark.sql(f"SELECT {projection} FROM parquet.`{path}` src WHERE {where}")


def by_ids(df: DataFrame, key: str, ids: list, payload: str, path: str, kind: str = "string") -> DataFrame:
    """One value out of a JSON payload for a list of ids; the filter reaches the scan."""
    return df.where(F.col(key).isin(*ids)).select(key, F.try_variant_get(F.try_parse_json(payload), path, kind).alias("value"))


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: id, title, summary, published, authors, categories."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return df.select("id", squeeze("title").alias("title"), squeeze("summary").alias("summary"), F.try_to_timestamp("published").alias("published"), F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"))


def json_pages(spark: SparkSession, path: str, items: str, schema: str) -> DataFrame:
    """Items of paged JSON responses kept as files: one row an item, with its page and place."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), "value")
    parsed = pages.select("page", F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("value"), f"$.{items}", "variant")), T._parse_datatype_string(f"array<struct<{schema}>>")).alias("items"))
    return parsed.select("page", F.posexplode("items").alias("place", "item")).select("page", "place", "item.*")


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^()\\])*\)|T\*|Td|TD|'|BT", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(blob: bytes | None, most: int = MOST_TEXT) -> str | None:
    """Text shown by the content streams of a simple PDF, up to a number of characters (the cap is the feature)."""
    if not blob or not blob.startswith(b"%PDF"):
        return None
    out: list[str] = []
    for head, body in _STREAM.findall(blob):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"Tj" not in body and b"TJ" not in body:
            continue
        for token in _SHOWN.findall(body):
            if token.startswith(b"("):
                raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
                out.append(re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw).decode("latin-1"))
            elif out and not out[-1].endswith("\n"):
                out.append("\n")
    return "".join(out).strip()[:most]


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha256, n_chars) of PDF files."""

    @F.pandas_udf("string")
    def text(blobs: pd.Series) -> pd.Series:
        return blobs.map(pdf_text)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text")).select("path", "text", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"))


def institutions(df: DataFrame) -> DataFrame:
    """(alias, name, id): every name of a seed list; of records that share an alias the first counts."""
    rows = df.select("id", "name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.min(F.struct("id", "name")).alias("r")).select("alias", "r.name", "r.id")


def since(df: DataFrame, column: str, watermark: Column) -> DataFrame:
    return df.where(F.col(column) >= watermark)
