"""Helpers that the training-data operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.relational import running_total

#: Rows and bytes of an Arrow batch that are turned into Python values at a time. Spark itself bounds the bytes of the
#: batches that it sends to a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset on one machine (tests)
    a temporary folder is made and used from then on; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        got = context._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Within the block Spark sends at most BATCH_ROWS rows to a Python worker at a time; then the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_OPEN: list[list[str]] = []  # paths written since each open ``temporary`` began


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives
    lost executors, and makes later column pruning possible. ``temporary`` leaves it alone where ``keep`` is set."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with short_batches(spark):
        df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators store within the block go at its end: what they returned has to be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BATCH_ROWS rows and, rows being whole, about BATCH_BYTES bytes."""
    start = 0
    while start < batch.num_rows:
        count = min(BATCH_ROWS, batch.num_rows - start)
        while count > 1 and batch.slice(start, count).nbytes > BATCH_BYTES:
            count = (count + 1) // 2
        yield batch.slice(start, count)
        start += count


def map_rows(df: DataFrame, schema: str | T.StructType, rows: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """``mapInArrow`` with plain Python values: ``rows`` gets an iterator of column dicts of lists
    (one a slice of a batch) and yields lists of columns in the order of ``schema``."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ({n: c.to_pylist() for n, c in zip(p.schema.names, p.columns)} for b in batches for p in pieces(b))
        for columns in rows(parts):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, want)


def absent(df: DataFrame, name: str) -> str:
    """``name``, or with lines before it a name like it that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def is_whole(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.IntegralType)


def with_numbers(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ids that are not whole numbers replaced by their ranks, from 1; (rank, id) of each)."""
    ids = stored(running_total(df.select(F.col(f"`{key}`").alias("id")).where("id is not null").distinct(), [F.col("id")], F.lit(1), "rank").select("rank", "id"), "ids")
    number = absent(df, "_rank")
    there = ids.select(F.col("rank").alias(number), F.col("id").alias(f"{number}_of"))
    joined = df.join(there, F.col(f"`{key}`") == F.col(f"{number}_of"), "left")
    return joined.select(*(F.col(number).cast("long").alias(c) if c == key else F.col(f"`{c}`") for c in df.columns)), ids
