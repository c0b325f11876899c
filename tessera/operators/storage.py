"""Tables of jobs with several steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine, where it is unset, does a temporary folder do instead."""
    context = spark.sparkContext
    set_before = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (set_before.get() if set_before.isDefined() else None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    if not set_before.isDefined():
        context.setCheckpointDir(found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again. Unlike a checkpoint this cuts the plan's size estimates beside the lineage:
    an estimate of a join is the product of its sides, and so would be squared in every round of a loop."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
