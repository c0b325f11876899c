"""Places in an order over a whole table, pages of it, and medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.skew import HEAVY_KEYS
from tessera.operators.storage import drop, shared_folder, stored


def running_total(df: DataFrame, order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` up to each row in ``order``, over the whole table and without one task that sees it all:
    ranges of the order are summed by themselves and then offset by the sums before them, one row a range. The ranges are
    checkpointed, so a lost executor cannot draw them anew between the two steps."""
    shared_folder(df.sparkSession)
    ranged = df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_amount").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # One row a range: as many as there are partitions.
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_amount", "_inside", "_before")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place in ``order``, from 1 on; the order should be total."""
    return running_total(df, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


# ---- pages ------------------------------------------------------------------------------------


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int = 20) -> DataFrame:
    """One page of a table that is read for this page only; ``Pages`` is for many."""
    return df.orderBy(*order).offset(number * size).limit(size)


@dataclass
class Pages:
    """A table laid out once in ranges of an order, with a directory of the rows of each range, so that any page, however
    deep, reads the one or two ranges that it lies in."""

    table: DataFrame
    order: list[str]
    starts: list[tuple[int, str, int]]  # first row, folder of the range, its rows

    @classmethod
    def lay(cls, df: DataFrame, order: Sequence[str], folder: str, rows_a_range: int = 1_000_000) -> Pages:
        """``order`` names columns, nulls first, as ``orderBy`` has them; it should be total."""
        ranges = max(1, -(-df.count() // rows_a_range))
        laid = df.repartitionByRange(ranges, *order) if ranges > 1 else df.repartition(1)
        laid.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order).write.partitionBy("_range").parquet(folder)
        table = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(folder)
        sizes = sorted((r["_range"], r["n"]) for r in table.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row a range
        starts, before = [], 0
        for number, n in sizes:
            starts.append((before, str(number), n))
            before += n
        return cls(table, list(order), starts)

    def page(self, number: int, size: int = 20) -> DataFrame:
        """The rows of a page in order; empty beyond the end."""
        first = number * size
        met = [(start, int(r)) for start, r, n in self.starts if start < first + size and first < start + n]
        columns = [c for c in self.table.columns if c != "_range"]
        if not met:
            return self.table.where("false").select(*columns)
        rows = self.table.where(F.col("_range").isin(*(r for _, r in met))).select(*columns)
        return rows.orderBy(*self.order).offset(first - met[0][0]).limit(size)


# ---- medians ----------------------------------------------------------------------------------

BINS = 4096


def medians(df: DataFrame, group: str, value: str, name: str = "median", gathered: int = 100_000) -> DataFrame:
    """(group, ``name``): the exact median of known numbers by group, the mean of the middle two.

    Groups of at most ``gathered`` values sort theirs in one buffer. Each larger one (fewer than HEAVY_KEYS of them, so that
    their state may be broadcast) is cut down by histograms: values between the bounds are counted in BINS equal bins,
    on the map side first, and the bin with the middle place gives the next bounds, which are its own least and greatest
    value. Three or so passes leave a bin that may be gathered, or one single value, whatever the group holds."""
    slim = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    size = slim.count()
    limit = max(gathered, size // HEAVY_KEYS)
    state = stored(slim.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "medians-groups")
    large, few = state.where(F.col("n") > limit), state.where(F.col("n") <= limit)
    places = F.posexplode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("side", "k")
    open_, done = stored(large.select("g", places, "n", "lo", "hi"), "medians-open"), []
    # Halves, so that the width of the widest bounds is a number still.
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor(BINS * ((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))))).otherwise(0)
    within = slim.withColumnRenamed("g", "h")
    spent = []
    while not open_.isEmpty():
        spent.append(open_)
        ended = F.col("lo") == F.col("hi")
        done.append(open_.where(ended).select("g", F.col("lo").alias("v")))
        small = open_.where(~ended & (F.col("n") <= limit))
        last = within.join(F.broadcast(small), F.col("h").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        done.append(last.groupBy("g", "side", "k").agg(F.sort_array(F.collect_list("v")).alias("x")).select("g", F.get("x", F.col("k").cast("int")).alias("v")))
        wide = open_.where(~ended & (F.col("n") > limit))
        binned = within.join(F.broadcast(wide), F.col("h").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = binned.groupBy("g", "side", "k", at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "side").orderBy("bin"))
        open_ = counts.withColumn("upto", upto).where("k < upto and k >= upto - n").select("g", "side", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n", "lo", "hi")
        open_ = stored(open_, "medians-open")
    gathered_few = slim.join(few.select(F.col("g").alias("f")).distinct(), F.col("g").eqNullSafe(F.col("f")), "left_semi") if spent else slim
    out = gathered_few.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias(name))
    if spent:
        every = done[0]
        for part in done[1:]:
            every = every.unionByName(part)
        out = out.unionByName(every.groupBy("g").agg((F.min("v") / 2 + F.max("v") / 2).alias(name)))
    drop(open_)
    return out.withColumnRenamed("g", group)
