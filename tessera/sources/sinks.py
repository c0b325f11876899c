"""Sinks: versioned Parquet tables with idempotent upserts, fan-out, dry runs, cursors."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.dml import INSERTED, UPDATED, changes, last_wins, suppress, suppressed_rows

BROADCAST_KEYS = 500_000  # keys of newer layers that are sent to all workers, at most


@dataclass
class Counts:
    staged: int = 0
    suppressed: int = 0
    inserted: int = 0
    updated: int = 0

    @property
    def skipped_unchanged(self) -> int:
        return self.staged - self.suppressed - self.inserted - self.updated


class Conflict(RuntimeError):
    """Another writer published a version in the meantime."""


class Damaged(RuntimeError):
    """Versions are there and no pointer to any of them."""


def _plain(value):
    """A key's value as the pointer holds it: numbers and texts as they are, others as nothing, which prunes nothing."""
    return value if isinstance(value, (int, str)) and not isinstance(value, bool) else None


def _meet(a: list, b: list) -> bool:
    """Whether two files [low, high, rows] may share a key."""
    return None in (*a[:2], *b[:2]) or (a[0] <= b[1] and b[0] <= a[1])


@dataclass
class ParquetTable:
    """A table that is merged when it is read: a base and newer layers over it, in which the newest row of a key counts.

    An upsert writes only rows that are new or changed, as one more layer. Files of a layer are ranges of the keys, sorted,
    with a Bloom filter of each key column, so that Parquet's readers skip what cannot match; the pointer has the first and
    last key of each file, so that an upsert reads files within its range only, and a reader joins only files of the base that
    newer layers may replace rows of. Layers are put together when there are more than ``layers`` of them, and the base is
    written anew when they hold more than ``share`` of its rows, so that the writing of a row is paid for a bounded number of
    times.

    A pointer is a small file with the layers, named by a number that counts up. Pointers are created and never
    replaced, so a writer that dies leaves the last version as it was, of two writers one fails, and readers never see
    half a write. The first pointer is the empty table, made before any data."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    rows_a_file: int = 1_000_000
    layers: int = 8
    share: float = 0.25

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return sorted(x.getPath().getName() for x in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []

    def _load(self, number: str) -> list[dict] | None:
        """Layers, oldest first, each with its folder and files; None where the writer died before it wrote them."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/pointers/{number}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _state(self) -> tuple[int, list[dict]]:
        """The last number given away, and the last version that was published."""
        numbers = [n for n in self._names(f"{self.path}/pointers") if n.isdigit()]
        for number in reversed(numbers):
            found = self._load(number)
            if found is not None:
                return int(numbers[-1]), found
        if self._names(f"{self.path}/versions"):
            raise Damaged(f"{self.path} has versions and no pointer")
        return -1, []

    def _publish(self, number: int, layers: list[dict]) -> None:
        fs, path = self._fs()
        name = path(f"{self.path}/pointers/{number:012d}")
        try:
            stream = fs.create(name, False)
        except Exception as e:
            if fs.exists(name):
                raise Conflict(f"{self.path} was written by someone else") from e
            raise
        try:
            stream.write(bytearray(json.dumps(layers, sort_keys=True).encode()))
        finally:
            stream.close()

    # ---- reading --------------------------------------------------------------------------------

    def _scan(self, layer: dict, files: list[str] | None = None) -> DataFrame:
        names = [f"{self.path}/versions/{layer['folder']}/{f}" for f in (layer["files"] if files is None else files)]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def _known(self) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(k).isNotNull()
        return out

    def _newest(self, layers: list[dict], columns: list[str]) -> DataFrame:
        """The newest row of each key among some layers; rows with a null key are all there."""
        if len(layers) == 1:
            return self._scan(layers[0]).select(*columns)
        every = None
        for i, layer in enumerate(layers):
            part = self._scan(layer).select(*columns).withColumn("_layer", F.lit(i))
            every = part if every is None else every.unionByName(part)
        w = Window.partitionBy(*self.keys).orderBy(F.desc("_layer"))
        ranked = every.where(self._known()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return ranked.unionByName(every.where(~self._known())).drop("_layer")

    def _merged(self, layers: list[dict], within: list | None = None, columns: list[str] | None = None) -> DataFrame:
        """The table as of ``layers``; with ``within`` at least its rows in that range of the first key, from files that meet it."""
        columns = columns or self.schema.fieldNames()
        if within is not None:
            layers = [{"folder": x["folder"], "files": {f: r for f, r in x["files"].items() if _meet(r, within)}} for x in layers]
        layers = [x for x in layers if x["files"]]
        if not layers:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        base, newer = layers[0], layers[1:]
        if not newer:
            return self._scan(base).select(*columns)
        ranges = [r for x in newer for r in x["files"].values()]
        met = [f for f, r in base["files"].items() if any(_meet(r, d) for d in ranges)]
        fresh = self._newest(newer, columns)
        replaced = fresh.select(*self.keys)
        few = sum(r[2] for r in ranges) <= BROADCAST_KEYS
        left = self._scan(base, met).select(*columns).join(F.broadcast(replaced) if few else replaced, self.keys, "left_anti").select(*columns)
        return self._scan(base, [f for f in base["files"] if f not in set(met)]).select(*columns).unionByName(left).unionByName(fresh)

    def read(self) -> DataFrame:
        return self._merged(self._state()[1])

    # ---- writing --------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, folder: str, count: int) -> tuple[dict, dict[str, int]]:
        """(a layer of the rows, of which there are at most ``count``; the number of rows by action)."""
        files = max(1, -(-count // self.rows_a_file))
        laid = (rows.repartition(1) if files == 1 else rows.repartitionByRange(files, *self.keys)).sortWithinPartitions(*self.keys)
        writer = laid.write
        for k in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", str(min(count, self.rows_a_file) or 1))
        writer.parquet(f"{self.path}/versions/{folder}")
        fs, path = self._fs()
        made = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("action", T.StringType())])).parquet(f"{self.path}/versions/{folder}")
        found = made.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(self.keys[0]).alias("a"), F.max(self.keys[0]).alias("b"), F.count("*").alias("n"), *(F.count_if(F.col("action") == x).alias(x) for x in (INSERTED, UPDATED)), F.count_if(F.col(self.keys[0]).isNull()).alias("nameless"))
        rows_of = found.collect()  # one row a file
        if not rows_of:
            fs.delete(path(f"{self.path}/versions/{folder}"), True)
        layer = {"folder": folder, "files": {r["f"]: [None if r["nameless"] else _plain(r["a"]), None if r["nameless"] else _plain(r["b"]), r["n"]] for r in rows_of}}
        return layer, {x: sum(r[x] for r in rows_of) for x in (INSERTED, UPDATED)}

    def upsert(self, staged: DataFrame, hash_column: str | None = "content_hash", suppressed: DataFrame | None = None, key: str | None = None, source: Column | str | None = None, order: str | None = None) -> Counts:
        """Merge staged rows and count what happened. A second run of the same rows changes nothing. Staged rows are read
        once; they meet the keys (and hashes, where there are such) of files within their range, and only new and changed rows
        are written. Several staged rows of one key are an error unless ``order`` says which is the last."""
        number, layers = self._state()
        if number < 0:
            number = 0
            self._publish(0, [])
        fs, path = self._fs()
        version = f"v-{uuid.uuid4().hex}"
        held = f"{self.path}/staging/{version}"
        rows = last_wins(staged, self.keys, [order]) if order else staged
        rows.select(*self.schema.fieldNames()).write.parquet(f"{held}/staged")
        try:
            taken = self.spark.read.schema(self.schema).parquet(f"{held}/staged")
            size = taken.agg(F.count("*").alias("n"), F.min(self.keys[0]).alias("a"), F.max(self.keys[0]).alias("b")).first()
            out = Counts(size["n"])
            if suppressed is not None:
                out.suppressed = suppressed_rows(taken, suppressed, key, source).count()
                taken = suppress(taken, suppressed, key, source)
            needed = [*self.keys, hash_column] if hash_column in self.schema.fieldNames() else self.schema.fieldNames()
            there = self._merged(layers, [_plain(size["a"]), _plain(size["b"]), size["n"]], needed)
            different = changes(there, taken, self.keys, hash_column)
            if size["n"] > self.rows_a_file:  # ranges are drawn from a sample: the join must not run twice
                different.write.parquet(f"{held}/changes")
                different = self.spark.read.schema(different.schema).parquet(f"{held}/changes")
            layer, done = self._write(different, version, size["n"])
            out.inserted, out.updated = done[INSERTED], done[UPDATED]
            if layer["files"]:
                layers = [*layers, layer]
                self._publish(number + 1, layers)
                self._tidy(number + 1, layers)
        finally:
            fs.delete(path(held), True)
        return out

    def _tidy(self, number: int, layers: list[dict]) -> None:
        rows = [sum(r[2] for r in x["files"].values()) for x in layers]
        try:
            if sum(rows[1:]) > self.share * rows[0]:
                self._compact(number, layers, 0)
            elif len(layers) > self.layers:
                self._compact(number, layers, 1)
        except Conflict:
            pass  # someone else wrote meanwhile; the next upsert tidies up

    def _compact(self, number: int, layers: list[dict], start: int) -> None:
        if len(layers) - start < 2:
            return
        count = sum(r[2] for x in layers[start:] for r in x["files"].values())
        rows = self._merged(layers) if start == 0 else self._newest(layers[start:], self.schema.fieldNames())
        version = f"v-{uuid.uuid4().hex}"
        layer, _ = self._write(rows, version, count)
        try:
            self._publish(number + 1, [*layers[:start], layer])
        except Conflict:
            fs, path = self._fs()
            fs.delete(path(f"{self.path}/versions/{version}"), True)
            raise

    def compact(self) -> None:
        """All layers as one base."""
        self._compact(*self._state(), 0)

    def vacuum(self, keep: int = 2) -> None:
        """Delete folders that none of the last ``keep`` published versions reads. Not for use beside running writers."""
        numbers = [n for n in self._names(f"{self.path}/pointers") if n.isdigit()]
        states = {n: s for n in numbers if (s := self._load(n)) is not None}
        last = list(states)[-keep:]
        used = {layer["folder"] for n in last for layer in states[n]}
        fs, path = self._fs()
        for n in numbers:
            if n < last[0]:
                fs.delete(path(f"{self.path}/pointers/{n}"), True)
        for version in self._names(f"{self.path}/versions"):
            if version not in used:
                fs.delete(path(f"{self.path}/versions/{version}"), True)


@dataclass
class NullSink:
    """Takes everything and keeps only what it was given: for dry runs."""

    calls: list[tuple[str, int]] = field(default_factory=list)

    def upsert(self, name: str, df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()
        self.calls.append((name, df.count()))


def sink_all(sinks: dict[str, ParquetTable], tables: dict[str, DataFrame], **options) -> dict[str, Counts]:
    """Every table that has rows to its sink, by name."""
    return {n: sinks[n].upsert(tables[n], **options) for n in sorted(tables) if tables[n].head(1)}


def chunked(df: DataFrame, folder: str, rows: int = 50_000) -> list[DataFrame]:
    """Parts of a load by the hash of its rows, of about so many rows, each to be merged by itself. The load is written to
    ``folder`` once, a folder for each part, so that a part is read alone."""
    parts = max(1, -(-df.count() // rows))
    df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")).write.mode("overwrite").partitionBy("_part").parquet(folder)
    back = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(folder)
    return [back.where(F.col("_part") == i).drop("_part") for i in range(parts)]


def advance(cursors: DataFrame, source: str, value: str | None, status: str, error: str | None = None) -> DataFrame:
    """The cursor table with a source's row replaced: it moves only with a value; errors are kept to 1000 characters."""
    old = cursors.where(F.col("source") == source).agg(F.max("cursor").alias("old"))
    new = old.select(F.lit(source).alias("source"), F.coalesce(F.lit(value).cast("string"), "old").alias("cursor"), F.lit(status).alias("status"), F.substring(F.lit(error).cast("string"), 1, 1000).alias("error"))
    return cursors.where(F.col("source") != source).select("source", "cursor", "status", "error").unionByName(new)
