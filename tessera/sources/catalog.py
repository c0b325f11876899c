"""Declared schemas: a DDL text gives types, keys, defaults and checks, and an allow-list of names to scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownTable(KeyError):
    pass


@dataclass
class Table:
    name: str
    schema: T.StructType
    keys: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)

    def violations(self, df: DataFrame) -> DataFrame:
        """(check, row as JSON) for each row that fails a check; a check that is null holds. Repeated keys are listed too."""
        bad = [F.when(~F.expr(rule), F.lit(name)) for name, rule in self.checks.items()]
        found = df.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("check"), F.to_json(F.struct(*df.columns)).alias("row")) if bad else None
        if self.keys:
            twice = df.groupBy(*self.keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("primary_key").alias("check"), F.to_json(F.struct(*self.keys)).alias("row"))
            found = twice if found is None else found.unionByName(twice)
        return found


def render(text: str, **values: str) -> list[str]:
    """Statements of a DDL text: ``${name}`` filled in, comments cut, split at semicolons outside quotes."""
    text = re.sub(r"--[^\n]*", "", text)
    for k, v in values.items():
        text = text.replace("${" + k + "}", v)
    parts = re.findall(r"(?:'(?:[^']|'')*'|[^;'])+", text)
    return [p.strip() for p in parts if p.strip()]


def _items(body: str) -> list[str]:
    """Split at commas outside brackets and quotes."""
    out, depth, held, quoted = [], 0, "", False
    for c in body:
        quoted ^= c == "'"
        depth += (c in "(<") - (c in ")>") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()] if held.strip() else out


def parse(ddl: str, **values: str) -> dict[str, Table]:
    """Tables of CREATE TABLE statements, with constraints from ALTER TABLE ... ADD CONSTRAINT."""
    tables: dict[str, Table] = {}
    for statement in render(ddl, **values):
        if m := re.match(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)\s*\(", statement):
            depth, end = 1, m.end()
            while depth:
                depth += (statement[end] == "(") - (statement[end] == ")")
                end += 1
            columns, table = [], Table(m[1], T.StructType())
            for n, item in enumerate(_items(statement[m.end() : end - 1])):
                if k := re.match(r"(?is)(?:constraint\s+(\w+)\s+)?primary\s+key\s*\(([^)]*)\)", item):
                    table.keys = [x.strip() for x in k[2].split(",")]
                elif k := re.match(r"(?is)(?:constraint\s+(\w+)\s+)?check\s*\((.*)\)$", item):
                    table.checks[k[1] or f"check_{n}"] = k[2].strip()
                else:
                    name, rest = item.split(None, 1)
                    if k := re.search(r"(?is)\sdefault\s+('(?:[^']|'')*'|[^\s]+)", rest):
                        table.defaults[name] = k[1]
                        rest = rest.replace(k[0], "")
                    required = re.search(r"(?i)\snot\s+null", rest) is not None
                    kind = re.sub(r"(?i)\s+(not\s+null|primary\s+key)", "", rest).strip()
                    if re.search(r"(?i)\sprimary\s+key", rest):
                        table.keys = [name]
                    columns.append(T.StructField(name, T._parse_datatype_string(kind), not required))
            table.schema = T.StructType(columns)
            tables[m[1]] = table
        elif m := re.match(r"(?is)alter\s+table\s+([\w.]+)\s+add\s+constraint\s+(\w+)\s+check\s*\((.*)\)$", statement):
            tables[m[1]].checks.setdefault(m[2], m[3].strip())  # adding it again changes nothing
    return tables


@dataclass
class Applied:
    ran: int = 0
    skipped: int = 0  # constraints that were there already


def apply(spark: SparkSession, text: str, known: dict[str, Table] | None = None, **values: str) -> int | Applied:
    """Run the statements of a DDL text in order; how many ran. With a registry of ``known`` tables, constraints are added to
    it, since Parquet tables hold none: one of a name that is there already changes nothing."""
    statements = render(text, **values)
    done = Applied()
    for s in statements:
        m = re.match(r"(?is)alter\s+table\s+([\w.]+)\s+add\s+constraint\s+(\w+)\s+check\s*\((.*)\)$", s)
        if known is None or m is None:
            spark.sql(s)
        elif m[2] in known[m[1]].checks:
            done.skipped += 1
            continue
        else:
            known[m[1]].checks[m[2]] = m[3].strip()
        done.ran += 1
    return done.ran if known is None else done


@dataclass
class Catalog:
    """Tables that may be read, by name, from files or from the session's catalog."""

    spark: SparkSession
    places: dict[str, str]

    def scan(self, name: str) -> DataFrame:
        if name not in self.places:
            raise UnknownTable(name)
        return self.spark.read.parquet(self.places[name])

    def counts(self) -> DataFrame:
        """(table, rows) of every table, as one union."""
        parts = [self.scan(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in sorted(self.places)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema, in its order and types: missing ones null, text parsed as time, JSON text as variant, junk null."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.VariantType) and isinstance(df.schema[f.name].dataType, T.StringType):
            out.append(F.try_parse_json(f.name).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.try_to_timestamp(F.col(f.name).cast("string")).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and isinstance(df.schema[f.name].dataType, T.StringType):
            out.append(F.from_json(f.name, f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return df.select(*out)
