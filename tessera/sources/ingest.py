"""Ingestion: batched lookups over a queue of keys, and the loop that drains a source into tables.

A cursor moves only after everything has landed; upserts are idempotent, so a run that failed is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.models import Sink, Source
from tessera.sources.feeds import batches, split_on_failure
from tessera.sources.sinks import Counts


def pending(wanted: DataFrame, done: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Keys that have no row yet; ``most`` of them, where a run takes only so many (the limit is the feature)."""
    left = wanted.where(F.col(key).isNotNull()).select(key).distinct().join(done.select(key), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)


def batched_lookup(keys: DataFrame, key: str, call: Callable[[list], dict], size: int, single: Callable[[object], object] | None = None, failed: type[Exception] | None = None, enabled: bool = True) -> DataFrame:
    """(key, payload, found): one call a batch of keys, then one a key for what the batch missed. ``call`` gives payloads by
    key; it runs on the executors, a partition's keys at a time, and holds one batch in memory. A batch that fails with
    ``failed`` is asked for in halves. Without access (``enabled`` false) nothing is asked and nothing comes out."""
    kind = keys.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for batch in batches(part[key].tolist(), size):
                got = dict(split_on_failure(batch, lambda ks: list(call(ks).items()), failed)) if failed else call(batch)
                for k in batch:
                    value = got.get(k)
                    if value is None and single is not None:
                        value = single(k)
                    rows.append((k, value, value is not None))
            yield pd.DataFrame(rows, columns=[key, "payload", "found"])

    return (keys if enabled else keys.limit(0)).select(key).mapInPandas(run, f"`{key}` {kind}, payload string, found boolean")


def sweep(people: DataFrame, project: str, detail: Callable[[list], dict], size: int = 1) -> DataFrame:
    """One detail for each distinct project that a list of people names."""
    return batched_lookup(people.where(F.col(project).isNotNull()).select(project).distinct(), project, detail, size)


def fetch_chain(explicit: DataFrame, found: DataFrame, stored: DataFrame, hydrate: Callable[[list], dict], logins: Callable[[Column], Column], profile: Callable[[list], dict], failed: type[Exception] | None = None) -> tuple[DataFrame, DataFrame]:
    """(repositories, profiles): keys given or discovered, without those stored, ten a call; then the distinct logins that
    their payloads name, fifty a call. All are columns ``key``."""
    wanted = explicit.select("key").union(found.select("key"))
    repositories = batched_lookup(pending(wanted, stored, "key"), "key", hydrate, 10, failed=failed)
    core = repositories.where("found").select(F.explode(logins(F.col("payload"))).alias("key")).distinct().orderBy("key")
    return repositories, batched_lookup(core, "key", profile, 50, failed=failed)


def match_rate(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count("*").alias("asked"), F.count_if("found").alias("found"), F.round(F.coalesce(F.avg(F.col("found").cast("double")), F.lit(0.0)), 4).alias("rate"))


def drain(source: str, fetch: Source | Callable[[str | None], dict[str, DataFrame]], tables: dict[str, Sink], load: Callable[[str], str | None], save: Callable[[str, str | None, str, str | None], None], cursor: Callable[[dict[str, DataFrame]], str | None], **options) -> dict[str, Counts]:
    """Load the cursor, fetch, upsert every table that has rows, and save the new cursor. A failure saves the old one with
    status ``error`` and is raised. ``fetch`` is a source, or a function like its method; whatever takes staged rows may be a
    table, a dry run too."""
    wrong = [n for n, t in tables.items() if not isinstance(t, Sink)]
    if wrong:
        raise TypeError(f"no sinks: {wrong}")
    fetch = fetch.fetch if isinstance(fetch, Source) else fetch
    old = load(source)
    try:
        rows = fetch(old)
        done = {n: tables[n].upsert(df, **options) for n, df in sorted(rows.items()) if df.head(1)}
        new = cursor(rows)
    except Exception as e:
        save(source, old, "error", str(e)[:1000])
        raise
    save(source, new if new is not None else old, "ok", None)
    return done
