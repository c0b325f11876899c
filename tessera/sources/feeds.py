"""Feeds as a Python data source, and what plans and paces their requests. Offline, responses are JSON files."""

from __future__ import annotations

import glob
import json
import os
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Attempts, longest wait in seconds, most results that one query can page through.
ATTEMPTS, LONGEST_WAIT, MOST_RESULTS = 5, 60.0, 1000


def bisect_windows(first: date, last: date, total: Callable[[date, date], int], most: int = MOST_RESULTS) -> Iterator[tuple[date, date, bool]]:
    """Windows of days that each hold fewer than ``most`` results; (from, to, whole). A single day with more comes as it is,
    marked as not whole."""
    n = total(first, last)
    if n < most or first == last:
        yield first, last, n < most
        return
    middle = first + (last - first) // 2
    yield from bisect_windows(first, middle, total, most)
    yield from bisect_windows(middle + timedelta(days=1), last, total, most)


def slices(first: date, last: date, days: int = 3, overlap: int = 1) -> list[tuple[date, date]]:
    """Windows of some days, from an overlap before the first day on."""
    out, at = [], first - timedelta(days=overlap)
    while at <= last:
        out.append((at, min(last, at + timedelta(days=days - 1))))
        at += timedelta(days=days)
    return out


def batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def split_on_failure(items: list, call: Callable[[list], list], failed: type[Exception] = TimeoutError) -> list:
    """One call for all; where it fails, two for the halves. A single item that fails is raised."""
    try:
        return call(items)
    except failed:
        if len(items) <= 1:
            raise
        half = len(items) // 2
        return split_on_failure(items[:half], call, failed) + split_on_failure(items[half:], call, failed)


@dataclass
class TokenBucket:
    """Requests a second, with some held in reserve. Time is given, so runs can be repeated."""

    rate: float
    size: float
    held: float | None = None
    at: float = 0.0

    def wait(self, now: float) -> float:
        """Seconds to wait before the next request."""
        self.held = min(self.size, (self.size if self.held is None else self.held) + (now - self.at) * self.rate)
        self.at = now
        self.held -= 1
        return max(0.0, -self.held / self.rate)


def retry_wait(attempt: int, status: int, headers: dict[str, str], now: float, jitter: random.Random | None = None) -> float | None:
    """Seconds until the next attempt, or None when there is none: the server's wish first, else doubling, up to a minute."""
    if attempt >= ATTEMPTS or status not in (403, 429, 500, 502, 503, 504):
        return None
    if "retry-after" in headers:
        return min(LONGEST_WAIT, float(headers["retry-after"]))
    if headers.get("x-ratelimit-remaining") == "0" and "x-ratelimit-reset" in headers:
        return min(LONGEST_WAIT, max(0.0, float(headers["x-ratelimit-reset"]) - now))
    return min(LONGEST_WAIT, 2.0 ** (attempt - 1) + (jitter.random() if jitter else 0.0))


def all_pages(fetch: Callable[[int], tuple[int, list]], size: int, attempts: int = 3) -> Iterator[dict]:
    """Items of all pages. ``fetch`` gives (total, items) of a page, from 0 on; a page that is empty although the total says
    more is asked for again, ``attempts`` times in all, and is then an error."""
    page, seen = 0, 0
    while True:
        for _ in range(attempts):
            total, items = fetch(page)
            if items or seen >= total:
                break
        else:
            raise ConnectionError(f"page {page} stays empty: {seen} of {total}")
        yield from items
        seen, page = seen + len(items), page + 1
        if seen >= total or len(items) < size:
            return


def unless_unchanged(held: tuple[str, str] | None, call: Callable[[str | None], tuple[int, str | None, str | None]]) -> tuple[str | None, str | None]:
    """(etag, body) of a request that names the etag of what is held; where nothing changed (304) what is held stays."""
    status, etag, body = call(held[0] if held else None)
    return held if status == 304 and held else (etag, body)


class SearchSource(DataSource):
    """``spark.read.format("search")``: a search over creation dates, replayed from JSON lines in a folder a day
    (``day=2024-01-31``), as a partitioned write leaves them. Options: path, schema, first, last, and field and least (such as stars and 10). The dates
    are bisected until each window holds fewer results than a query can page through; a window is a partition."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options, [f.name for f in schema.fields])


class SearchReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.folder, self.names = options["path"], names
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.field, self.least = options.get("field", ""), float(options.get("least", "0"))
        self.most, self.page = int(options.get("most", str(MOST_RESULTS))), int(options.get("page", "100"))

    def _found(self, first: date, last: date) -> list[dict]:
        """What the service would find, ordered by date and then as listed."""
        out = []
        for i in range((last - first).days + 1):
            for path in sorted(glob.glob(os.path.join(self.folder, f"day={first + timedelta(days=i)}", "*.json"))):
                with open(path, encoding="utf-8") as f:
                    out += [x for x in map(json.loads, filter(str.strip, f)) if not self.field or (x.get(self.field) or 0) >= self.least]
        return out

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, b)) for a, b, _ in bisect_windows(self.first, self.last, lambda a, b: len(self._found(a, b)), self.most)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found = self._found(*partition.value)
        for item in all_pages(lambda n: (len(found), found[n * self.page : (n + 1) * self.page]), self.page):
            yield tuple(item.get(n) for n in self.names)


class ReplaySource(DataSource):
    """``spark.read.format("replay").option("path", folder).option("schema", ddl)``: one partition a response file, one
    row an item of its ``items`` list (or of the file's own list)."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options, [f.name for f in schema.fields])


class ReplayReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.folder, self.items, self.names = options["path"], options.get("items", "items"), names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(os.path.join(self.folder, partition.value), encoding="utf-8") as f:
            body = json.load(f)
        for item in body if isinstance(body, list) else body.get(self.items, []):
            yield tuple(item.get(n) for n in self.names)
