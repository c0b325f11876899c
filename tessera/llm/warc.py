"""WARC archives with a two-level capture index.

Archives are volumes: whole sequences of gzip members, one a record, kept as rows of a Parquet table in the shared
folder, which any file system of Spark can hold. The table is bucketed by the task that wrote a volume, so that each task
writes one file. The index sorts reversed-host URL keys into compressed blocks; a sparse directory has one key a block. A
lookup finds its shard, searches the shard's directory and then the block by bisection; the ranges of bytes that it
names are shipped to the bucket of their volume, and volumes stay where they are.

Equal payloads are stored once: of records with equal payloads of ``min_bytes`` or more the one with the
smallest id is the response, the others revisit it.

Defined results: a null page is an empty payload; a null url has an empty key; rows that repeat an id and
payload are records of their own of one kind; a row without id is always a response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, map_rows, shared_dir, stored

VOLUME_BYTES = 1 << 20  # a volume is closed beyond this size
BLOCK_LINES = 1000  # lines of an index block
SHARD_LINES = 100_000  # lines of an index shard, about
BROADCAST_ROWS = 200_000  # revisits are sent to all workers up to here, else joined by a shuffle
MIN_BYTES = 0  # shortest payload that is stored once
MOST_BUCKETS = 100_000  # Spark's own limit

_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: str | None) -> str:
    """``http://b.a.org/x?q`` as ``org,a,b)/x?q``: pages of a site, and sites of a domain, sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return re.sub(r"\s", "%20", url)
    if not host:
        return re.sub(r"\s", "%20", url)
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + re.sub(r"\s", "%20", tail)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit without it."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '%0A', url or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "replace") + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


class RecordError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def read_record(member: bytes) -> Record:
    """A record from its range of bytes; lengths and the digest of a stored payload are checked."""
    try:
        data = zlib.decompress(member, 31)
    except zlib.error as e:
        raise RecordError(f"not a gzip member: {e}") from e
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise RecordError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    length = int(headers["Content-Length"])
    if len(rest) < length + 4:
        raise RecordError("record is cut short")
    _, _, payload = rest[:length].partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and f"sha1:{base32_sha1(payload)}" != headers["WARC-Payload-Digest"]:
        raise RecordError("payload does not match its digest")
    return Record(headers, payload)


# ---- writing ----------------------------------------------------------------------------------


def revisits(pages: DataFrame, key: str, page: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload a smaller id has too. Only ids and digests are shuffled;
    minima are taken before the shuffle, so a payload that very many rows share costs no more than others."""
    body = F.encode(F.coalesce(pages[page], F.lit("")), "UTF-8")
    narrow = pages.select(pages[key].alias("id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where((F.col("size") >= min_bytes) & F.col("id").isNotNull())
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("last > refers_to").drop("last")
    return narrow.join(first, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, key: str, url: str, page: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Volumes (task, volume, data, entries) of all pages; an entry has url key, id, offset and length."""
    again = stored(revisits(pages, key, page, min_bytes), "warc-revisits")
    small = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    body = F.encode(F.coalesce(pages[page], F.lit("")), "UTF-8")
    rows_in = pages.select(pages[key].alias("id"), pages[url].alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    rows_in = rows_in.join(F.broadcast(again) if small else again, ["id", "digest"], "left").select("id", "url", "body", "refers_to")
    run = uuid.uuid4().hex[:12]

    def rows(parts):
        task, n, data, entries = TaskContext.get().partitionId(), 0, bytearray(), []

        def volume():
            nonlocal n, data, entries
            out = [[task], [f"{run}-{task:06d}-{n:06d}"], [bytes(data)], [entries]]
            n, data, entries = n + 1, bytearray(), []
            return out

        for part in parts:
            for i, u, b, r in zip(part["id"], part["url"], part["body"], part["refers_to"]):
                member = record(i, u, bytes(b), r)
                entries.append({"key": url_key(u), "id": i, "offset": len(data), "length": len(member)})
                data += member
                if len(data) >= VOLUME_BYTES:
                    yield volume()
        if entries:
            yield volume()

    kind = pages.schema[key].dataType.simpleString()
    spark, name = pages.sparkSession, f"warc_volumes_{run}"
    volumes = map_rows(rows_in, f"task int, volume string, data binary, entries array<struct<key string, id {kind}, offset long, length long>>", rows)
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    volumes.write.bucketBy(buckets, "task").option("path", f"{shared_dir(spark)}/warc-volumes-{run}").saveAsTable(name)
    drop_stored(again)
    return spark.table(name)


# ---- index ------------------------------------------------------------------------------------


def line_key(key: str, i) -> str:
    """Sort key of an index line: url key, then id."""
    return f"{key} {'' if i is None else i}"


def write_index(volumes: DataFrame) -> DataFrame:
    """Blocks (shard, block, first, last, lines, data): sorted index lines, compressed block by block. A shard is a range of keys."""
    lines = volumes.select("task", "volume", F.explode("entries").alias("e")).select(F.concat_ws(" ", "e.key", F.coalesce(F.col("e.id").cast("string"), F.lit(""))).alias("k"), "task", "volume", "e.offset", "e.length")
    count = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(count, -(-volumes.select(F.sum(F.size("entries")).alias("n")).first()["n"] // SHARD_LINES) if volumes.head(1) else 1)
    # Lines of one key stay together; ties are put in order of their place.
    sorted_lines = lines.repartitionByRange(shards, "k").sortWithinPartitions("k", "volume", "offset")

    def rows(parts):
        shard, block, held = TaskContext.get().partitionId(), 0, []

        def packed():
            nonlocal block, held
            out = [[shard], [block], [held[0][0]], [held[-1][0]], [len(held)], [zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6)]]
            block, held = block + 1, []
            return out

        for part in parts:
            for x in zip(part["k"], part["task"], part["volume"], part["offset"], part["length"]):
                held.append(x)
                if len(held) == BLOCK_LINES:
                    yield packed()
        if held:
            yield packed()

    return stored(map_rows(sorted_lines, "shard int, block int, first string, last string, lines int, data binary", rows), "warc-index")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Places (k, task, volume, offset, length) of the captures of each distinct key in column ``k``. The driver holds one
    key per shard, which are as many as partitions; directories and blocks are searched where their shard lies."""
    tops = [(r["first"], r["shard"]) for r in index.groupBy("shard").agg(F.min("first").alias("first")).orderBy("first").collect()]
    firsts, shards = [t[0] for t in tops], [t[1] for t in tops]

    def deal(parts):
        for part in parts:
            yield [part["k"], [shards[max(0, bisect_right(firsts, k) - 1)] if shards else -1 for k in part["k"]]]

    wanted = map_rows(keys.select("k").distinct(), "k string, shard int", deal)

    def search(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        blocks = blocks.sort_values("block")
        directory, last, packed = blocks["first"].tolist(), blocks["last"].tolist(), blocks["data"].tolist()
        opened, lines, names = -1, [], []
        for k in sorted(asked["k"]):
            b = max(0, bisect_right(directory, k) - 1)
            while b > 0 and directory[b] == k:  # a key may begin in the block before
                b -= 1
            while b < len(directory) and directory[b] <= k:
                if k <= last[b]:
                    if opened != b:
                        lines = [x.split("\t") for x in zlib.decompress(packed[b]).decode().split("\n")]
                        opened, names = b, [x[0] for x in lines]
                    at = bisect_right(names, k) - 1
                    while at >= 0 and names[at] == k:
                        out.append((k, int(lines[at][1]), lines[at][2], int(lines[at][3]), int(lines[at][4])))
                        at -= 1
                b += 1
        return pd.DataFrame(out, columns=["k", "task", "volume", "offset", "length"])

    return wanted.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(search, "k string, task int, volume string, offset long, length long")


def ranges(places: DataFrame, volumes: DataFrame) -> DataFrame:
    """(data, ranges): each volume that is named, with the ranges to cut out of it. The ranges of a task's volumes are
    gathered, as many as the task wrote records, and shuffled to the bucket; volumes are not."""
    wanted = places.groupBy("task").agg(F.collect_list(F.struct("volume", "offset", "length")).alias("_ranges")).hint("shuffle_hash")
    own = volumes.select("task", "volume", "data").join(wanted, "task")
    return own.select("data", F.filter("_ranges", lambda x: x["volume"] == F.col("volume")).alias("ranges")).where("size(ranges) > 0")


def read_ranges(places: DataFrame, volumes: DataFrame) -> DataFrame:
    """The bytes of each place."""

    def rows(parts):
        for part in parts:
            for data, wanted in zip(part["data"], part["ranges"]):
                yield [[data[x["offset"] : x["offset"] + x["length"]] for x in wanted]]

    return map_rows(ranges(places, volumes), "member binary", rows)


def read_back(volumes: DataFrame, index: DataFrame, keys: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Look every key up, read its records range by range and describe them; ``payload`` is null in revisits."""
    number = re.compile(r"urn:x-page:([^>]*)")
    whole = id_type in ("tinyint", "smallint", "int", "bigint")

    def rows(parts):
        def name(text):
            found = number.search(text or "")
            return None if not found or not found[1] else int(found[1]) if whole else found[1]

        for part in parts:
            for data, wanted in zip(part["data"], part["ranges"]):
                out = []
                for x in wanted:
                    h = read_record(data[x["offset"] : x["offset"] + x["length"]]).headers
                    out.append((name(h["WARC-Record-ID"]), h["WARC-Target-URI"], int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], name(h.get("WARC-Refers-To"))))
                yield list(zip(*out))

    return map_rows(ranges(lookup(index, keys), volumes), f"id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}", rows)


def index_keys(pages: DataFrame, key: str, url: str) -> DataFrame:
    """The index key of every page."""

    def rows(parts):
        for part in parts:
            yield [[line_key(url_key(u), i) for i, u in zip(part["i"], part["u"])]]

    return map_rows(pages.select(pages[key].alias("i"), pages[url].alias("u")), "k string", rows)
