import base64
import hashlib

import pytest

from tessera.llm import warc


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            b = (h or "").encode()
            if len(b) >= least:
                first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first.get(b, i) if i is not None else i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref))
    return sorted(out, key=str)


ROWS = [(3, "http://a.org/x", "same"), (1, "http://b.a.org/y?q=1", "same"), (2, None, None), (7, "", ""), (4, "http://a.org/x", "other é"), (4, "http://a.org/x", "other é"), (None, "http://n.org", "same"), (9, "not a url \n x", "z" * 3_000_000), (11, "http://[bad", "k")]


@pytest.mark.parametrize("least", [0, 3])
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_read_back(spark, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    volumes = warc.write_archive(pages, "page_id", "url", "html", least)
    got = warc.read_back(volumes, warc.write_index(volumes), warc.index_keys(pages, "page_id", "url")).collect()
    assert sorted(((r["id"], *r[2:]) for r in got), key=str) == brute(ROWS, least)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    volumes = warc.write_archive(pages, "page_id", "url", "html")
    assert warc.read_back(volumes, warc.write_index(volumes), warc.index_keys(pages, "page_id", "url")).count() == 0


def test_lookup_of_some_keys(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/p/{i}", f"text {i}") for i in range(500)], "page_id long, url string, html string")
    volumes = warc.write_archive(pages, "page_id", "url", "html")
    index = warc.write_index(volumes)
    wanted = pages.where("page_id in (0, 77, 499)")
    got = warc.read_back(volumes, index, warc.index_keys(wanted, "page_id", "url").union(spark.createDataFrame([("no,such)/ 1",)], "k string"))).collect()
    assert sorted(r["id"] for r in got) == [0, 77, 499]


def test_ranges_are_shipped_and_volumes_stay(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.org/", f"text {i}" * 50) for i in range(300)], "page_id long, url string, html string").repartition(3)
    volumes = warc.write_archive(pages, "page_id", "url", "html")
    places = warc.lookup(warc.write_index(volumes), warc.index_keys(pages, "page_id", "url"))
    got = warc.read_ranges(places, volumes)
    assert sorted(warc.read_record(r["member"]).headers["WARC-Record-ID"] for r in got.collect()) == sorted(f"<urn:x-page:{i}>" for i in range(300))
    physical = warc.ranges(places, volumes)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in physical.splitlines() if "FileScan" in line and "warc_volumes" in line)
    above = physical.splitlines()[physical.splitlines().index(scan) - 1]
    assert "Bucketed: true" in scan and "Exchange" not in above


def test_keys_and_damage():
    assert warc.url_key("http://B.a.org:8080/x?q#f") == "org,a,b:8080)/x?q"
    assert warc.url_key("https://a.org") == "org,a)/" and warc.url_key(None) == ""
    member = warc.record(1, "http://a", b"body")
    assert warc.read_record(member).payload == b"body"
    with pytest.raises(warc.RecordError):
        warc.read_record(member[:-9])
