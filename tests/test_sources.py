import datetime as dt
import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import catalog, feeds, readers, sinks
from tessera.streaming import upserts

DDL = """
-- people; of a source
CREATE TABLE IF NOT EXISTS ${cat}.silver.person (
  person_id STRING NOT NULL,
  status STRING DEFAULT 'active; or not',
  score DOUBLE,
  tags ARRAY<STRUCT<a:STRING,b:MAP<STRING,INT>>>,
  payload VARIANT, -- raw
  seen TIMESTAMP,
  CONSTRAINT pk PRIMARY KEY (person_id),
  CONSTRAINT range CHECK (score BETWEEN 0 AND 1)
);
ALTER TABLE ${cat}.silver.person ADD CONSTRAINT st CHECK (status IN ('active', 'gone'));
ALTER TABLE ${cat}.silver.person ADD CONSTRAINT st CHECK (status IN ('active', 'gone'));
"""


def test_ddl_registry(spark):
    table = catalog.parse(DDL, cat="c")["c.silver.person"]
    assert table.keys == ["person_id"] and set(table.checks) == {"range", "st"} and table.defaults == {"status": "'active; or not'"}
    assert table.schema["tags"].dataType.simpleString() == "array<struct<a:string,b:map<string,int>>>" and table.schema["payload"].dataType.simpleString() == "variant" and not table.schema["person_id"].nullable
    df = spark.createDataFrame([("p", "odd", 2.0), ("p", "active", None), ("q", "gone", 1.0)], "person_id string, status string, score double")
    assert sorted(r["check"] for r in table.violations(df).collect()) == ["primary_key", "range", "st"]
    wide = catalog.coerce(spark.createDataFrame([("1", "0.5", '[{"a":"x","b":{"k":1}}]', '{"z": [1]}', "2024-01-02T03:04:05+01:00")], "person_id string, score string, tags string, payload string, seen string"), table.schema)
    row = wide.select("status", "score", "tags", F.to_json("payload").alias("p"), "seen").first()
    assert row["status"] is None and row["score"] == 0.5 and row["tags"][0]["b"] == {"k": 1} and row["p"] == '{"z":[1]}' and row["seen"] == dt.datetime(2024, 1, 2, 2, 4, 5)
    assert catalog.coerce(spark.createDataFrame([("x",)], "score string"), table.schema).first()["score"] is None


def test_catalog(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    c = catalog.Catalog(spark, {"t": f"{tmp_path}/t"})
    assert c.scan("t").count() == 3 and [tuple(r) for r in c.counts().collect()] == [("t", 3)]
    with pytest.raises(catalog.UnknownTable):
        c.scan("other")


def test_readers(spark, tmp_path):
    schema = catalog.parse("CREATE TABLE t (a BIGINT, b STRING)")["t"]
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    tables = readers.snapshot(spark, str(tmp_path), {"t": schema, "missing": schema})
    assert sorted(map(tuple, tables["t"].collect())) == [(1, "x"), (2, None)] and tables["missing"].count() == 0
    items = [{"paper": "p1", "repo": "r1"}, {"paper": "p2", "repo": None}]
    (tmp_path / "l.json").write_text(json.dumps(items))
    (tmp_path / "l.json.gz").write_bytes(gzip.compress(json.dumps(items).encode()))
    spark.createDataFrame([("p1", "r1"), ("p2", None)], "paper string, repo string").write.parquet(f"{tmp_path}/l.parquet")
    for n in ("l.json", "l.json.gz", "l.parquet"):
        assert readers.links(spark, f"{tmp_path}/{n}").count() == 2
    with pytest.raises(readers.UnknownFormat):
        readers.links(spark, "x.csv")
    assert readers.parquet_sql(spark, f"{tmp_path}/l.parquet", "paper", "repo IS NOT NULL").collect()[0]["paper"] == "p1"
    df = spark.createDataFrame([(1, '{"readme_md": "hi"}'), (2, "{}"), (3, "broken")], "repo_id long, payload string")
    assert [r["value"] for r in readers.by_ids(df, "repo_id", [1, 2, 3], "payload", "$.readme_md").orderBy("repo_id").collect()] == ["hi", None, None]
    seeds = spark.createDataFrame([("r2", "ETH Zurich", ["ETH"]), ("r1", "Other", ["eth", "o"])], "id string, name string, aliases array<string>")
    assert {(r["alias"], r["id"]) for r in readers.institutions(seeds).collect()} == {("eth zurich", "r2"), ("eth", "r1"), ("other", "r1"), ("o", "r1")}


def test_atom_and_pages(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<?xml version="1.0"?><feed><entry><id>http://arxiv.org/abs/1</id><title>A
      title</title><summary> S </summary><published>2024-01-02T00:00:00Z</published><author><name>Ann</name></author><author><name>Bob</name></author><category term="cs.RO"/></entry>
      <entry><id>2</id><title>B</title></entry></feed>""")
    rows = readers.atom(spark, str(tmp_path / "f.xml")).orderBy("id").collect()
    assert rows[1]["title"] == "A title" and rows[1]["authors"] == ["Ann", "Bob"] and rows[1]["categories"] == ["cs.RO"] and rows[1]["published"] == dt.datetime(2024, 1, 2) and rows[0]["authors"] is None
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text('{"items": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]}')
    (pages / "2.json").write_text('{"items": []}')
    assert [(r["place"], r["id"], r["name"]) for r in readers.json_pages(spark, str(pages), "items", "id long, name string").orderBy("place").collect()] == [(0, 1, "a"), (1, 2, "b")]
    spark.dataSource.register(feeds.ReplaySource)
    got = spark.read.format("replay").option("path", str(pages)).option("schema", "id long, name string").load()
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]


def test_pdf(spark, tmp_path):
    body = zlib.compress(b"BT (Hello \\(all\\)) Tj T* (of you) Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode /Length 9>> stream\n" + body + b"\nendstream endobj"
    assert readers.pdf_text(pdf) == "Hello (all)\nof you" and readers.pdf_text(b"x") is None and readers.pdf_text(pdf, 5) == "Hello"
    (tmp_path / "a.pdf").write_bytes(pdf)
    assert readers.pdfs(spark, str(tmp_path / "a.pdf")).first()["n_chars"] == 18


def test_windows_and_pacing():
    sizes = {dt.date(2024, 1, 1) + dt.timedelta(days=i): n for i, n in enumerate([10, 400, 1500, 700, 5])}
    found = list(feeds.bisect_windows(min(sizes), max(sizes), lambda a, b: sum(n for d, n in sizes.items() if a <= d <= b)))
    assert found[0][0] == min(sizes) and found[-1][1] == max(sizes) and [w for *_, w in found].count(False) == 1
    assert all(b[0] - a[1] == dt.timedelta(days=1) for a, b in zip(found, found[1:]))
    assert feeds.slices(dt.date(2024, 1, 5), dt.date(2024, 1, 9)) == [(dt.date(2024, 1, 4), dt.date(2024, 1, 6)), (dt.date(2024, 1, 7), dt.date(2024, 1, 9))]

    def call(items):
        if len(items) > 2:
            raise TimeoutError
        return items

    assert feeds.split_on_failure(list(range(9)), call) == list(range(9)) and feeds.batches([1, 2, 3], 2) == [[1, 2], [3]]
    bucket = feeds.TokenBucket(rate=2.0, size=2.0)
    assert [bucket.wait(0.0) for _ in range(4)] == [0.0, 0.0, 0.5, 1.0] and bucket.wait(5.0) == 0.0
    assert feeds.retry_wait(1, 404, {}, 0) is None and feeds.retry_wait(5, 500, {}, 0) is None and feeds.retry_wait(1, 429, {"retry-after": "90"}, 0) == 60.0
    assert feeds.retry_wait(1, 403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "107"}, 100) == 7.0 and feeds.retry_wait(3, 502, {}, 0) == 4.0


def test_sinks(spark, tmp_path):
    table = catalog.parse("CREATE TABLE t (id BIGINT, v STRING, content_hash STRING, n INT, PRIMARY KEY (id))")["t"]
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys)
    rows = spark.createDataFrame([(1, "a", "h1", 1), (2, "b", "h2", 1), (2, "b2", "h3", 2), (None, "x", "h", 1)], table.schema)
    first = t.upsert(rows, order="n")
    assert (first.staged, first.inserted, first.updated, first.skipped_unchanged) == (2, 2, 0, 0)
    second = t.upsert(rows, order="n")
    assert (second.inserted, second.updated, second.skipped_unchanged) == (0, 0, 2)
    gone = spark.createDataFrame([("s",)], "source string").select("source", F.sha2(F.lit("9"), 256).alias("key_hash"))
    third = t.upsert(spark.createDataFrame([(1, "A", "hx", 3), (9, "no", "h9", 3)], table.schema), suppressed=gone, key="id", source=F.lit("s"))
    assert (third.suppressed, third.updated, third.inserted) == (1, 1, 0)
    assert sorted((r["id"], r["v"]) for r in t.read().collect()) == [(1, "A"), (2, "b2")]
    assert sinks.sink_all({"t": t}, {"t": rows, "empty": rows.limit(0)}, order="n")["t"].updated == 1
    dry = sinks.NullSink()
    dry.upsert("t", rows)
    assert dry.calls == [("t", 4)]
    parts = sinks.chunked(rows, str(tmp_path / "parts"), 2)
    assert sum(p.count() for p in parts) == 4
    cursors = spark.createDataFrame([("a", "5", "ok", None), ("b", "1", "ok", None)], "source string, cursor string, status string, error string")
    moved = sinks.advance(cursors, "a", "9", "ok")
    failed = sinks.advance(moved, "a", None, "error", "x" * 2000)
    assert {(r["source"], r["cursor"], r["status"], len(r["error"] or "")) for r in failed.collect()} == {("a", "9", "error", 1000), ("b", "1", "ok", 0)}


def test_a_write_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    table = catalog.parse("CREATE TABLE t (id BIGINT, v STRING, PRIMARY KEY (id))")["t"]
    make = lambda *r: spark.createDataFrame(list(r), table.schema)
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys)
    content = lambda: sorted(map(tuple, t.read().collect()))
    t.upsert(make((1, "a"), (2, "b"), (3, "c")))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:  # between the data and the pointer
        m.setattr(sinks.ParquetTable, "_publish", dies)
        with pytest.raises(OSError):
            t.upsert(make((1, "z"), (9, "y")))
    assert content() == [(1, "a"), (2, "b"), (3, "c")]
    open(tmp_path / "t" / "pointers" / "000000000002", "w").close()  # within the pointer
    assert content() == [(1, "a"), (2, "b"), (3, "c")]
    t.upsert(make((1, "z")))
    assert content() == [(1, "z"), (2, "b"), (3, "c")]
    with pytest.raises(sinks.Conflict):
        t._publish(3, {})
    with pytest.raises(Exception, match="several staged rows"):
        t.upsert(make((5, "a"), (5, "b")))
    assert content() == [(1, "z"), (2, "b"), (3, "c")]
    before = set((tmp_path / "t" / "versions").iterdir())
    assert t.upsert(make((1, "z"))).skipped_unchanged == 1 and set((tmp_path / "t" / "versions").iterdir()) == before
    t.vacuum(1)
    assert content() == [(1, "z"), (2, "b"), (3, "c")] and len(list((tmp_path / "t" / "pointers").glob("[0-9]*"))) == 1
    for f in (tmp_path / "t" / "pointers").iterdir():
        f.unlink()
    with pytest.raises(sinks.Damaged):
        t.read()


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_scattered_upsert_writes_its_rows_only(spark, tmp_path):
    """A thousandth of all keys, all over the table: at most a hundredth of its bytes are written."""
    table = catalog.parse("CREATE TABLE t (id BIGINT, v STRING, content_hash STRING, PRIMARY KEY (id))")["t"]
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys, rows_a_file=50_000)
    rows = lambda df, tag: df.select("id", F.sha2(F.concat(F.col("id").cast("string"), F.lit(tag)), 256).alias("v"), F.sha2(F.lit(tag), 256).alias("content_hash"))
    assert t.upsert(rows(spark.range(200_000), "a")).inserted == 200_000
    before = _bytes(tmp_path / "t")
    assert t.upsert(rows(spark.range(0, 200_000, 1000), "b")).updated == 200
    assert _bytes(tmp_path / "t") - before <= 0.01 * before
    assert t.read().count() == 200_000 and t.read().where(F.col("content_hash") == F.sha2(F.lit("b"), 256)).count() == 200
    # Ranges: an upsert of few neighbouring keys reads one file of the base, and a reader joins that file alone.
    t.compact()
    files = list(t._state()[1][0]["files"])
    assert 4 <= len(files) <= 5 and t.upsert(rows(spark.range(10, 20), "c")).updated == 10
    held = t._state()[1][0]["files"]
    assert sum(sinks._meet(r, [10, 19, 10]) for r in held.values()) == 1
    assert t.read().count() == 200_000 and t._merged(t._state()[1], [10, 19, 10]).count() < 60_000


def test_layers_equal_a_plain_merge(spark, tmp_path):
    """Many upserts with new, changed and same rows: as a dictionary does; layers are put together on the way."""
    import random

    rng = random.Random(5)
    table = catalog.parse("CREATE TABLE t (id BIGINT, name STRING, v STRING, PRIMARY KEY (id, name))")["t"]
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys, rows_a_file=40, layers=3)
    held, most = {}, 0
    for step in range(9):
        new = {(rng.randrange(120 if step else 400), rng.choice("ab")): rng.choice("xyz") for _ in range(300 if step == 0 else 12)}
        done = t.upsert(spark.createDataFrame([(*k, v) for k, v in new.items()], table.schema))
        assert (done.inserted, done.updated) == (sum(k not in held for k in new), sum(k in held and held[k] != v for k, v in new.items()))
        held |= new
        assert {(r["id"], r["name"]): r["v"] for r in t.read().collect()} == held and t.read().count() == len(held)
        most = max(most, len(t._state()[1]))
    assert most <= 3
    t.compact()
    t.vacuum(1)
    assert len(t._state()[1]) == 1 == len(list((tmp_path / "t" / "versions").iterdir())) and t.read().count() == len(held)


def test_rows_without_key_and_other_kinds_of_keys(spark, tmp_path):
    table = catalog.parse("CREATE TABLE t (d DATE, v STRING, PRIMARY KEY (d))")["t"]
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys)
    make = lambda *r: spark.createDataFrame(list(r), "d string, v string").withColumn("d", F.col("d").cast("date"))
    t.upsert(make(("2024-01-01", "a"), (None, "n"), ("2024-01-02", "b")))
    t.upsert(make(("2024-01-02", "B"), (None, "n")))
    assert sorted((str(r["d"]), r["v"]) for r in t.read().collect()) == [("2024-01-01", "a"), ("2024-01-02", "B"), ("None", "n"), ("None", "n")]


def test_a_compaction_beside_a_writer_gives_way(spark, tmp_path):
    table = catalog.parse("CREATE TABLE t (id BIGINT, v STRING, PRIMARY KEY (id))")["t"]
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys)
    t.upsert(spark.createDataFrame([(i, "a") for i in range(50)], table.schema))
    t.upsert(spark.createDataFrame([(1, "b")], table.schema))
    number, layers = t._state()
    t.upsert(spark.createDataFrame([(2, "c")], table.schema))
    before = set((tmp_path / "t" / "versions").iterdir())
    with pytest.raises(sinks.Conflict):
        t._compact(number, layers, 0)
    assert set((tmp_path / "t" / "versions").iterdir()) == before and {r["v"] for r in t.read().collect()} == {"a", "b", "c"}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = catalog.parse("CREATE TABLE e (event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, PRIMARY KEY (event_id))")["e"]
    out = sinks.ParquetTable(spark, str(tmp_path / "out"), table.schema, table.keys)
    q = upserts.upsert_stream(stream.select(*table.schema.fieldNames()), out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert out.read().exceptAll(events.select(*table.schema.fieldNames())).count() == 0 and out.read().count() == events.count()
    windows = upserts.tumbling(spark.readStream.schema(events.schema).parquet(source), "1 day", ["event_type"], "100 days")
    q = windows.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rounded = lambda df: {(r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect()}
    assert rounded(spark.table("daily")) == rounded(upserts.tumbling(events, "1 day", ["event_type"]))
    assert upserts.sessions(events, "1 hour", "user_id").agg(F.sum("n")).first()[0] == events.count()


def test_ingestion(spark, tmp_path):
    from tessera.functions import text
    from tessera.sources import ingest

    wanted = spark.createDataFrame([(f"d{i}",) for i in range(10)] + [(None,), ("d1",)], "doi string")
    queue = ingest.pending(wanted, spark.createDataFrame([("d0",)], "doi string"), "doi")
    assert queue.count() == 9 and ingest.pending(wanted, queue.limit(0), "doi", 3).count() == 3
    got = ingest.batched_lookup(queue, "doi", lambda ks: {k: f"p{k}" for k in ks if k not in ("d3", "d4")}, 4, lambda k: "single" if k == "d3" else None)
    assert {r["doi"]: r["payload"] for r in got.collect()}["d3"] == "single" and tuple(ingest.match_rate(got).first()) == (9, 8, 0.8889)
    table = catalog.parse("CREATE TABLE t (id BIGINT, v STRING, PRIMARY KEY (id))")["t"]
    t = sinks.ParquetTable(spark, str(tmp_path / "t"), table.schema, table.keys)
    saved = {}
    rows = {"t": spark.createDataFrame([(1, "a")], table.schema)}
    done = ingest.drain("s", lambda c: rows, {"t": t}, lambda s: saved.get(s, (None,))[0], lambda s, c, st, e: saved.__setitem__(s, (c, st, e)), lambda r: "7")
    assert done["t"].inserted == 1 and saved["s"] == ("7", "ok", None)

    class Given:
        def fetch(self, cursor):
            return {"t": spark.createDataFrame([(2, cursor)], table.schema)}

    again = ingest.drain("s", Given(), {"t": t}, lambda s: saved[s][0], lambda s, c, st, e: saved.__setitem__(s, (c, st, e)), lambda r: None)
    assert again["t"].inserted == 1 and saved["s"] == ("7", "ok", None) and {r["v"] for r in t.read().collect()} == {"a", "7"}
    with pytest.raises(TypeError):
        ingest.drain("s", Given(), {"t": "no sink"}, lambda s: None, lambda *a: None, lambda r: None)

    def broken(_):
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        ingest.drain("s", broken, {"t": t}, lambda s: saved[s][0], lambda s, c, st, e: saved.__setitem__(s, (c, st, e)), lambda r: "9")
    assert saved["s"] == ("7", "error", "no answer")
    assert catalog.apply(spark, "CREATE OR REPLACE TEMP VIEW ${v} AS SELECT 1 AS x; CREATE OR REPLACE TEMP VIEW w AS SELECT 2 AS y", v="u1") == 2 and spark.table("u1").first()["x"] == 1
    text.register(spark)
    assert spark.sql("SELECT jaro_winkler('abc', 'abd') AS s").first()["s"] > 0.8
