"""Sources, sinks, ingestion and text search on the driver's tables, each beside the SQL that must give the same rows.

What a source reads is written first, to a new folder under ``spark.checkpoint.dir``, which the driver and all executors share.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import models
from tessera.operators import relational, search
from tessera.operators.graph import ensure_checkpoint_folder
from tessera.plans import outreach
from tessera.plans.registry import Tables, query
from tessera.sources import catalog, feeds, ingest, readers, sinks


def _folder(t: Tables, name: str) -> str:
    ensure_checkpoint_folder(t.region)
    found = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{found}/{name}-{uuid.uuid4().hex}"


def _tag(prefix: str, c, suffix: str = ""):
    return F.concat(F.lit(prefix), c.cast("string"), F.lit(suffix))


# ---- sources ------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0")
def s01_jsonl(t: Tables) -> DataFrame:
    """JSON lines with blank lines between them, beside a file that is not there."""
    where = _folder(t, "s01")
    line = F.when(F.col("c_custkey") % 3 > 0, F.to_json(F.struct("c_custkey", "c_mktsegment"))).otherwise("")
    t.customer.select(line.alias("value")).write.text(f"{where}/customers.jsonl")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType())])
    tables = catalog.parse("CREATE TABLE customers (c_custkey BIGINT, c_mktsegment STRING, PRIMARY KEY (c_custkey)); CREATE TABLE none_such (c_custkey BIGINT, c_mktsegment STRING, PRIMARY KEY (c_custkey));")
    held = readers.snapshot(t.spark, where, tables)
    return readers.jsonl(t.spark, f"{where}/customers.jsonl", schema).unionByName(held["none_such"]).where("c_custkey is not null").intersect(held["customers"])


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def s02_json_rows(t: Tables) -> DataFrame:
    """A whole table as JSON rows."""
    return relational.json_rows(t.nation.select("n_nationkey", "n_name"))


@query("SELECT p_partkey AS paper, p_name AS repo FROM part UNION ALL SELECT p_partkey, p_name FROM part")
def s06_link_archives(t: Tables) -> DataFrame:
    """Link archives by extension: Parquet and gzipped JSON."""
    where, rows = _folder(t, "s06"), t.part.select(F.col("p_partkey").alias("paper"), F.col("p_name").alias("repo"))
    rows.write.parquet(f"{where}/links.parquet")
    rows.coalesce(1).write.option("compression", "gzip").json(f"{where}/links.json")
    return readers.links(t.spark, f"{where}/links.parquet").unionByName(t.spark.read.schema(rows.schema).json(f"{where}/links.json"))


@query("SELECT 'http://host/abs/' || s_suppkey AS id, 'Title ' || s_suppkey AS title, 'Ann ' || s_suppkey || ',Bob' AS authors, CASE WHEN s_suppkey % 2 = 0 THEN 'cs.RO' END AS category FROM supplier")
def s08_atom(t: Tables) -> DataFrame:
    """Entries of Atom feeds."""
    where, k = _folder(t, "s08"), F.col("s_suppkey")
    entry = F.concat(F.lit("<entry><id>http://host/abs/"), k.cast("string"), F.lit("</id><title>Title\n   "), k.cast("string"), F.lit("</title><author><name>Ann "), k.cast("string"), F.lit("</name></author><author><name>Bob</name></author>"), F.when(k % 2 == 0, '<category term="cs.RO"/>').otherwise(""), F.lit("</entry>"))
    feed = t.supplier.agg(F.array_join(F.collect_list(entry), "").alias("all"))  # a fixture: one feed of all suppliers
    feed.select(F.concat(F.lit('<?xml version="1.0"?><feed>'), "all", F.lit("</feed>")).alias("value")).write.text(where)
    rows = readers.atom(t.spark, where)
    return rows.select("id", "title", F.array_join("authors", ",").alias("authors"), F.get("categories", F.lit(0)).alias("category"))


def _local(path: str) -> str:
    """A path for the feeds, whose files Python reads: they replay small fixtures."""
    return urlsplit(path).path if path.startswith("file:") else path


@query("SELECT page_id AS id, page_id % 20 AS stars FROM pages WHERE page_id % 20 >= 10")
def s09_search_windows(t: Tables) -> DataFrame:
    """A search over dates, its windows bisected into partitions, pages of a hundred, stars from ten on."""
    where, k = _folder(t, "s09"), F.col("page_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int"))
    t.pages.select(k.alias("id"), (k % 20).alias("stars"), day.cast("string").alias("day")).write.partitionBy("day").json(where)
    t.spark.dataSource.register(feeds.SearchSource)
    read = t.spark.read.format("search").option("path", _local(where)).option("schema", "id long, stars long").option("first", "2024-01-01").option("last", "2024-01-30")
    return read.option("field", "stars").option("least", "10").option("most", "50").load()


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 'single ' || c_custkey WHEN c_custkey % 11 > 0 THEN 'batch ' || c_custkey END AS payload, c_custkey % 7 = 0 OR c_custkey % 11 > 0 AS found FROM customer WHERE c_custkey % 5 > 0")
def s12_batched_lookup(t: Tables) -> DataFrame:
    """Keys that are not stored yet, fifty a call, halves of calls that fail, single calls for what was missed."""

    def call(keys: list) -> dict:
        if len(keys) > 20:
            raise TimeoutError
        return {k: f"batch {k}" for k in keys if k % 7 and k % 11}

    keys = t.customer.select(F.col("c_custkey").alias("key"))
    queue = ingest.pending(keys, keys.where("key % 5 = 0"), "key")
    asked = ingest.batched_lookup(queue, "key", call, 50, lambda k: f"single {k}" if k % 7 == 0 else None, failed=TimeoutError)
    return asked.unionByName(ingest.batched_lookup(queue, "key", call, 50, enabled=False))


@query("SELECT c_nationkey AS project, 'detail ' || c_nationkey AS payload, true AS found FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_nationkey")
def s14_sweep(t: Tables) -> DataFrame:
    """A list of people and one detail for each distinct project."""
    people = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("project"))
    return ingest.sweep(people, "project", lambda ks: {k: f"detail {k}" for k in ks})


@query("""WITH w AS (SELECT 'r' || s_suppkey AS key, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 > 0) SELECT 'repository' AS kind, key, '{"core":["u' || k % 6 || '","u' || k % 9 || '"]}' AS payload FROM w UNION ALL SELECT 'profile', key, 'p ' || key FROM (SELECT 'u' || k % 6 AS key FROM w UNION SELECT 'u' || k % 9 FROM w)""")
def z04_fetch_chain(t: Tables) -> DataFrame:
    """Given and discovered repositories, those stored left out, hydrated, then profiles of their core logins."""
    keys = t.supplier.select(_tag("r", F.col("s_suppkey")).alias("key"), "s_suppkey")

    def hydrate(names: list) -> dict:
        return {n: '{"core":["u%d","u%d"]}' % (int(n[1:]) % 6, int(n[1:]) % 9) for n in names}

    repos, profiles = ingest.fetch_chain(keys.where("s_suppkey % 2 = 0"), keys.where("s_suppkey % 3 = 0 or s_suppkey % 2 = 1"), keys.where("s_suppkey % 4 = 0"), hydrate, lambda p: F.from_json(F.get_json_object(p, "$.core"), "array<string>"), lambda names: {n: f"p {n}" for n in names})
    return repos.select(F.lit("repository").alias("kind"), "key", "payload").unionByName(profiles.select(F.lit("profile").alias("kind"), "key", "payload"))


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def s20_replay(t: Tables) -> DataFrame:
    """Items out of paged JSON responses that are kept as text files."""
    where = _folder(t, "s20")
    pages = t.part.groupBy((F.col("p_partkey") % 7).alias("page")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).alias("items"))
    pages.select(F.to_json(F.struct("items")).alias("value")).repartition(7).write.text(where)
    lines = t.spark.read.text(where)
    return lines.select(F.explode(F.from_json("value", "struct<items:array<struct<id:long,name:string>>>")["items"]).alias("i")).select("i.id", "i.name")


# ---- sinks --------------------------------------------------------------------------------------


_TABLE = "CREATE TABLE parties (c_custkey BIGINT, c_name STRING, PRIMARY KEY (c_custkey));"


@query("""
SELECT 'row' AS kind, c_custkey AS k, CASE WHEN c_custkey % 10 = 0 AND c_nationkey <> 7 THEN 'new' ELSE c_name END AS v FROM customer WHERE c_nationkey <> 7 OR c_custkey % 10 <> 3
UNION ALL SELECT 'count', x.i, x.n::VARCHAR FROM (SELECT 1 AS i, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FROM customer WHERE c_custkey % 10 = 3 AND c_nationkey <> 7 UNION ALL SELECT 4, count(*) FROM customer WHERE c_custkey % 10 = 0 AND c_nationkey <> 7 UNION ALL SELECT 5, count(*) FROM customer WHERE c_custkey % 10 IN (0, 3) AND c_nationkey = 7) x
""")
def k06_sink(t: Tables) -> DataFrame:
    """A table written, merged again without change, then with changes and suppressed keys; its rows and the counts."""
    spec = catalog.parse(_TABLE)["parties"]
    table = sinks.ParquetTable(t.spark, _folder(t, "k06"), spec.schema, spec.keys)
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey")
    first = table.upsert(rows.where("c_custkey % 10 <> 3"))
    again = table.upsert(rows.where("c_custkey % 10 <> 3"))
    gone = rows.where("c_nationkey = 7").select(F.lit("crm").alias("source"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("key_hash"))
    third = table.upsert(rows.where("c_custkey % 10 in (0, 3)").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, "new").otherwise(F.col("c_name"))), suppressed=gone, key="c_custkey", source=F.lit("crm"))
    counts = [first.inserted, again.inserted + again.updated, third.inserted, third.updated, third.suppressed]
    told = t.region.limit(1).select(F.posexplode(F.array(*(F.lit(n) for n in counts))).alias("k", "v")).select(F.lit("count").alias("kind"), (F.col("k") + 1).cast("long").alias("k"), F.col("v").cast("string").alias("v"))
    return table.read().select(F.lit("row").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("v")).unionByName(told)


@query("SELECT 'a' AS name, count(*) AS n FROM customer UNION ALL SELECT 'b', count(*) FROM nation")
def k07_fan_out(t: Tables) -> DataFrame:
    """All tables that have rows to their sinks, by name; a dry run writes nothing (K7, K8)."""
    spec = catalog.parse(_TABLE)["parties"]
    tables = {"b": t.nation.select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_name")), "a": t.customer.select("c_custkey", "c_name"), "empty": t.customer.where("c_custkey < 0").select("c_custkey", "c_name")}
    done = sinks.sink_all({n: sinks.ParquetTable(t.spark, _folder(t, f"k07{n}"), spec.schema, spec.keys) for n in tables}, tables)
    dry = sinks.NullSink()
    for n in done:
        dry.upsert(n, tables[n])
    told = dict(dry.calls)
    return t.region.limit(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c.inserted if c.inserted == told[n] else -1).cast("long").alias("n")) for n, c in done.items()))).alias("x")).select("x.*")


@query("""SELECT 'ok' AS kind, c_custkey AS k, NULL AS reason FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'bad', c_custkey, 'negative' FROM customer WHERE c_acctbal < 0""")
def k11_checked_stream(t: Tables) -> DataFrame:
    """A stream merged by micro-batch, rows that fail a check kept by source and natural key."""
    from tessera.streaming.upserts import upsert_checked

    where = _folder(t, "k11")
    t.customer.select("c_custkey", "c_name", "c_acctbal").repartition(2).write.parquet(f"{where}/in")
    spec = catalog.parse(_TABLE)["parties"]
    table = sinks.ParquetTable(t.spark, f"{where}/out", spec.schema, spec.keys)
    wrong = catalog.parse("CREATE TABLE rejects (source STRING, natural_key STRING, reason STRING, payload STRING, PRIMARY KEY (source, natural_key));")["rejects"]
    bad = sinks.ParquetTable(t.spark, f"{where}/bad", wrong.schema, wrong.keys)
    stream = t.spark.readStream.schema("c_custkey long, c_name string, c_acctbal double").option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    upsert_checked(stream, table, bad, F.col("c_acctbal") >= 0, F.lit("negative"), "crm", "c_custkey", f"{where}/checkpoint").awaitTermination()
    good = table.read().select(F.lit("ok").alias("kind"), F.col("c_custkey").alias("k"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.read().select(F.lit("bad").alias("kind"), F.col("natural_key").cast("long").alias("k"), "reason"))


@query("SELECT 'src' || n_nationkey AS source, CASE WHEN n_nationkey = 3 THEN '9' ELSE n_nationkey::VARCHAR END AS cursor, CASE WHEN n_nationkey = 4 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_nationkey = 4 THEN repeat('x', 1000) END AS error FROM nation")
def z02_cursors(t: Tables) -> DataFrame:
    """Cursors that move only with a value; errors are cut."""
    n = F.col("n_nationkey")
    held = t.nation.select(_tag("src", n).alias("source"), n.cast("string").alias("cursor"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return sinks.advance(sinks.advance(held, "src3", "9", "ok"), "src4", None, "error", "x" * 2000)


# ---- filters and answers ------------------------------------------------------------------------


@query("SELECT 'active' AS kind, count(*) AS k FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'first', min(n_nationkey) FROM nation WHERE n_nationkey % 4 > 0")
def p07_active(t: Tables) -> DataFrame:
    """Active members only; the first row that is not switched off."""
    from tessera.plans import scoring, views

    persons = t.customer.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 3 > 0, "active").otherwise("merged").alias("status"))
    team = views.venture_team(t.customer.select(F.col("c_custkey").alias("person_id"), F.lit(1).alias("venture_id")), persons)
    flags = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.when(F.col("n_nationkey") % 4 == 0, False).when(F.col("n_nationkey") % 4 == 1, True).alias("is_active"))
    return team.agg(F.count("*").alias("k")).select(F.lit("active").alias("kind"), "k").unionByName(scoring.first_active(flags, "k").select(F.lit("first").alias("kind"), "k"))


@query("SELECT l_orderkey, l_partkey, l_linestatus, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p13_leading_columns(t: Tables) -> DataFrame:
    """The columns worth showing of a wide table: two ids, named ones, then the rest up to eight."""
    return t.lineitem.select(*relational.leading_columns(t.lineitem.columns))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'cached ' || c_nationkey ELSE 'made prompt ' || c_nationkey END AS answer FROM customer")
def x05_answers(t: Tables) -> DataFrame:
    """Answers from a table that caches calls, else from a pluggable model."""
    prompts = t.customer.select("c_custkey", _tag("prompt ", F.col("c_nationkey")).alias("prompt"))
    cache = t.nation.where("n_nationkey < 5").select(F.sha2(_tag("prompt ", F.col("n_nationkey")), 256).alias("prompt_hash"), _tag("cached ", F.col("n_nationkey")).alias("answer"))
    return models.answered(prompts, "prompt", cache, lambda c: F.concat(F.lit("made "), c)).select("c_custkey", "answer")


@query("SELECT o_custkey AS person_id, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS headline FROM orders GROUP BY 1")
def z15_headlines(t: Tables) -> DataFrame:
    """Facts of a person in order, as one prompt to a model."""
    facts = t.orders.select(F.col("o_custkey").alias("person_id"), "o_orderkey", F.col("o_orderpriority").alias("fact"))
    return models.headlines(facts, "person_id", "fact", "o_orderkey", lambda c: c)


@query("SELECT s_suppkey AS venture_id, CASE WHEN s_suppkey % 3 < 2 THEN 'new' ELSE 'old' END AS memo_id FROM supplier")
def z32_memos(t: Tables) -> DataFrame:
    """Memos whose bullets cite or name a gap, one repair, a new latest row."""
    k = F.col("s_suppkey")
    good, bad = '{"sections": [{"title": "t", "bullets": [{"text": "a", "citations": ["u"]}]}]}', '{"sections": [{"title": "t", "bullets": [{"text": "a"}]}]}'
    rows = lambda which: t.supplier.select(k.alias("venture_id"), F.lit("new").alias("memo_id"), F.when(which, good).otherwise(bad).alias("memo"))
    history = t.supplier.select(k.alias("venture_id"), F.lit("old").alias("memo_id"), F.lit(good).alias("memo"), F.lit(True).alias("is_latest"))
    return outreach.memo_rows(rows(k % 3 == 0), rows(k % 3 == 1), history).where("is_latest").select("venture_id", "memo_id")


# ---- search -------------------------------------------------------------------------------------

# Six texts by key; what a query for tactile robots must find in each follows from the rules of endings, concepts and weights.
_TEXTS = ("TactileRobots for grasping, tested in Zürich", "sensing skins and robotic arms", "the warehouses of Basel", "nothing here", "at ETH and EPFL: touch sensors; made at EPFL", None)


@query("""
WITH k AS (SELECT p_partkey, p_partkey % 6 AS i FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN round((3.0 + 3.0 + 1.25) / 10.25, 4) WHEN 1 THEN round((3.0 + 3.0 + 1.25) / 10.25, 4) WHEN 4 THEN round(3.0 / 10.25, 4) END::DOUBLE AS relevance,
 CASE i WHEN 0 THEN 'TactileRobots for grasping, tested in Zürich' WHEN 1 THEN 'sensing skins and robotic arms' ELSE '…ETH and EPFL: touch sensors; made at EPFL' END AS snippet,
 CASE i WHEN 0 THEN '0-7,7-13' WHEN 1 THEN '0-7,8-13,18-25,26-30' ELSE '15-20,21-28' END AS ranges, CASE i WHEN 0 THEN 'Zurich explicit' WHEN 4 THEN 'Lausanne inferred' END AS place
FROM k WHERE i IN (0, 1, 4)
""")
def q02_tokens_and_snippets(t: Tables) -> DataFrame:
    """Camel case, endings, concepts, neighbours, snippets with their ranges, places."""
    said = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    hits = search.search(t.part.select("p_partkey", said.alias("name"), F.lit(1.0).alias("final_score")), [("name", "name", 3.0)], "tactile robots", key="p_partkey")
    first, where = F.get("matched", F.lit(0)), search.location(F.col("name"))
    return hits.select("p_partkey", "relevance", first["snippet"].alias("snippet"), F.array_join(F.transform(first["ranges"], lambda r: F.concat_ws("-", r[0], r[1])), ",").alias("ranges"), F.concat_ws(" ", where["city"], where["confidence"]).alias("place")).withColumn("place", F.nullif("place", F.lit("")))
