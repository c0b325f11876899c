"""Records between platforms and stores, declared schemas, and a load with its proofs, each beside the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, text
from tessera.operators import relational
from tessera.operators.order import global_rank
from tessera.operators.storage import shared_folder
from tessera.plans import records, views
from tessera.plans.registry import Tables, query
from tessera.sources import catalog, readers, sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"""
WITH p AS (SELECT *, sha1(unhex('{ids.NAMESPACE.hex}') || encode('project:' || p_partkey)) AS h FROM part WHERE p_partkey % 7 > 1)
SELECT {_UUID} AS project_id, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'a,b' END AS tags, p_partkey % 2 = 0 AS is_winner, CASE WHEN p_partkey % 4 = 0 THEN 'github.com/o/r' || p_partkey END AS github_url, CASE WHEN p_partkey % 4 > 1 THEN (p_partkey % 4)::INT END AS contributor_count,
 CASE WHEN p_partkey % 3 = 1 THEN '2024-05-06 07:08:09' END AS created, NULL::INT AS stars, 35 AS columns, NULL AS reason FROM p
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 35, CASE p_partkey % 7 WHEN 0 THEN 'no id' ELSE 'no object' END FROM part WHERE p_partkey % 7 < 2
""")
def p06_project_rows(t: Tables) -> DataFrame:
    """Payloads of one platform as full rows of another's table, typed nulls for what it does not know, and the rejects."""
    k = F.col("p_partkey")
    fields = [
        F.when(k % 7 > 1, k).alias("id"), F.when(k % 5 > 0, F.col("p_name")).alias("title"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), (k % 2 == 0).alias("winner"),
        F.when(k % 4 == 0, F.concat(F.lit("https://www.GitHub.com/o/r"), k.cast("string"), F.lit("/"))).alias("githubUrl"), F.when(k % 4 > 1, F.sequence(F.lit(1), (k % 4).cast("int"))).alias("team"), F.when(k % 3 == 1, "2024-05-06T07:08:09Z").when(k % 3 == 2, "yesterday").alias("createdAt"),
    ]
    payload = F.when(k % 7 == 1, F.lit("[1]")).otherwise(F.to_json(F.struct(*fields)))
    raw = t.part.select(F.parse_json(payload).alias("payload"), F.lit("u").alias("source_url"), F.lit("2024-06-01").cast("timestamp").alias("scraped_at"))
    rows, bad = records.project_rows(raw, "payload", "showcase", F.lit("2024-06-02").cast("timestamp"))
    wide = F.lit(len(rows.columns)).alias("columns")
    good = rows.select("project_id", "name", F.array_join("market_tags", ",").alias("tags"), "is_winner", "github_url", "contributor_count", F.date_format("created_at_source", "yyyy-MM-dd HH:mm:ss").alias("created"), "stars", wide, F.lit(None).cast("string").alias("reason"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return good.unionByName(bad.select(none("string", "project_id"), none("string", "name"), none("string", "tags"), none("boolean", "is_winner"), none("string", "github_url"), none("int", "contributor_count"), none("string", "created"), none("int", "stars"), wide, "reason"))


@query("SELECT 's' || s_suppkey AS record_id, CASE WHEN s_suppkey % 4 = 0 THEN 'x@y.org' ELSE '' END AS mails, CASE WHEN s_suppkey % 2 = 0 THEN '2024-03-04T05:06:07+00:00' ELSE '' END AS last_seen_at, 24 AS columns FROM supplier")
def z13_record_view(t: Tables) -> DataFrame:
    """Stored records as matching reads them: times as text, lists without nulls."""
    k = F.col("s_suppkey")
    stored = t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("record_id"), F.when(k % 4 == 0, F.array(F.lit("x@y.org"), F.lit(None))).alias("email_norms"), F.when(k % 2 == 0, F.lit("2024-03-04 05:06:07").cast("timestamp")).alias("last_seen_at"))
    view = records.record_view(stored)
    return view.select("record_id", F.array_join("email_norms", ",").alias("mails"), "last_seen_at", F.lit(len(view.columns)).alias("columns"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'known org' WHEN c_custkey % 4 = 1 THEN 'other' END AS org_norm FROM customer")
def f07_organisations(t: Tables) -> DataFrame:
    """Affiliations by the name of the known institution that has them as an alias, else by their own key."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, "KO Inc.").when(k % 4 == 1, "Other GmbH")
    raw = t.customer.select(F.lit("crm").alias("source"), k.cast("string").alias("source_key"), said.alias("affiliation_raw"))
    seed = t.region.where("r_regionkey = 0").select(F.lit("KO").alias("alias"), F.lit("Known Org").alias("name"))
    return records.derive(records.observed(raw), seed).select(F.col("source_key").cast("long").alias("c_custkey"), "org_norm")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.2 ELSE round(0.5 + CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.15 ELSE 0 END, 2) END::DOUBLE AS likeness FROM part")
def f20_repo_likeness(t: Tables) -> DataFrame:
    """How much a repository looks like a product."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("awesome-"), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", text.repo_likeness(name, F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, "see https://arxiv.org/abs/2101.00001").otherwise("plain")).alias("likeness"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey)::INT AS place FROM orders")
def o12_stable_order(t: Tables) -> DataFrame:
    """Places in a total order over the whole table, the same however rows are dealt."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").repartition(5)
    return global_rank(rows, [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


_NESTED = """
CREATE TABLE ${c}.orders (o_orderkey BIGINT NOT NULL, placed TIMESTAMP, parts ARRAY<STRUCT<at: TIMESTAMP, price: DOUBLE>>, extra VARIANT, note STRING, PRIMARY KEY (o_orderkey));
ALTER TABLE ${c}.orders ADD CONSTRAINT positive CHECK (size(parts) > 0); -- and once more
ALTER TABLE ${c}.orders ADD CONSTRAINT positive CHECK (size(parts) > 0);
"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS placed, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS second, round(o_totalprice, 2) AS price, o_orderpriority AS priority, NULL AS note FROM orders""")
def m06_coerced(t: Tables) -> DataFrame:
    """JSON cells as the types of a DDL tree, at any depth; junk and missing cells null; variants staged as text and read again."""
    spec = catalog.parse(_NESTED, c="dev")["dev.orders"]
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
    parts = F.to_json(F.array(F.struct(iso(F.col("o_orderdate")).alias("at"), F.col("o_totalprice").alias("price")), F.struct(iso(later).alias("at"), F.lit(1.0).alias("price"))))
    cells = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "no time").otherwise(iso(F.col("o_orderdate"))).alias("placed"), parts.alias("parts"), F.to_json(F.struct(F.col("o_orderpriority").alias("p"))).alias("extra"))
    typed = catalog.coerce(cells, spec.schema)
    staged = relational.wire(typed, ("extra",))  # a variant leaves as text
    back = catalog.coerce(staged, spec.schema)
    first, second = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    return back.select("o_orderkey", F.date_format("placed", "yyyy-MM-dd HH:mm:ss").alias("placed"), F.date_format(second["at"], "yyyy-MM-dd").alias("second"), F.round(first["price"], 2).alias("price"), F.try_variant_get("extra", "$.p", "string").alias("priority"), "note")


@query("SELECT n_nationkey, n_name, 1 AS ran, 1 AS skipped FROM nation WHERE n_name <> 'a;b'")
def k17_applied(t: Tables) -> DataFrame:
    """A DDL text applied: names filled in, comments cut, quoted semicolons kept; a constraint added again changes nothing."""
    t.nation.createOrReplaceTempView("k17_nation")
    known = catalog.parse(_NESTED, c="dev")
    known["dev.orders"].checks.clear()
    done = catalog.apply(t.spark, _NESTED.split(";", 1)[1], known, c="dev")
    catalog.apply(t.spark, "CREATE OR REPLACE TEMP VIEW ${v} AS SELECT n_nationkey, n_name FROM k17_nation WHERE n_name <> 'a;b'; -- shown below", v="k17_shown")
    return t.spark.table("k17_shown").withColumns({"ran": F.lit(done.ran), "skipped": F.lit(done.skipped)})


_LOADED = """CREATE TABLE ventures (venture_id BIGINT, name STRING, status STRING, PRIMARY KEY (venture_id)); CREATE TABLE scores (score_id BIGINT, venture_id BIGINT, final_score DOUBLE, is_latest BOOLEAN, PRIMARY KEY (score_id));
CREATE TABLE members (venture_id BIGINT, person_id BIGINT, PRIMARY KEY (venture_id, person_id)); CREATE TABLE persons (person_id BIGINT, full_name STRING, status STRING, PRIMARY KEY (person_id))"""


@query("""
WITH r AS (SELECT p_name || ' ' || round(s, 1) || ' ' || 'open' AS line, row_number() OVER (ORDER BY s DESC NULLS LAST, p_partkey)::INT AS n FROM part LEFT JOIN (SELECT o_orderkey, round(o_totalprice / 1000, 3) AS s FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = p_partkey WHERE s IS NOT NULL),
m AS (SELECT c_name || ' ' || c_nationkey AS line, row_number() OVER (ORDER BY c_name, c_custkey)::INT AS n FROM customer WHERE c_acctbal >= 0)
SELECT 'ranked' AS view, n, line FROM r UNION ALL SELECT 'team', n, line FROM m UNION ALL SELECT 'inserted', 1, ((SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM customer))::VARCHAR UNION ALL SELECT 'again', 1, '0'
""")
def z43_loaded(t: Tables) -> DataFrame:
    """Tables written as JSON lines, loaded in order of their names by the keys of their DDL, loaded again without change, and proved by
    the ordered rows of views over them (Z43, Z44, S5, W7)."""
    where, spec = _folder(t, "z43"), catalog.parse(_LOADED)
    given = {
        "ventures": t.part.select(F.col("p_partkey").alias("venture_id"), F.col("p_name").alias("name"), F.lit("open").alias("status")),
        "scores": t.orders.select(F.col("o_orderkey").alias("score_id"), F.col("o_orderkey").alias("venture_id"), numbers.rounded(F.col("o_totalprice") / 1000, 3).alias("final_score"), (F.col("o_orderkey") % 2 == 0).alias("is_latest")),
        "members": t.customer.select(F.col("c_nationkey").cast("long").alias("venture_id"), F.col("c_custkey").alias("person_id")),
        "persons": t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("full_name"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("merged").alias("status")),
    }
    for name, df in given.items():
        df.write.json(f"{where}/in/{name}.jsonl")
    held = readers.snapshot(t.spark, f"{where}/in", spec)
    stores = {n: sinks.ParquetTable(t.spark, f"{where}/{n}", s.schema, s.keys) for n, s in spec.items()}
    first, again = (sinks.sink_all(stores, held) for _ in range(2))
    table = {n: s.read() for n, s in stores.items()}
    ranked = views.ranked_ventures(table["ventures"], table["scores"]).where("final_score is not null")
    ranked = global_rank(ranked, [F.desc_nulls_last("final_score"), F.col("venture_id")], "n").select(F.lit("ranked").alias("view"), "n", F.concat_ws(" ", "name", numbers.rounded(F.col("final_score"), 1).cast("string"), "status").alias("line"))
    team = global_rank(views.venture_team(table["members"], table["persons"]), [F.col("full_name"), F.col("person_id")], "n").select(F.lit("team").alias("view"), "n", F.concat_ws(" ", "full_name", F.col("venture_id").cast("string")).alias("line"))
    told = [("inserted", sum(c.inserted for c in first.values())), ("again", sum(c.inserted + c.updated for c in again.values()))]
    counts = (t.region.limit(1).select(F.lit(k).alias("view"), F.lit(1).alias("n"), F.lit(str(x)).alias("line")) for k, x in told)
    return reduce(DataFrame.unionByName, (ranked, team, *counts))
