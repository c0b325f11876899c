"""Further registered queries: functions, guards and folds on the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, text
from tessera.operators import graph, relational
from tessera.plans.queries import _PAIRS, _pairs
from tessera.plans.registry import Tables, query
from tessera.sources.readers import parquet_sql

_ORDERED = "list_filter(l, lambda x, i: list_position(l, x) = i)"


@query(f"SELECT p_partkey, array_to_string({_ORDERED}, ' ') AS profile FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type || ' ' || p_name || ' ' || p_brand), ' ') AS l FROM part)")
def f26_profile_text(t: Tables) -> DataFrame:
    """Tokens of several texts, each once, in order."""
    return t.part.select("p_partkey", text.profile_text(F.col("p_name"), F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("profile"))


@query(r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\$\$\$') THEN 'symbols' END, CASE WHEN regexp_matches(text, '[A-Z]{6,}') THEN 'capitals' END, CASE WHEN regexp_matches(text, '\|') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS signals,
 nullif(coalesce(nullif(regexp_extract(text, '[A-Z]{6,}!+'), ''), regexp_extract(text, '\w+\$\$\$')), '') AS snippet FROM documents
""")
def f17_signals(t: Tables) -> DataFrame:
    """Which patterns a text shows, in order, and what the first of some matched."""
    found = text.first_matches(F.col("text"), {"symbols": r"\$\$\$", "capitals": "[A-Z]{6,}", "table": r"\|"})
    return t.documents.select("doc_id", F.array_join(found, ",").alias("signals"), text.snippet(F.col("text"), ["[A-Z]{6,}!+", r"[0-9A-Za-z_]+\$\$\$"]).alias("snippet"))


@query("""
SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 604800.0, 1) AS weeks, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY) AS recent FROM events GROUP BY user_id
""")
def n6_spans(t: Tables) -> DataFrame:
    """Spans in weeks, and what falls in a trailing window of a given clock."""
    start = F.lit("2024-01-31").cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS")
    span = numbers.span_weeks(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"))
    return t.events.groupBy("user_id").agg(span.alias("weeks"), F.count_if(F.col("ts") >= start).alias("recent"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(least(1.0, c_acctbal / 5000.0), 6) END AS closeness, CASE WHEN c_acctbal > 0 THEN 50 * 0.8 + 50 * 0.6 ELSE 35.0 END::DOUBLE AS institution FROM customer")
def n10_closeness(t: Tables) -> DataFrame:
    """How near a target, unknown values staying unknown; known or floor."""
    known = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    seed = F.when(known.isNotNull(), 0.8)
    return t.customer.select("c_custkey", F.round(numbers.closeness(known, F.lit(5000.0)), 6).alias("closeness"), numbers.institution_score(seed, F.lit(0.6)).alias("institution"))


@query("""
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) < 2 THEN NULL WHEN count(*) >= 10 OR date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 365.25 >= 5.0 THEN 90.0 WHEN count(*) >= 5 THEN 65.0 ELSE 30.0 END::DOUBLE AS score FROM orders GROUP BY o_custkey
""")
def n12_ladder(t: Tables) -> DataFrame:
    """Shared history by contexts and years; null for one party alone."""
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), (F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / 365.25).alias("y"), F.count_distinct("o_orderstatus").alias("team"))
    contexts = F.when(F.col("n") >= 10, 2).when(F.col("n") >= 5, 1).otherwise(0)
    return rows.select("o_custkey", numbers.collaboration_score(contexts, F.col("y") - 3.0, F.col("team")).alias("score"))


@query("SELECT p_partkey, 'brand=' || p_brand || ',size=' || CASE WHEN p_size > 25 THEN 'large' ELSE p_size::VARCHAR END || CASE WHEN p_size > 25 THEN ',flag=yes' ELSE '' END AS merged FROM part")
def u6_map_merge(t: Tables) -> DataFrame:
    """Maps put together; the second wins."""
    base = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    over = F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.lit("large"), F.lit("flag"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    merged = F.map_concat(kept, over)
    parts = F.filter(F.transform(F.array(F.lit("brand"), F.lit("size"), F.lit("flag")), lambda k: F.concat(k, F.lit("="), F.try_element_at(merged, k))), lambda x: x.isNotNull())
    return t.part.select("p_partkey", F.array_join(parts, ",").alias("merged"))


@query("WITH RECURSIVE " + _PAIRS.replace("WITH", "").strip() + ", e AS (SELECT l AS x, r AS y FROM p UNION SELECT r, l FROM p), w(id, m) AS (SELECT id, id FROM c UNION SELECT e.y, w.m FROM w JOIN e ON e.x = w.id WHERE w.m < e.y), k AS (SELECT id, min(m) AS component FROM w GROUP BY id) SELECT id, component, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'other' END AS source, row_number() OVER (PARTITION BY component, c_acctbal > 5000 ORDER BY id) = 1 AS kept FROM k JOIN customer ON c_custkey = id")
def g10_guard(t: Tables) -> DataFrame:
    """Components in which only the first record of a source stays."""
    nodes = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, "rich").otherwise("other").alias("source"))
    placed = graph.components(nodes, _pairs(t).select(F.col("left").alias("a"), F.col("right").alias("b"))).join(nodes, "id")
    w = Window.partitionBy("component", "source").orderBy("id")
    return placed.select("id", "component", "source", (F.row_number().over(w) == 1).alias("kept"))


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation WHERE n_regionkey = 2")
def s7_parquet_sql(t: Tables) -> DataFrame:
    """A path as a table of a SQL statement."""
    return parquet_sql(t.spark, f"{t.folder}/nation.parquet", "n_nationkey, upper(n_name) AS name", "n_regionkey = 2")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS s_click, count(*) FILTER (event_type = 'view') AS s_view, max(value) FILTER (event_type = 'purchase') AS best FROM events GROUP BY user_id")
def z25_pivot(t: Tables) -> DataFrame:
    """Categories laid out in columns."""
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("value").alias("n"), F.max("value").alias("m"))
    return wide.select("user_id", F.coalesce("click_n", F.lit(0)).alias("s_click"), F.coalesce("view_n", F.lit(0)).alias("s_view"), F.col("purchase_m").alias("best"))


@query("SELECT l_partkey, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS independent, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) < 2 AS provisional, count(*) AS facts FROM lineitem GROUP BY l_partkey")
def a15_corroboration(t: Tables) -> DataFrame:
    """Independent kinds of evidence; fewer than two is provisional."""
    independent = F.size(F.array_except(F.collect_set("l_returnflag"), F.array(F.lit("N")))).cast("long")
    return t.lineitem.groupBy("l_partkey").agg(independent.alias("independent"), F.count("*").alias("facts")).withColumn("provisional", F.col("independent") < 2)


@query("""
SELECT l, r, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS pair_id
FROM (SELECT a.n_name AS l, b.n_name AS r, sha1(unhex('%s') || encode(least(a.n_name, b.n_name) || ':' || greatest(a.n_name, b.n_name))) AS h FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
""" % ids.NAMESPACE.hex)
def h5_pair_ids(t: Tables) -> DataFrame:
    """One id for both orders of a pair (H5)."""
    a = t.nation.select("n_regionkey", F.col("n_nationkey").alias("x"), F.col("n_name").alias("l"))
    b = t.nation.select("n_regionkey", F.col("n_nationkey").alias("y"), F.col("n_name").alias("r"))
    return a.join(b, "n_regionkey").where("x <> y").select("l", "r", ids.pair_id(F.col("l"), F.col("r")).alias("pair_id"))


@query("SELECT c_custkey, lower(substr(c_name, 1, 8)) || '1' AS login, c_acctbal > 0 AND c_mktsegment = 'BUILDING' AS matched FROM customer")
def f11_login(t: Tables) -> DataFrame:
    """A login that is the name without spaces; unknown names never match."""
    login = F.concat(F.lower(F.substring("c_name", 1, 8)), F.lit("1"))
    name = F.when(F.col("c_acctbal") > 0, F.when(F.col("c_mktsegment") == "BUILDING", F.lit("cus tomer1")).otherwise("some one"))
    return t.customer.select("c_custkey", login.alias("login"), text.login_is_name(login, name).alias("matched"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def p10_since(t: Tables) -> DataFrame:
    """Rows since a watermark; the filter reaches the scan (P10)."""
    return relational.since(t.orders, "o_orderdate", F.lit("2001-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_totalprice", "o_orderdate")
