"""Jobs of features, scoring, pools and raw records on the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import documents, ids, text
from tessera.operators.graph import ensure_checkpoint_folder
from tessera.plans import features, outreach, records, scoring, views
from tessera.plans.registry import Tables, query

# ---- scoring ------------------------------------------------------------------------------------

# Features of persons (customers) as expressions that both sides read alike; forty ventures.
_FEATURES = {
    "stars_weighted": "case when c_custkey % 4 > 0 then c_custkey % 17 / 2.0 end",
    "commits_12mo": "case when c_custkey % 3 > 0 then c_custkey % 50 / 1.0 end",
    "commit_quality": "case when c_custkey % 5 = 0 then 60.0 end",
    "citations_total": "case when c_custkey % 2 = 0 then c_custkey % 9 * 10.0 end",
    "zero_to_one_flag": "case when c_custkey % 6 = 0 then 1.0 end",
    "experience_problem_fit": "case when c_custkey % 7 = 0 then 80.0 end",
    "top_co_flag": "case when c_custkey % 8 = 0 then 1.0 end",
    "school_tier": "case when c_custkey % 3 = 1 then c_custkey % 11 / 10.0 end",
    "recency_score": "case when c_custkey % 2 = 1 then 0.5 end",
}
_F = "WITH f AS (SELECT c_custkey AS person_id, c_custkey % 40 AS venture_id, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _FEATURES.items()) + " FROM customer)"


def _team(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.customer.selectExpr("c_custkey as person_id", "c_custkey % 40 as venture_id", *(f"cast({e} as double) as {n}" for n, e in _FEATURES.items()))
    bag = F.map_filter(F.create_map(*(x for n in _FEATURES for x in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull())
    return rows.select("venture_id", "person_id"), rows.select("person_id", bag.alias("features"))


def _mean(*parts: tuple[str, float]) -> str:
    top, bottom = (" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} * {v} END" for c, w in parts for v in [c if k == 0 else "1"]) for k in (0, 1))
    return f"(({top}) / nullif({bottom}, 0))"


_SHARES = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN cume_dist() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) END AS p_{c}" for c in ("stars_weighted", "commits_12mo", "citations_total"))
_SCORES = _F + f""", p AS (SELECT *, {_SHARES} FROM f), q AS (SELECT *, {_mean(('p_stars_weighted', 1.0), ('p_commits_12mo', 1.0), ('(commit_quality / 100)', 1.0))} AS github FROM p),
x AS (SELECT venture_id, 100 * {_mean(('top_co_flag', 0.25), ('github', 0.3), ('zero_to_one_flag', 0.2), ('p_citations_total', 0.15), ('(experience_problem_fit / 100)', 0.1))} AS s FROM q),
ex AS (SELECT venture_id, round(0.6 * avg(s) + 0.4 * max(s), 1) AS score FROM x WHERE s IS NOT NULL GROUP BY 1),
sc AS (SELECT venture_id, round(0.7 * max(school_tier * 100) + (1 - 0.7) * avg(school_tier * 100), 1) AS score FROM f WHERE school_tier IS NOT NULL GROUP BY 1),
fa AS (SELECT venture_id, person_id, o_orderkey % 60 AS artifact, o_orderdate::DATE AS d FROM f JOIN orders ON o_custkey = person_id), sh AS (SELECT venture_id, artifact, min(d) AS a, max(d) AS b FROM fa GROUP BY ALL HAVING count(DISTINCT person_id) >= 2),
ctx AS (SELECT venture_id, count(*) AS contexts, round(date_diff('day', min(a), max(b)) / 365.25, 2) AS years FROM sh GROUP BY 1),
pr AS (SELECT venture_id, CASE WHEN count(*) < 2 THEN NULL WHEN any_value(coalesce(contexts, 0)) >= 2 OR any_value(coalesce(years, 0)) >= 2.0 THEN 90.0 WHEN any_value(coalesce(contexts, 0)) = 1 THEN 65.0 ELSE 30.0 END AS score FROM f LEFT JOIN ctx USING (venture_id) GROUP BY 1),
im AS (SELECT venture_id, 100 * {_mean(('(CASE WHEN school_tier IS NOT NULL THEN least(1.0, school_tier / 0.8) END)', 2.0), ('(CASE WHEN stars_weighted IS NOT NULL THEN least(1.0, least(1.0, stars_weighted / 10) / 0.6) END)', 1.0), ('(CASE WHEN recency_score IS NOT NULL THEN least(1.0, recency_score / 0.5) END)', 1.0))} AS s FROM f),
id AS (SELECT venture_id, round(0.6 * avg(s) + 0.4 * max(s), 1) AS score FROM im WHERE s IS NOT NULL GROUP BY 1)"""


def _scores(t: Tables) -> dict[str, DataFrame]:
    members, bags = _team(t)
    facts = t.orders.select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 60).alias("artifact"), F.col("o_orderdate").cast("date").alias("first"), F.col("o_orderdate").cast("date").alias("last"))
    run = {"members": members, "features": bags, "facts": facts, "targets": {"school_tier": 0.8, "stars_weighted": 0.6, "recency_score": 0.5}, "target_weights": {"school_tier": 2.0}}
    return scoring.run_scorers(("individual_experience", "schools", "prior_collaboration", "ideal_match"), run)


@query(_SCORES + " SELECT venture_id, 'individual_experience' AS category, score FROM ex UNION ALL SELECT venture_id, 'schools', score FROM sc UNION ALL SELECT venture_id, 'prior_collaboration', score FROM pr UNION ALL SELECT venture_id, 'ideal_match', score FROM id")
def x4_scorers(t: Tables) -> DataFrame:
    """Scorers of the registry, long."""
    return _scores(t).select("venture_id", "category", F.col("score").cast("double").alias("score"))


_WEIGHTS = {"individual_experience": 3.0, "schools": 2.0, "prior_collaboration": 1.5, "ideal_match": 1.0, "market": 0.5}
_TOTAL = sum(_WEIGHTS.values())
_STAGE = _SCORES + f""", v AS (SELECT DISTINCT venture_id FROM f UNION SELECT 900),
cov AS (SELECT venture_id, avg(((stars_weighted IS NOT NULL)::INT + (commits_12mo IS NOT NULL)::INT + (zero_to_one_flag IS NOT NULL)::INT) / 3.0) AS c1, avg((school_tier IS NOT NULL)::INT) AS c2, avg(((school_tier IS NOT NULL)::INT + (stars_weighted IS NOT NULL)::INT + (recency_score IS NOT NULL)::INT) / 3.0) AS c3 FROM f GROUP BY 1),
w AS (SELECT v.venture_id, ex.score AS a, sc.score AS b, pr.score AS c, id.score AS d, cov.* EXCLUDE (venture_id) FROM v LEFT JOIN ex USING (venture_id) LEFT JOIN sc USING (venture_id) LEFT JOIN pr USING (venture_id) LEFT JOIN id USING (venture_id) LEFT JOIN cov USING (venture_id)),
z AS (SELECT venture_id, a::DOUBLE AS s_individual_experience, b::DOUBLE AS s_schools, c::DOUBLE AS s_prior_collaboration, d::DOUBLE AS ideal_match, round(coalesce({_mean(('a', 3.0), ('b', 2.0), ('c', 1.5), ('d', 1.0))}, 0), 1)::DOUBLE AS final_score,
 round((CASE WHEN a IS NULL THEN 0 ELSE 3.0 * coalesce(c1, 1) * 0.8 END + CASE WHEN b IS NULL THEN 0 ELSE 2.0 * coalesce(c2, 1) * 0.8 END + CASE WHEN c IS NULL THEN 0 ELSE 1.5 * 0.8 END + CASE WHEN d IS NULL THEN 0 ELSE coalesce(c3, 1) * 0.8 END) / {_TOTAL}, 2)::DOUBLE AS confidence FROM w)"""


@query(_STAGE + " SELECT *, CASE WHEN confidence >= 0.5 THEN 'scored' ELSE 'needs_more_data' END AS quality_tier FROM z")
def z30_stage_a(t: Tables) -> DataFrame:
    """Scores in columns, final score, confidence by coverage and kinds of evidence, tier."""
    members, bags = _team(t)
    extra = t.region.limit(1).select(F.lit(900).cast(members.schema["venture_id"].dataType).alias("venture_id"))
    weights = t.region.limit(1).select(*(F.lit(_WEIGHTS.get(c)).cast("double").alias(f"w_{c}") for c in scoring.CATEGORIES))
    ventures = members.select("venture_id").distinct().unionByName(extra)
    out = scoring.stage_a(ventures, _scores(t), scoring.coverage(members, bags), weights, F.lit("2024-06-01").cast("timestamp"))
    return out.select("venture_id", "s_individual_experience", "s_schools", "s_prior_collaboration", "ideal_match", "final_score", "confidence", "quality_tier")


@query(_F + ", o AS (SELECT venture_id, list({'p': person_id, 'w': coalesce(stars_weighted, 0)} ORDER BY coalesce(stars_weighted, 0) DESC, person_id) AS m FROM f GROUP BY 1) SELECT venture_id, len(m) AS n, m[1].p AS first, (SELECT count(*) FROM f x WHERE x.venture_id = o.venture_id AND x.school_tier IS NOT NULL) AS with_school FROM o")
def z26_bundles(t: Tables) -> DataFrame:
    """A venture with its members, the weightiest first, and their numeric features."""
    members, bags = _team(t)
    weighted = members.join(bags, "person_id").select("venture_id", "person_id", F.col("features")["stars_weighted"].alias("weight"))
    out = views.bundles(weighted, bags)
    return out.select("venture_id", F.size("members").cast("long").alias("n"), F.get("members", F.lit(0))["person_id"].alias("first"), F.size(F.filter("members", lambda m: F.array_contains(F.map_keys(m["features"]), "school_tier"))).cast("long").alias("with_school"))


# Contributions: orders as commits to 997 projects, shares by price.
_CONTRIB = "c AS (SELECT o_orderkey % 997 AS project_id, o_custkey AS person_id, sum(o_orderkey % 13) AS commit_count, sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderkey % 997) AS share FROM orders GROUP BY 1, 2)"


def _contributions(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.orders.groupBy((F.col("o_orderkey") % 997).alias("project_id"), F.col("o_custkey").alias("person_id")).agg(F.sum(F.col("o_orderkey") % 13).alias("commit_count"), F.sum("o_totalprice").alias("x"))
    return rows.withColumn("contribution_share", F.col("x") / F.sum("x").over(Window.partitionBy("project_id"))).drop("x")


_REPO = f"""WITH {_CONTRIB}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(share, 9) DESC, person_id) AS n FROM c WHERE share >= 0.10 OR (share >= 0.05 AND commit_count >= 10)),
re AS (SELECT project_id, person_id, round(share / sum(share) OVER (PARTITION BY project_id), 4) AS weight FROM k WHERE n <= 8)"""


@query(_REPO + " SELECT *, 'maintainer' AS role_hint, false AS is_founder_guess FROM re")
def p09_core_members(t: Tables) -> DataFrame:
    """Core contributors by share, or by share and commits, as members whose weights sum to one."""
    return scoring.repo_members(_contributions(t))


_OFFICERS = "of AS (SELECT s_nationkey AS company_id, s_suppkey AS person_id, CASE s_suppkey % 4 WHEN 0 THEN 'board' WHEN 1 THEN 'founder' WHEN 2 THEN 'director' END AS role_norm FROM supplier WHERE s_suppkey % 5 > 0), om AS (SELECT company_id, person_id, CASE WHEN role_norm = 'board' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN role_norm = 'founder' THEN 'founder' ELSE 'officer' END AS role_hint, coalesce(role_norm = 'founder', false) AS is_founder_guess FROM of)"


def _officers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(F.col("s_nationkey").alias("company_id"), k.alias("person_id"), F.when(k % 4 == 0, "board").when(k % 4 == 1, "founder").when(k % 4 == 2, "director").alias("role_norm"), F.when(k % 5 > 0, "single").alias("signing_authority"))


@query(f"WITH {_OFFICERS} SELECT * FROM om")
def z19_officers(t: Tables) -> DataFrame:
    """Signing officers with half weight for the board and founders marked."""
    return scoring.officer_members(_officers(t))


@query(_REPO + f""", {_OFFICERS}, j AS (SELECT coalesce(re.project_id, om.company_id) AS key, coalesce(re.person_id, om.person_id) AS person_id, coalesce(re.weight, om.weight) AS w, re.weight IS NULL AS added, CASE WHEN om.is_founder_guess THEN om.role_hint WHEN re.weight IS NULL THEN om.role_hint ELSE 'maintainer' END AS role_hint, coalesce(om.is_founder_guess, false) AS is_founder_guess FROM re FULL JOIN om ON re.project_id = om.company_id AND re.person_id = om.person_id),
s AS (SELECT *, CASE WHEN bool_or(added) OVER (PARTITION BY key) THEN round(w / sum(w) OVER (PARTITION BY key), 4) ELSE w END AS weight FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, person_id) AS n FROM s)
SELECT key AS team, person_id, role_hint, is_founder_guess, floor(weight * 1000 + 0.01)::BIGINT AS per_mille FROM n WHERE n <= 8""")
def z20_merged_members(t: Tables) -> DataFrame:
    """Repository and company members as one team."""
    return scoring.merged_members(scoring.repo_members(_contributions(t)).withColumnRenamed("project_id", "team"), scoring.officer_members(_officers(t)).withColumnRenamed("company_id", "team"), "team").withColumn("per_mille", F.floor(F.col("weight") * 1000 + 0.01)).drop("weight")


@query("""
WITH m AS (SELECT DISTINCT c_custkey % 30 AS project_id, 'u' || c_custkey % 12 AS user_id, c_custkey % 12 = c_custkey % 30 % 12 AS author FROM customer), l AS (SELECT 'u' || n_nationkey AS user_id, 'per' || n_nationkey % 9 AS person_id FROM nation WHERE n_nationkey < 11),
j AS (SELECT project_id, person_id, bool_or(author) AS author FROM m JOIN l USING (user_id) GROUP BY ALL)
SELECT project_id, person_id, round(1.0 / count(*) OVER (PARTITION BY project_id), 4)::DOUBLE AS weight, CASE WHEN author THEN 'founder' ELSE 'team' END AS role_hint, author AS is_founder_guess FROM j
""")
def z22_showcase_members(t: Tables) -> DataFrame:
    """Resolved members of showcase projects, once each, with equal weights; the author counts as founder."""
    k = F.col("c_custkey")
    rows = t.customer.select((k % 30).alias("project_id"), F.concat(F.lit("u"), (k % 12).cast("string")).alias("user_id"), (k % 12 == k % 30 % 12).alias("is_author")).distinct()
    links = t.nation.where("n_nationkey < 11").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user_id"), F.concat(F.lit("per"), (F.col("n_nationkey") % 9).cast("string")).alias("person_id"))
    return scoring.showcase_members(rows, links)


_PROJECTS = "pj AS (SELECT n AS project_id, 'repo' || n AS name, 'https://www.site' || n % 6 || '.org/' AS homepage_url, CASE WHEN n % 4 = 0 THEN 'made by FIRM' || (n + 1) % 25 || ' AG' ELSE 'tools' END AS description, n % 5 / 5.0 AS venture_likeness, n % 7 = 0 AS is_corporate_oss FROM (SELECT DISTINCT o_orderkey % 997 AS n FROM orders)), co AS (SELECT s_nationkey AS company_id, 'Firm' || s_nationkey || ' AG' AS name, 'site' || s_nationkey % 11 || '.org' AS website_url, s_nationkey % 2 = 0 AS startup FROM supplier GROUP BY ALL)"


def _projects(t: Tables) -> tuple[DataFrame, DataFrame]:
    n, s = F.col("o_orderkey") % 997, F.col("s_nationkey")
    tag = lambda a, c, b: F.concat(F.lit(a), c.cast("string"), F.lit(b))
    projects = t.orders.select(n.alias("project_id"), tag("repo", n, "").alias("name"), tag("https://www.site", n % 6, ".org/").alias("homepage_url"), F.when(n % 4 == 0, tag("made by FIRM", (n + 1) % 25, " AG")).otherwise("tools").alias("description"), (n % 5 / 5.0).alias("venture_likeness"), (n % 7 == 0).alias("is_corporate_oss")).distinct()
    companies = t.supplier.select(s.alias("company_id"), tag("Firm", s, " AG").alias("name"), tag("site", s % 11, ".org").alias("website_url"), F.lit("sells goods").alias("purpose"), F.when(s % 2 == 0, scoring.STARTUP).otherwise("other").alias("startup_likeness")).distinct()
    return projects, companies


_MATCHED = f"""WITH {_CONTRIB}, {_PROJECTS}, pm AS (SELECT DISTINCT project_id, person_id % 40 AS person_id FROM c), {_OFFICERS}, fm AS (SELECT DISTINCT company_id, person_id % 40 AS person_id FROM of),
sh AS (SELECT project_id, company_id, count(*) AS n FROM pm JOIN fm USING (person_id) GROUP BY ALL),
ma AS (SELECT project_id, min(company_id) AS company_id FROM sh JOIN pj USING (project_id) JOIN co USING (company_id) WHERE n >= 2 OR homepage_url = 'https://www.' || website_url || '/' OR contains(lower(description), lower(regexp_replace(co.name, ' AG$', ''))) GROUP BY 1)"""


def _matched(t: Tables) -> DataFrame:
    projects, companies = _projects(t)
    made = _contributions(t).select("project_id", (F.col("person_id") % 40).alias("person_id"))
    led = _officers(t).where("signing_authority is not null").select("company_id", (F.col("person_id") % 40).alias("person_id"))
    return scoring.matching_companies(made, led, projects, companies)


@query(_MATCHED + " SELECT * FROM ma")
def j22_matching_companies(t: Tables) -> DataFrame:
    """The first company that shares members with a repository or refers to it."""
    return _matched(t)


@query(_MATCHED + f""", a AS (SELECT 'github_repo' AS anchor_type, project_id AS anchor_id, coalesce(co.name, pj.name) AS name FROM pj LEFT JOIN ma USING (project_id) LEFT JOIN co USING (company_id) WHERE venture_likeness >= 0.6 AND NOT is_corporate_oss UNION ALL SELECT 'company', company_id, name FROM co WHERE startup AND company_id NOT IN (SELECT company_id FROM ma)),
v AS (SELECT *, {"{uuid}"} AS venture_id FROM a) SELECT anchor_type, anchor_id, name, venture_id, CASE WHEN anchor_id % 3 = 0 THEN 'contacted' ELSE 'sourced' END AS status FROM v""".replace("{uuid}", "substr(sha1(unhex('" + ids.NAMESPACE.hex + "') || encode(anchor_type || ':' || anchor_id)), 1, 8)"))
def z23_ventures(t: Tables) -> DataFrame:
    """Anchors as ventures with the status that they had."""
    projects, companies = _projects(t)
    found = scoring.anchors(projects, companies, _matched(t))
    known = found.where("anchor_id % 3 = 0").select(ids.uuid5(F.concat_ws(":", "anchor_type", "anchor_id")).alias("venture_id"), F.lit("contacted").alias("status"), F.lit("scored").alias("quality_tier"))
    return scoring.ventures(found, known).select("anchor_type", "anchor_id", "name", F.substring("venture_id", 1, 8).alias("venture_id"), "status")


_PROBES = "p AS (SELECT c_custkey AS venture_id, 'u' || c_custkey % 50 AS uid, CASE WHEN c_custkey % 6 = 0 THEN 'Org' || c_nationkey || ' GmbH' END AS company, CASE c_custkey % 5 WHEN 0 THEN 'we Raised a lot' WHEN 1 THEN 'a seed of doubt' ELSE 'plain' END AS text FROM customer)"


@query(f"""WITH {_PROBES} SELECT venture_id, CASE WHEN uid IN ('u7', 'u9', 'u11') OR coalesce(company IN ('Org3 GmbH', 'Org5 GmbH'), false) THEN 'confirmed_funded' WHEN text = 'plain' THEN 'none_found' WHEN venture_id % 2 = 0 THEN CASE venture_id % 3 WHEN 0 THEN 'none_found' WHEN 1 THEN 'confirmed_funded' ELSE 'suspected' END ELSE 'suspected' END AS funding_signal,
 CASE WHEN text = 'we Raised a lot' THEN 'Raised' WHEN text = 'a seed of doubt' THEN 'seed' END AS snippet FROM p""")
def n14_funding(t: Tables) -> DataFrame:
    """Filings and the list of funded names, else words of funding and a verdict on them."""
    k = F.col("c_custkey")
    probes = t.customer.select(k.alias("venture_id"), F.concat(F.lit("u"), (k % 50).cast("string")).alias("uid"), F.when(k % 6 == 0, F.concat(F.lit("Org"), F.col("c_nationkey").cast("string"), F.lit(" GmbH"))).alias("company_name"), F.when(k % 5 == 0, "we Raised a lot").when(k % 5 == 1, "a seed of doubt").otherwise("plain").alias("text"))
    n = F.col("n_nationkey")
    filings = t.nation.select(F.concat(F.lit("u"), n.cast("string")).alias("uid"), F.when(n == 7, "HR02").otherwise("HR01").alias("sub_rubric"), F.when(n == 9, "Eine Kapitalerhöhung folgt").when(n == 11, "AUGMENTATION DU CAPITAL").otherwise("x").alias("text"))
    funded = t.nation.where("n_nationkey in (3, 5)").select(F.concat(F.lit("org"), n.cast("string")).alias("org_key"))
    verdicts = t.customer.where("c_custkey % 2 = 0").select(k.alias("venture_id"), F.when(k % 3 == 0, "none_found").when(k % 3 == 1, "confirmed_funded").otherwise("no answer").alias("verdict"))
    return scoring.funding_signal(probes, filings, funded, verdicts)


@query("""
WITH v AS (SELECT c_custkey AS venture_id, CASE c_custkey % 3 WHEN 0 THEN 'github_repo' WHEN 1 THEN 'company' ELSE 'showcase' END AS anchor_type, 'k' || c_custkey AS anchor_id, c_custkey % 5 AS team FROM customer),
x AS (SELECT v.*, CASE WHEN anchor_type = 'github_repo' AND p_partkey IS NOT NULL THEN 'site' || venture_id % 20 END AS home, p_name, p_brand FROM v LEFT JOIN part ON 'k' || p_partkey = anchor_id AND anchor_type = 'github_repo'),
y AS (SELECT x.*, s_suppkey AS company FROM x LEFT JOIN supplier ON (anchor_type = 'company' AND 'k' || s_suppkey = anchor_id) OR home = 'site' || s_suppkey)
SELECT venture_id, company AS company_id, CASE WHEN company IS NOT NULL THEN 'CH' END AS country_code, array_to_string(list_filter([p_name, p_brand], lambda t: t IS NOT NULL), '|') AS texts FROM y
""")
def z34_pool_candidates(t: Tables) -> DataFrame:
    """Project by anchor, company by anchor or site, texts to search, country of registered companies."""
    k = F.col("c_custkey")
    tag = lambda c, prefix="k": F.concat(F.lit(prefix), c.cast("string"))
    ventures = t.customer.select(k.alias("venture_id"), F.when(k % 3 == 0, "github_repo").when(k % 3 == 1, "company").otherwise("showcase").alias("anchor_type"), tag(k).alias("anchor_id"), (k % 5).alias("team_size"))
    projects = t.part.select(tag(F.col("p_partkey")).alias("project_id"), F.concat(F.lit("https://site"), (F.col("p_partkey") % 20).cast("string")).alias("homepage_url"), F.array("p_name", "p_brand").alias("texts"))
    companies = t.supplier.select(F.col("s_suppkey").alias("company_id"), tag(F.col("s_suppkey")).alias("anchor_id"), tag(F.col("s_suppkey"), "http://www.site").alias("website_url"))
    out = scoring.pool_candidates(ventures, projects, companies)
    return out.select("venture_id", "company_id", "country_code", F.array_join("texts", "|").alias("texts"))


@query("""
WITH v AS (SELECT c_custkey AS venture_id FROM customer), q AS (SELECT * FROM (VALUES ('a', 'market', 0.9, 1, 'A?'), ('b', 'market', 0.7, 2, 'B?'), ('c', 'traction', 0.9, 3, 'C?'), ('d', 'other', 0.9, 4, 'D?')) x(field, category, importance, position, question_text)),
l AS (SELECT * FROM v, q WHERE NOT (venture_id % 3 = 0 AND field = 'a')), r AS (SELECT *, row_number() OVER (PARTITION BY venture_id ORDER BY CASE category WHEN 'market' THEN 1.0 WHEN 'traction' THEN 2.0 ELSE 0 END * importance DESC, position) AS n FROM l)
SELECT venture_id, string_agg(question_text, ' ' ORDER BY importance DESC, question_text) AS questions FROM r WHERE n <= 3 GROUP BY 1
""")
def z36_question_plan(t: Tables) -> DataFrame:
    """Open questions by weight and importance, the first three, as a plan."""
    catalog = t.region.where("r_regionkey < 4").select(*(F.element_at(F.array(*map(F.lit, v)), F.col("r_regionkey").cast("int") + 1).alias(n) for n, v in (("field", "abcd"), ("category", ("market", "market", "traction", "other")), ("importance", (0.9, 0.7, 0.9, 0.9)), ("position", (1, 2, 3, 4)), ("question_text", ("A?", "B?", "C?", "D?")))))
    ventures = t.customer.select(F.col("c_custkey").alias("venture_id"))
    answered = ventures.where("venture_id % 3 = 0").withColumn("field", F.lit("a"))
    plan = outreach.question_plan(scoring.gaps(ventures, catalog, answered, {"market": 1.0, "traction": 2.0}, 3))
    return plan.select("venture_id", F.array_join("questions", " ").alias("questions"))


# ---- features -----------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT o_custkey AS person_id, o_orderkey % 2000 AS project_id, (o_orderkey % 90)::INT AS commits, (o_orderkey % 10) / 10.0 AS share, o_orderdate - INTERVAL 100 DAY AS first, o_orderdate AS last FROM orders), pj AS (SELECT p_partkey AS project_id, (p_partkey % 8 * 100)::INT AS stars FROM part),
cf AS (SELECT person_id, round(ln(1 + sum(stars * share)), 2) AS stars_weighted, sum(CASE WHEN last >= TIMESTAMP '2000-08-02' THEN commits END)::DOUBLE AS commits_12mo, max(CASE WHEN last >= TIMESTAMP '2000-08-02' THEN least(52.0, round(epoch(last - greatest(first, TIMESTAMP '2000-08-02')) / 604800, 1)) END)::DOUBLE AS active_weeks_12mo, bool_or(stars > 500 AND share >= 0.5) AS hit, max(last) AS last FROM c JOIN pj USING (project_id) GROUP BY 1),
au AS (SELECT l_suppkey AS person_id, sum(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 30 ELSE 0 END)::DOUBLE AS citations_total, max(o_orderdate) AS paper FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
of AS (SELECT s_suppkey AS person_id, s_suppkey % 4 = 1 AS founder, TIMESTAMP '2001-01-01' AS filed FROM supplier),
nb AS (SELECT x.c_custkey AS x, y.c_custkey AS y FROM customer x JOIN customer y ON x.c_custkey + 1 = y.c_custkey AND x.c_custkey % 5 > 0 UNION SELECT y.c_custkey, x.c_custkey FROM customer x JOIN customer y ON x.c_custkey + 1 = y.c_custkey AND x.c_custkey % 5 > 0),
ce AS (SELECT x AS person_id, round(count(*) / ((SELECT count(DISTINCT x) FROM nb) - 1.0), 4) AS centrality FROM (SELECT p.x, q.y FROM nb p JOIN nb q ON p.y = q.x WHERE p.x <> q.y UNION SELECT x, y FROM nb) GROUP BY x),
p AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 9 = 0 THEN 'Founder of it' END AS headline, c_nationkey AS school FROM customer),
j AS (SELECT p.*, cf.* EXCLUDE (person_id), au.* EXCLUDE (person_id), of.* EXCLUDE (person_id), centrality FROM p LEFT JOIN cf USING (person_id) LEFT JOIN au USING (person_id) LEFT JOIN of USING (person_id) LEFT JOIN ce USING (person_id))
SELECT person_id, stars_weighted, commits_12mo, active_weeks_12mo, citations_total, CASE WHEN coalesce(founder, false) OR headline IS NOT NULL OR coalesce(hit, false) THEN 1.0 END::DOUBLE AS zero_to_one_flag, CASE WHEN person_id % 50 = 0 THEN 0.11 WHEN school < 10 THEN school / 10.0 END::DOUBLE AS school_tier,
 CASE WHEN greatest(last, paper, filed) IS NOT NULL THEN round(pow(0.5, greatest(0, date_diff('day', greatest(last, paper, filed)::DATE, DATE '2001-08-02')) / 90.0), 2) END AS recency_score, coalesce(centrality, 0)::DOUBLE AS graph_centrality FROM j""")
def z17_person_features(t: Tables) -> DataFrame:
    """All features of persons from three fact tables, an institution list and overrides."""
    k = F.col("o_orderkey")
    made = t.orders.select(F.col("o_custkey").alias("person_id"), (k % 2000).alias("project_id"), (k % 90).cast("int").alias("commit_count"), (k % 10 / 10.0).alias("contribution_share"), (F.col("o_orderdate").cast("timestamp") - F.expr("INTERVAL 100 DAYS")).alias("first_commit_at"), F.col("o_orderdate").cast("timestamp").alias("last_commit_at"))
    projects = t.part.select(F.col("p_partkey").alias("project_id"), (F.col("p_partkey") % 8 * 100).cast("int").alias("stars"))
    wrote = t.lineitem.select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("publication_id"))
    papers = t.orders.select(k.alias("publication_id"), F.when(k % 3 > 0, k % 30).alias("citation_count"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    led = t.supplier.select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 4 == 1, "founder").otherwise("board").alias("role_norm"), F.lit("2001-01-01").cast("timestamp").alias("registered_at"))
    persons = t.customer.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 9 == 0, "Founder of it").alias("headline"), F.concat(F.lit("Schöol "), F.col("c_nationkey").cast("string")).alias("affiliation"))
    schools = t.nation.where("n_nationkey < 10").select(F.concat(F.lit("school "), F.col("n_nationkey").cast("string")).alias("name"), F.array(F.concat(F.lit("s"), F.col("n_nationkey").cast("string"))).alias("aliases"), (F.col("n_nationkey") * 10.0).alias("score"))
    over = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("person_id"), F.create_map(F.lit("school_tier"), F.lit(0.11)).alias("features"))
    after = t.customer.select(F.col("c_custkey").alias("person_b"))
    edges = t.customer.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("person_a")).join(after, F.expr("person_a + 1 = person_b"))
    out = features.person_features(persons, made, projects, wrote, papers, led, edges, schools, F.lit("2001-08-02").cast("timestamp"), overrides=over)
    return out.select("person_id", *(F.col("features")[c].alias(c) for c in ("stars_weighted", "commits_12mo", "active_weeks_12mo", "citations_total", "zero_to_one_flag", "school_tier", "recency_score", "graph_centrality")))


@query("WITH c AS (SELECT o_custkey AS person_id, o_orderkey AS project_id FROM orders), x AS (SELECT person_id, project_id, 'r' || project_id || '@' || s AS c, i FROM c, (VALUES (1, 'a'), (2, 'b'), (3, 'c')) v(i, s)), n AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY project_id, i) AS n FROM x) SELECT person_id, string_agg(c, ' ' ORDER BY n) AS sample FROM n WHERE n <= 20 GROUP BY 1")
def z18_commit_sample(t: Tables) -> DataFrame:
    """Up to twenty repository@commit strings a person."""
    made = t.orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("project_id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("full_name"), F.array(*map(F.lit, "abc")).alias("sample_commit_shas"))
    return features.commit_sample(made).select("person_id", F.array_join("sample", " ").alias("sample"))


# ---- raw records --------------------------------------------------------------------------------


def _stamp(df: DataFrame) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp")
    return df.withColumn("source_url", F.lit("u")).withColumn("scraped_at", at).withColumn("ingested_at", at)


@query("""
WITH u AS (SELECT c_custkey AS id, 'login' || c_custkey AS login, CASE WHEN c_custkey % 3 > 0 THEN 'Änna Meier-' || c_custkey END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'Me' || c_custkey || '@x.org' END AS mail, CASE c_nationkey % 3 WHEN 0 THEN 'Zürich, Switzerland' WHEN 1 THEN 'Paris' END AS loc, CASE WHEN c_custkey % 5 = 0 THEN 'https://www.Blog' || c_custkey || '.org/' END AS blog FROM customer),
m AS (SELECT o_custkey AS id, string_agg(e, ',' ORDER BY o) AS mails FROM (SELECT o_custkey, 'c' || o_orderkey % 3 || '@y.org' AS e, min((o_orderkey % 7, o_orderkey)) AS o FROM orders GROUP BY ALL) GROUP BY 1)
SELECT 'github' AS source, id::VARCHAR AS source_key, coalesce(name, login) AS full_name, concat_ws(',', mail, mails) AS emails, CASE WHEN name IS NULL THEN login ELSE 'anna meier-' || id END AS name_norm, CASE WHEN loc LIKE 'Z%' THEN 'CH' END AS country_code, CASE WHEN blog IS NOT NULL THEN 'blog' || id || '.org' END AS website_url_norm, CASE WHEN mail IS NOT NULL THEN 'x.org' WHEN mails IS NOT NULL THEN 'y.org' END AS email_domain FROM u LEFT JOIN m USING (id)
""")
def g01_github_records(t: Tables) -> DataFrame:
    """Users with profile and commit addresses, and their comparable fields."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tag = lambda a, c, b="": F.concat(F.lit(a), c.cast("string"), F.lit(b))
    profile = F.struct(F.when(k % 3 > 0, tag("Änna Meier-", k)).alias("name"), F.when(k % 4 == 0, tag("Me", k, "@x.org")).alias("email"), F.when(n % 3 == 0, "Zürich, Switzerland").when(n % 3 == 1, "Paris").alias("location"), F.when(k % 5 == 0, tag("https://www.Blog", k, ".org/")).otherwise("").alias("blog"))
    users = _stamp(t.customer.select(k.alias("user_id"), tag("login", k).alias("login"), F.parse_json(F.to_json(profile)).alias("payload")))
    o = F.col("o_orderkey")
    commits = t.orders.select((o % 7).alias("repo_id"), F.lpad(o.cast("string"), 12, "0").alias("sha"), F.col("o_custkey").alias("author_user_id"), F.parse_json(F.to_json(F.struct(F.struct(tag("c", o % 3, "@y.org").alias("email")).alias("author")))).alias("payload"))
    repos = t.region.select(F.col("r_regionkey").cast("long").alias("repo_id"), F.parse_json(F.lit('{"topics": ["Robots"]}')).alias("payload"))
    out = records.derive(records.github(users, commits, repos))
    return out.select("source", "source_key", "full_name", F.array_join("emails", ",").alias("emails"), "name_norm", "country_code", "website_url_norm", "email_domain")


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier)
SELECT 'zefix_officer' AS source, 'u' || id || ':' || 'rossi anna' AS source_key, 'Anna Rossi' AS full_name, 'Firm ' || id AS affiliation_raw, 'Bern' AS location_raw, 'CH' AS country_code FROM s WHERE id % 3 > 0 UNION ALL SELECT 'zefix_officer', 'u' || id || ':' || 'kern urs', 'Urs Kern', 'Firm ' || id, 'Zug', 'CH' FROM s WHERE id % 3 = 1
""")
def g01_officer_records(t: Tables) -> DataFrame:
    """Persons named in notices after the marker, by five groups of a pattern."""
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, "Nichts. Rossi, Anna, in Bern, Mitglied, mit Unterschrift.").when(k % 3 == 1, "Eingetragene Personen: Rossi, Anna, in Bern, Mitglied, mit Unterschrift; Kern, Urs, in Zug, Direktor, mit Prokura.").otherwise("x Eingetragene Personen: Rossi, Anna, in Bern, Mitglied, mit Unterschrift.")
    notices = _stamp(t.supplier.select(k.alias("sogc_id"), F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.parse_json(F.to_json(F.struct(said.alias("publicationText")))).alias("payload")))
    firms = t.supplier.select(F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.concat(F.lit("Firm "), k.cast("string")).alias("name"))
    return records.register_officers(notices, firms).select("source", "source_key", "full_name", "affiliation_raw", "location_raw", "country_code")


@query("""
WITH p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0), j AS (SELECT c_custkey AS pid, 'Au' || c_custkey AS name, c_custkey AS k FROM customer WHERE c_custkey % 6 = 0), k AS (SELECT id AS k FROM p UNION SELECT k FROM j)
SELECT k::VARCHAR AS source_key, CASE WHEN k % 4 = 0 THEN 'P' || k ELSE 'Au' || k END AS full_name, concat_ws(',', CASE WHEN k % 4 = 0 THEN 'p' || k || '@x.org' END, CASE WHEN k % 6 = 0 THEN 'a' || k || '@y.org' END) AS emails, concat_ws(',', CASE WHEN k % 4 = 0 THEN 'ml,cv' END, CASE WHEN k % 6 = 0 THEN CASE WHEN k % 4 = 0 THEN 'go' ELSE 'ml,go' END END, CASE WHEN k % 4 = 0 THEN 'eth' END) AS keywords FROM k
""")
def z09_showcase_records(t: Tables) -> DataFrame:
    """People, members of projects and CVs as one record a user, first known values in that order."""
    k = F.col("c_custkey")
    tag = lambda a, c, b="": F.concat(F.lit(a), c.cast("string"), F.lit(b))
    people = _stamp(t.customer.where("c_custkey % 4 = 0").select(k.alias("user_id"), F.parse_json(F.to_json(F.struct(tag("P", k).alias("name"), tag("p", k, "@x.org").alias("email"), F.array(F.lit("ml"), F.lit("cv")).alias("skills")))).alias("payload")))
    author = F.struct(k.cast("string").alias("userId"), tag("Au", k).alias("name"), tag("a", k, "@y.org").alias("email"), F.array(F.lit("ml"), F.lit("go")).alias("skills"))
    projects = _stamp(t.customer.where("c_custkey % 6 = 0").select(k.alias("project_id"), F.parse_json(F.to_json(F.struct(author.alias("authorProfile"), F.array(F.struct(F.lit("no id").alias("name"))).alias("team")))).alias("payload")))
    cvs = _stamp(t.customer.where("c_custkey % 4 = 0").select(k.alias("user_id"), F.parse_json(F.lit('{"extracted": {"education": [{"institution": "ETH"}, {"institution": null}]}}')).alias("payload")))
    out = records.showcase(people, projects, cvs)
    return out.select("source_key", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("keywords", ",").alias("keywords"))


@query("""SELECT 'https://ror.org/' || n_nationkey AS id, 'School ' || n_nationkey AS name, 'S' || n_nationkey || ',Schule ' || n_nationkey AS aliases, CASE WHEN n_regionkey = 1 THEN 'CH' ELSE 'DE' END AS country FROM nation WHERE n_nationkey % 3 > 0""")
def z45_schools(t: Tables) -> DataFrame:
    """Institutions of education of a registry dump, names and aliases apart."""
    n = F.col("n_nationkey")
    tag = lambda a: F.concat(F.lit(a), n.cast("string"))
    names = F.array(F.struct(tag("School ").alias("value"), F.array(F.lit("ror_display"), F.lit("label")).alias("types")), F.struct(tag("Schule ").alias("value"), F.array(F.lit("label")).alias("types")), F.struct(tag("S").alias("value"), F.array(F.lit("acronym")).alias("types")), F.struct(tag("S").alias("value"), F.array(F.lit("alias")).alias("types")))
    place = F.array(F.struct(F.struct(F.when(F.col("n_regionkey") == 1, "CH").otherwise("DE").alias("country_code")).alias("geonames_details")))
    dump = t.nation.select(F.parse_json(F.to_json(F.struct(tag("https://ror.org/").alias("id"), F.array(F.when(n % 3 > 0, "education").otherwise("company")).alias("types"), names.alias("names"), place.alias("locations")))).alias("payload"))
    return records.registered_schools(dump).select("id", "name", F.array_join("aliases", ",").alias("aliases"), "country")


@query("SELECT user_id, cv_url, min(project) AS first FROM (SELECT c_custkey AS project, 'u' || c_custkey % 20 AS user_id, 'cv' || c_custkey % 4 AS cv_url FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 'u' || c_custkey % 7, 'cvx' FROM customer) GROUP BY ALL")
def z10_cv_targets(t: Tables) -> DataFrame:
    """Users and CVs to fetch, each pair once, by first sight."""
    k = F.col("c_custkey")
    tag = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    author = F.struct(tag("u", k % 20).alias("userId"), F.when(k % 5 > 0, tag("cv", k % 4)).alias("cvUrl"))
    projects = t.customer.select(k.alias("project_id"), F.parse_json(F.to_json(F.struct(author.alias("authorProfile"), F.array(F.struct(tag("u", k % 7).alias("userId"), F.lit("cvx").alias("cvUrl"))).alias("team")))).alias("payload"))
    return records.cv_targets(projects).select("user_id", "cv_url", F.col("seen.project_id").alias("first"))


@query("SELECT DISTINCT 'own' || p_partkey % 15 || '/repo' || p_partkey % 4 AS full_name FROM part WHERE p_partkey % 3 > 0")
def z01_repositories(t: Tables) -> DataFrame:
    """Distinct owner/name out of a path of payloads."""
    k = F.col("p_partkey")
    url = F.when(k % 3 > 0, F.concat(F.lit("https://GitHub.com/own"), (k % 15).cast("string"), F.lit("/repo"), (k % 4).cast("string"), F.lit(".git"))).otherwise("https://else.org/x/y")
    return records.repositories_of(t.part.select(F.parse_json(F.to_json(F.struct(url.alias("repo")))).alias("payload")), "payload", "$.repo")


@query("SELECT c_custkey, sha256('{\"a\":' || c_custkey || ',\"b\":\"' || c_mktsegment || '\"}') AS content_hash FROM customer WHERE c_custkey % 4 > 0")
def z07_raw_rows(t: Tables) -> DataFrame:
    """Payloads as they land, with the hash of their canonical form; broken ones go."""
    body = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit('{ "b": "'), F.col("c_mktsegment"), F.lit('", "a": '), F.col("c_custkey").cast("string"), F.lit("}"))).otherwise("{broken")
    return records.raw_rows(t.customer.select("c_custkey", body.alias("p")), "c_custkey", "p", F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")).select("c_custkey", "content_hash")


@query("SELECT 'u' || o_custkey % 300 AS login, string_agg(DISTINCT 'm' || o_orderkey % 9 || '@x.org ' || o_orderkey, ',' ORDER BY 'm' || o_orderkey % 9 || '@x.org ' || o_orderkey) AS commits FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1")
def z05_commit_authors(t: Tables) -> DataFrame:
    """Addresses of commits by user, aliases left out, sorted."""
    o = F.col("o_orderkey")
    node = F.struct(o.cast("string").alias("oid"), F.struct(F.when(o % 4 == 0, "x@users.noreply.github.com").otherwise(F.concat(F.lit("M"), (o % 9).cast("string"), F.lit("@x.org"))).alias("email"), F.struct(F.concat(F.lit("u"), (F.col("o_custkey") % 300).cast("string")).alias("login")).alias("user")).alias("author"))
    repos = t.orders.groupBy((o % 40).alias("repo_id")).agg(F.collect_list(node).alias("nodes")).select("repo_id", F.parse_json(F.to_json(F.struct(F.struct("nodes").alias("history")))).alias("payload"))
    return records.commit_authors(repos).select("login", F.array_join(F.transform("commits", lambda c: F.concat_ws(" ", c["email"], c["sha"])), ",").alias("commits"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN 2 + s_suppkey % 4 END AS team_size, CASE WHEN s_suppkey % 5 > 0 THEN 'Name ' || s_suppkey END AS title, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-03-01 10:00:00' END AS submitted_at FROM supplier""")
def z12_clean_projects(t: Tables) -> DataFrame:
    """Team sizes with the author counted, junk as null, times without zone as UTC."""
    k = F.col("s_suppkey")
    team = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(i.cast("string").alias("userId"))))
    body = F.struct(F.when(k % 5 > 0, F.concat(F.lit("Name "), k.cast("string"))).otherwise(F.when(k % 2 == 0, " n/a ").otherwise("-")).alias("title"), F.when(k % 2 == 0, "2024-03-01T10:00:00").otherwise("soon").alias("submittedAt"), team.alias("team"))
    out = records.clean_projects(t.supplier.select(k.alias("id"), F.parse_json(F.to_json(body)).alias("payload")), "id")
    return out.select("id", F.col("team_size").cast("int").alias("team_size"), "title", F.col("submitted_at").cast("timestamp_ntz").alias("submitted_at"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def z08_contribution_lists(t: Tables) -> DataFrame:
    """Persons with their contributions, an empty list where there is none."""
    made = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return records.with_contributions(t.customer.select("c_custkey"), made, "c_custkey", "o_orderkey").select("c_custkey", F.size("contributions").cast("long").alias("n"))


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 > 0 THEN sha256('cv text ' || c_custkey) END AS text_hash, CASE WHEN c_custkey % 3 > 0 THEN length('cv text ' || c_custkey) END::INT AS n_chars, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'not json' END AS raw_answer FROM customer")
def z11_cv_rows(t: Tables) -> DataFrame:
    """CVs with hash and length of their text; the raw answer stays only where it does not parse."""
    k = F.col("c_custkey")
    cvs = t.customer.select(k.alias("user_id"), F.when(k % 3 > 0, F.concat(F.lit("cv text "), k.cast("string"))).alias("text"), F.when(k % 3 == 1, '```json\n{"a": 1}\n```').when(k % 3 == 2, "not json").alias("answer"))
    return records.cv_rows(cvs).select("user_id", "text_hash", "n_chars", "raw_answer")


@query("WITH n AS (SELECT 'node' || o_orderkey % 500 AS node_id, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS o FROM orders) SELECT node_id, first(k ORDER BY o, k) AS k FROM n GROUP BY 1")
def z06_discovered(t: Tables) -> DataFrame:
    """Pages of several searches as one, the first sight of each node."""
    rows = t.orders.select(F.concat(F.lit("node"), (F.col("o_orderkey") % 500).cast("string")).alias("node_id"), F.col("o_orderkey").alias("k"))
    return records.discovered([rows.where("k % 2 = 0"), rows.where("k % 2 = 1")], "node_id", "k").select("node_id", "k")


# ---- functions ----------------------------------------------------------------------------------


@query("""SELECT p_partkey, 'linkedin.com/in/u' || p_partkey AS profile, CASE WHEN p_partkey % 2 = 0 THEN 'Firm ' || p_partkey ELSE 'AG' END AS firm, '21' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.00001' AS paper, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END AS version, CASE WHEN p_partkey % 2 = 0 THEN '2101.7' WHEN p_partkey % 3 = 0 THEN '2102.8' END AS work, CASE WHEN p_partkey % 2 = 0 THEN '10.48550/arxiv.2101.7' ELSE '10.48550/arxiv.9' END AS doi, 'X-' || p_partkey AS orcid, CASE WHEN p_partkey % 4 = 0 THEN 'a.b@c-d.org' END AS mail, 'tag' || p_partkey % 3 AS tag FROM part""")
def f06_identifiers(t: Tables) -> DataFrame:
    """Identifiers out of text: profiles, firms, preprints, DOIs, ORCIDs, addresses, tags."""
    k = F.col("p_partkey")
    tag = lambda a, c=k, b="": F.concat(F.lit(a), c.cast("string"), F.lit(b))
    paper = text.paper_id(F.concat(F.when(k % 2 == 0, "http://arxiv.org/abs/").otherwise(""), F.lit("21"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".00001"), F.when(k % 3 == 0, "v3").otherwise("")))
    doi = F.when(k % 2 == 0, "https://doi.org/10.48550/arXiv.2101.7")
    work = text.paper_id_of_work(doi, F.array(F.lit("http://else.org"), F.when(k % 3 == 0, "https://ARXIV.org/abs/2102.8v2").otherwise("https://x.org")))
    return t.part.select(
        "p_partkey", text.profile_url_key(tag("https://www.LinkedIn.com/in/U", k, "/?x=1")).alias("profile"), text.strip_legal_form(F.when(k % 2 == 0, tag("Firm ", k, " AG")).otherwise("AG")).alias("firm"), paper["id"].alias("paper"), paper["version"].alias("version"),
        work.alias("work"), text.lookup_doi(F.when(k % 2 == 0, "10.48550/ARXIV.2101.7"), F.lit("9")).alias("doi"), text.bare_orcid(tag("https://orcid.org/X-")).alias("orcid"), text.first_email(F.when(k % 4 == 0, "write to a.b@c-d.org, please").otherwise("no one @ all")).alias("mail"), text.first_line(F.concat(F.lit("tag"), (k % 3).cast("string"), F.lit("\nrest"))).alias("tag"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'CH' WHEN 1 THEN 'DE' END AS country, CASE s_suppkey % 3 WHEN 0 THEN 'Bern' WHEN 1 THEN 'Bern, Schweiz' ELSE 'Oslo' END AS city, CASE s_suppkey % 3 WHEN 0 THEN 'CH' WHEN 2 THEN 'NO' END AS code, CASE WHEN s_suppkey % 2 = 0 THEN '{"a":1}' END AS parsed, CASE WHEN s_suppkey % 2 = 1 THEN 'plain words' END AS raw, CASE WHEN s_suppkey % 4 = 0 THEN 'org_verified,org_domain_matches_homepage' ELSE 'funding_links' END AS signals, 1.0::DOUBLE AS same FROM supplier""")
def f21_places_answers(t: Tables) -> DataFrame:
    """Countries of places, codes apart from cities, fenced answers, signals of owners, fuzzy parts."""
    k = F.col("s_suppkey")
    where = text.place(F.when(k % 3 == 2, "Oslo").otherwise("Bern"), F.when(k % 3 == 0, "ch").when(k % 3 == 1, "Schweiz").otherwise("no"))
    answer = text.unfence(F.when(k % 2 == 0, '```json\n{"a": 1}\n```').otherwise("plain words"))
    four = k % 4 == 0
    signals = text.owner_signals(four, F.when(~four, F.array(F.lit("x"))), F.lit("https://www.acme.org/x"), F.when(four, "http://acme.org").otherwise("http://b.org"))
    return t.supplier.select("s_suppkey", text.country_in(F.when(k % 3 == 0, "near Bern, Switzerland").when(k % 3 == 1, "Berlin").otherwise("Oslo"), records.PLACES).alias("country"), where["city"].alias("city"), where["country"].alias("code"), F.to_json(answer["parsed"]).alias("parsed"), answer["raw"].alias("raw"), F.array_join(signals, ",").alias("signals"), text.partial_ratio(F.lit("robot arm"), F.lit("the robot arm of it")).alias("same"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'score: type' WHEN 1 THEN '' WHEN 2 THEN '$: name is missing' ELSE 'not json' END AS kind FROM part""")
def m03_payload_errors(t: Tables) -> DataFrame:
    """Errors of payloads against a schema with references (M3, M4)."""
    k = F.col("p_partkey") % 4
    schema = {"type": "object", "required": ["name"], "properties": {"name": {"$ref": "#/$defs/text"}, "score": {"type": "number"}}, "$defs": {"text": {"type": "string"}}}
    body = F.when(k == 0, '{"name": "a", "score": "high"}').when(k == 1, '{"name": "a", "score": 2}').when(k == 2, '{"score": 1}').otherwise("{broken")
    found = F.array_join(documents.payload_errors(body, schema), ";")
    return t.part.select("p_partkey", F.when(found.contains("not JSON"), "not json").when(found.contains("score"), "score: type").otherwise(found).alias("kind"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'bare' ELSE '' END AS uncited, CASE WHEN s_suppkey % 2 = 0 THEN 7.5 END::DOUBLE AS score, CASE WHEN s_suppkey % 2 = 0 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, 1 AS evidence FROM supplier""")
def m05_memos_verdicts(t: Tables) -> DataFrame:
    """Memo bullets without source or gap; verdicts with evidence that names claim and source."""
    k = F.col("s_suppkey")
    third = F.when(k % 3 == 0, '{"text": "bare"}').otherwise('{"text": "open", "gap": "revenue"}')
    memo = F.parse_json(F.concat(F.lit('{"sections": [{"title": "t", "bullets": [{"text": "ok", "citations": ["u"]}, '), third, F.lit("]}]}")))
    answer = F.when(k % 2 == 0, '{"score": 7.5, "evidence": [{"claim": "c", "source_url": "u"}, {"claim": "d"}]}').otherwise('{"evidence": [{"claim": "c", "source_url": "u"}, {"source_url": "v"}]}')
    v = documents.verdict(answer)
    return t.supplier.select("s_suppkey", F.array_join(documents.uncited(memo), ",").alias("uncited"), v["score"].alias("score"), v["confidence"].alias("confidence"), F.size(v["evidence"]).alias("evidence"))


@query("SELECT c_custkey, 1.0::DOUBLE AS norm, 64 AS size, true AS same FROM customer")
def n09_embeddings(t: Tables) -> DataFrame:
    """Vectors of profile texts by a pluggable function: unit length, equal texts alike, ordered by record."""
    from tessera.functions import models

    texts = t.customer.select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("profile"))
    rows = models.profile_embeddings(texts, "c_custkey", "profile", models.hashed(64))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    again = models.hashed(64)(F.col("profile"))
    # By sorting: vectors are estimated as one number each, and would go through the driver.
    return rows.join(texts.hint("merge"), "c_custkey").select("c_custkey", F.round(norm, 4).alias("norm"), F.size("embedding").alias("size"), (F.col("embedding") == again).alias("same"))


# ---- views and edits ----------------------------------------------------------------------------


@query("SELECT c_custkey AS venture_id, CASE WHEN c_custkey % 3 = 0 THEN o END AS memo_id, CASE WHEN c_custkey % 3 = 0 THEN n ELSE 0 END AS scores FROM (SELECT c_custkey, max(o_orderkey) AS o, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def z39_latest_memo(t: Tables) -> DataFrame:
    """The latest memo of a venture and the length of its score history."""
    history = t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("venture_id"), F.col("o_orderkey").alias("memo_id"), F.col("o_orderkey").cast("string").alias("created_at"))
    ventures = t.customer.select(F.col("c_custkey").alias("venture_id"))
    newest = views.latest_memo(history.withColumn("created_at", F.lpad("created_at", 12, "0")))
    lengths = views.score_history(history, "venture_id", "created_at").groupBy("venture_id").agg(F.count("*").alias("scores"))
    return ventures.join(newest.select("venture_id", "memo_id"), "venture_id", "left").join(lengths, "venture_id", "left").select("venture_id", "memo_id", F.coalesce("scores", F.lit(0)).alias("scores"))


@query("SELECT n_nationkey AS profile_id, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN 5 ELSE 4 END AS version FROM nation")
def z38_revised(t: Tables) -> DataFrame:
    """One row replaced, its version counted up."""
    table = t.nation.select(F.col("n_nationkey").alias("profile_id"), F.col("n_name").alias("name"), F.lit(4).alias("version"))
    row = table.where("profile_id = 3").withColumn("name", F.lit("new"))
    return outreach.revised(table, row, "profile_id", "version")


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey AS person_id FROM orders), f AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 0.4 END AS tier FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT person_id, max(id % 4 * 0.25) AS t FROM i WHERE id % 4 < 3 GROUP BY 1)
SELECT coalesce(f.person_id, n.person_id) AS person_id, CASE WHEN t IS NULL THEN tier ELSE greatest(coalesce(tier, 0), t) END::DOUBLE AS school_tier FROM f FULL JOIN n USING (person_id)""")
def z31_interview_tiers(t: Tables) -> DataFrame:
    """School tiers that interviews raise."""
    talks = t.orders.select(F.col("o_custkey").alias("person_id"), F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Inst "), (F.col("o_orderkey") % 4).cast("string")).alias("institution"))).alias("education"))).alias("extracted"))
    bags = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("person_id"), F.map_filter(F.create_map(F.lit("school_tier"), F.when(F.col("c_custkey") % 2 == 0, F.lit(0.4))), lambda _, v: v.isNotNull()).alias("features"))
    schools = t.region.where("r_regionkey < 3").select(F.concat(F.lit("inst "), F.col("r_regionkey").cast("string")).alias("name"), F.array().cast("array<string>").alias("aliases"), (F.col("r_regionkey") * 25.0).alias("score"))
    out = outreach.raised_school_tiers(bags, talks, schools)
    return out.select("person_id", F.col("features")["school_tier"].alias("school_tier"))


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey AS venture_id FROM orders), r AS (SELECT id FROM x WHERE id % 3 = 0) SELECT id AS interview_id, venture_id FROM x WHERE id NOT IN (SELECT id FROM r)""")
def z31_new_interviews(t: Tables) -> DataFrame:
    """Interviews that no finished run has seen."""
    ensure_checkpoint_folder(t.orders)
    talks = t.orders.select(F.col("o_orderkey").alias("interview_id"), F.col("o_custkey").alias("venture_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("b"), F.col("o_orderkey").alias("a"))).alias("extracted"))
    seen = talks.where("interview_id % 3 = 0").select(F.sha2(F.concat_ws(":", "venture_id", "interview_id", ids.content_hash(F.col("extracted"))), 256).alias("fingerprint"), F.lit("ok").alias("status"))
    return outreach.new_interviews(talks, seen).select("interview_id", "venture_id")


@query("""WITH i AS (SELECT c_custkey AS interview_id, sha256('tok' || c_custkey) AS token_hash, CASE WHEN c_custkey % 4 = 0 THEN 'done' ELSE 'open' END AS status, c_custkey % 3 > 0 AS consent, c_custkey % 5 > 0 AS fresh FROM customer) SELECT interview_id, CASE WHEN NOT fresh THEN 'expired' WHEN status <> 'open' THEN 'closed' WHEN NOT consent THEN 'needs_consent' ELSE 'ready' END AS gate FROM i WHERE interview_id % 2 = 0""")
def z37_interview_gate(t: Tables) -> DataFrame:
    """Interviews found by the hash of a token, and what they may do."""
    k = F.col("c_custkey")
    held = t.customer.select(k.alias("interview_id"), F.sha2(F.concat(F.lit("tok"), k.cast("string")), 256).alias("token_hash"), F.when(k % 4 == 0, "done").otherwise("open").alias("status"), F.when(k % 3 > 0, F.lit("2024-01-01").cast("timestamp")).alias("consent_at"), F.when(k % 5 > 0, F.lit("2025-01-01")).otherwise("2023-01-01").cast("timestamp").alias("expires_at"))
    tokens = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("tok"), k.cast("string")).alias("token"))
    return outreach.interview_gate(tokens, held, F.lit("2024-06-01").cast("timestamp")).select("interview_id", "gate")


@query("SELECT event_type AS stage, 'searches=' || (count(*) % 7) AS tag, count(*) AS calls, sum(user_id)::BIGINT AS tokens FROM events GROUP BY event_type")
def z46_metering(t: Tables) -> DataFrame:
    """Calls and tokens by stage and tag."""
    from tessera.functions import models

    n = t.events.groupBy("event_type").agg((F.count("*") % 7).alias("n"))
    calls = t.events.join(n, "event_type").select(F.col("event_type").alias("stage"), F.concat(F.lit("searches="), F.col("n").cast("string"), F.lit("\nrest of the prompt")).alias("prompt"), F.col("user_id").cast("long").alias("tokens"))
    return models.metered(calls, "stage", "prompt", "tokens")
