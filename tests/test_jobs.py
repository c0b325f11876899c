import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.plans import features, resolution, scoring

RECORDS = "record_id string, source string, source_key string, full_name string, name_norm string, first_name string, last_name string, email_norms array<string>, email_domain string, orcid string, github_login string, website_url_norm string, linkedin_url string, twitter_handle string, org_norm string, country_code string, keywords array<string>, affiliation_raw string, location_raw string, last_seen_at timestamp"


def record(i, source, name, **more):
    first, last = name.lower().split()[0], name.lower().split()[-1]
    base = dict(record_id=i, source=source, source_key=i, full_name=name, name_norm=name.lower(), first_name=first, last_name=last, last_seen_at=dt.datetime(2024, 1, 1))
    fields = [f.split()[0] for f in RECORDS.split(", ")]
    return tuple((base | more).get(f) for f in fields)


@pytest.fixture(scope="module")
def people(spark):
    """One person in four sources, two of one name who are apart, a same-source pair, a loner."""
    return spark.createDataFrame(
        [
            record("a1", "github", "Mara Vogt", email_norms=["mara@vogt.ch"], email_domain="vogt.ch", github_login="maravogt", keywords=["robots", "slam", "grasp"], country_code="CH"),
            record("a2", "openalex_author", "Mara Lena Vogt", email_norms=["m@uni.ch", "mara@vogt.ch"], orcid="0001", org_norm="uni", affiliation_raw="Uni"),
            record("a3", "zefix_officer", "M. Vogt", orcid="0001", country_code="CH", affiliation_raw="Vogt AG", last_seen_at=dt.datetime(2024, 5, 1)),
            record("a4", "showcase", "Mara Vogt", website_url_norm="github.com/maravogt"),
            record("b1", "github", "Jan Frei", org_norm="x", github_login="jf"), record("b2", "arxiv_author", "Jan Frei", org_norm="y"),
            record("c1", "github", "Eva One", linkedin_url="https://www.LinkedIn.com/in/eva/"), record("c2", "github", "Eva Two", linkedin_url="linkedin.com/in/eva"), record("d1", "arxiv_author", "Lone Wolf"),
            record("e1", "github", "Tim Roth", org_norm="z"), record("e2", "openalex_author", "Tim Roth", org_norm="z"),
        ],
        RECORDS,
    )


def test_rules(people):
    got = {(r["left"], r["right"], r["rule"]) for r in identity.identifier_rules(people).collect()}
    assert got == {("a1", "a2", "D2"), ("a2", "a3", "D1"), ("a1", "a4", "D4"), ("c1", "c2", "D7")}
    assert [(r["left"], r["right"]) for r in identity.name_org_pairs(people).collect()] == [("e1", "e2")]


def test_crosslinks_and_candidates(spark, people):
    pairs = spark.createDataFrame([("a1", "a4", "repo x paper"), ("b1", "d1", "repo y paper")], "left string, right string, evidence string")
    assert [(r["left"], r["right"]) for r in identity.crosslink_matches(pairs, people).collect()] == [("a1", "a4")]
    projects = spark.createDataFrame([("p1", ["2101.1"], "github.com/a/x", "x.ch"), ("p2", [], "github.com/a/y", None)], "project_id string, arxiv_ids_in_readme array<string>, repo_url_norm string, homepage_norm string")
    papers = spark.createDataFrame([("w1", "2101.1", []), ("w2", "2102.2", ["github.com/a/y"]), ("w3", "2103.3", [])], "publication_id string, arxiv_id string, code_url_norms array<string>")
    archive = spark.createDataFrame([("github.com/a/x", "2101.1", 1), ("github.com/a/y", "2102.2", 2), ("github.com/a/y", "2103.3", 3)], "repo_url_norm string, arxiv_id string, position int")
    firms = spark.createDataFrame([("c1", "x.ch")], "company_id string, website_norm string")
    linked, owned = identity.crosslinks(projects, papers, archive, firms)
    assert {tuple(r) for r in linked.collect()} == {("p1", "w1", "readme 2101.1"), ("p2", "w2", "code github.com/a/y"), ("p2", "w3", "archive github.com/a/y")}
    assert [tuple(r) for r in owned.collect()] == [("p1", "c1", "homepage x.ch")]
    pitched = spark.createDataFrame([("t1", "github.com/a/x")], "pitch_id string, repo_url_norm string")
    shares = spark.createDataFrame([("p1", "a1", 0.8), ("p1", "b1", 0.2)], "project_id string, record_id string, contribution_share double")
    team = spark.createDataFrame([("t1", "a4"), ("t1", "d1")], "pitch_id string, record_id string")
    assert [(r["left"], r["right"], r["rule"]) for r in identity.team_matches(pitched, projects, shares, team, people).collect()] == [("a1", "a4", "D8")]


def test_linkage(people):
    got = {(r["left"], r["right"]): r for r in identity.linkage(people).collect()}
    assert got["e1", "e2"]["g_name"] == 4 and got["e1", "e2"]["g_org"] == 1 and got["e1", "e2"]["g_email"] is None
    assert got["b1", "b2"]["g_org"] == 0 and got["b1", "b2"]["probability"] < got["e1", "e2"]["probability"]
    assert got["a1", "a2"]["band"] in ("auto", "adjudicate", "review", "drop")
    m = identity.expectation_maximisation(identity.linkage(people), {"g_name": (identity.NAME_M, identity.NAME_U), "g_country": (identity.COUNTRY_M, identity.COUNTRY_U)}, rounds=3)
    assert all(abs(sum(v) - 1) < 1e-9 for v in m.values())
    assert 0 <= identity.estimate_u(people, "last_name").first()["u"] <= 1


def test_resolution(spark, people):
    active = spark.createDataFrame([("a2", "person-mara"), ("b1", "person-jan")], "record_id string, person_id string")
    none = spark.createDataFrame([], "left string, right string, evidence string")
    out = resolution.resolve(people, active, none)
    links = {r["record_id"]: r for r in out.links.collect()}
    assert {links[i]["person_id"] for i in ("a1", "a3", "a4")} == {"person-mara"} and "a2" not in links
    assert links["a1"]["match_method"] == "det_email" and links["a3"]["match_method"] == "det_orcid"
    assert links["c1"]["person_id"] != links["c2"]["person_id"] and links["c2"]["match_method"] == "singleton"  # one source, one record
    every = active.withColumn("status", F.lit("active")).unionByName(out.links.select("record_id", "person_id", "status"))
    assert identity.broken_links(people, every).count() == 0
    reviews = {(r["record_id"], r["method"]) for r in out.reviews.collect()}
    if links["e1"]["person_id"] != links["e2"]["person_id"]:
        assert any(i in ("e1", "e2") for i, _ in reviews)
    mara = out.persons.where("person_id = 'person-mara'").first()
    assert mara["full_name"] == "Mara Lena Vogt" and mara["affiliation"] == "Vogt AG" and mara["emails"] == ["mara@vogt.ch", "m@uni.ch"] and mara["primary_email"] == "mara@vogt.ch"
    assert mara["data_quality_score"] == 0.9 and mara["independent_sources"] == 4 and mara["country_code"] == "CH"
    again = resolution.resolve(people, every.select("record_id", "person_id"), none)
    assert again.links.count() == 0
    fixed, affected = identity.unmerge(every.withColumn("match_method", F.lit("x")).withColumn("link_id", F.lit("y")), "a3", F.lit("person-new"))
    assert {r["person_id"] for r in affected.collect()} == {"person-mara", "person-new"} and identity.broken_links(people, fixed).count() == 0
    verdicts = spark.createDataFrame([("e1", "e2", "match")], "left string, right string, verdict string")
    assert {r["verdict"] for r in identity.adjudicate(spark.createDataFrame([("e1", "e2"), ("x", "y")], "left string, right string"), verdicts).collect()} == {"match", "open"}
    q = identity.quality_of_links(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), spark.createDataFrame([(1, 2)], "a long, b long")).first()
    assert (q["precision"], q["false_merge"]) == (0.5, 0.5)


def test_connections(spark):
    day = dt.date
    facts = spark.createDataFrame([("x", "p", day(2024, 1, 1), day(2024, 6, 1)), ("x", "q", day(2024, 2, 1), day(2024, 3, 1)), ("y", "p", day(2020, 1, 1), None), ("y", "q", day(2020, 1, 1), day(2020, 1, 1)), ("z", "q", None, None), ("z", "p", None, None)], "artifact string, person_id string, start date, end date")
    (edge,) = resolution.connections({"coauthor": facts}, F.lit("2024-12-01").cast("date")).collect()
    assert (edge["person_a"], edge["person_b"], edge["first_seen"], edge["last_seen"]) == ("p", "q", day(2020, 1, 1), day(2024, 6, 1)) and edge["evidence"] == ["x", "y"]


@pytest.fixture(scope="module")
def bag(spark):
    ts = dt.datetime
    persons = spark.createDataFrame([("p", "Founder of X", "ETH Zürich"), ("q", None, "Nowhere"), ("r", None, None)], "person_id string, headline string, affiliation string")
    contributions = spark.createDataFrame([("p", "g1", 100, 0.6, ts(2024, 1, 1), ts(2024, 3, 11)), ("q", "g1", 5, 0.1, ts(2020, 1, 1), ts(2020, 2, 1)), ("q", "g2", None, None, None, None)], "person_id string, project_id string, commit_count long, contribution_share double, first_commit_at timestamp, last_commit_at timestamp")
    projects = spark.createDataFrame([("g1", 1000), ("g2", None)], "project_id string, stars int")
    papers = spark.createDataFrame([("w1", None, dt.date(2024, 5, 1)), ("w2", 7, dt.date(2023, 1, 1))], "publication_id string, citation_count int, published_at date")
    authors = spark.createDataFrame([("q", "w1"), ("q", "w2")], "person_id string, publication_id string")
    officers = spark.createDataFrame([("p", "board", dt.date(2022, 1, 1))], "person_id string, role_norm string, registered_at date")
    edges = spark.createDataFrame([("p", "q")], "person_a string, person_b string")
    seeds = spark.createDataFrame([("eth zurich", ["eth"], 95.0)], "name string, aliases array<string>, score double")
    now = F.lit("2024-06-01").cast("timestamp")
    over = spark.createDataFrame([("r", {"school_tier": 0.5})], "person_id string, features map<string,double>")
    return features.person_features(persons, contributions, projects, authors, papers, officers, edges, seeds, now, overrides=over)


def test_features(bag):
    got = {r["person_id"]: r["features"] for r in bag.collect()}
    assert got["p"] == {"stars_weighted": 6.4, "commits_12mo": 100.0, "active_weeks_12mo": 10.0, "zero_to_one_flag": 1.0, "school_tier": 0.95, "recency_score": 0.53, "graph_centrality": 1.0}
    assert got["q"] == {"stars_weighted": 4.62, "citations_total": 7.0, "recency_score": 0.79, "graph_centrality": 1.0}
    assert got["r"] == {"school_tier": 0.5, "graph_centrality": 0.0}


def test_stage_a(spark, bag):
    members = spark.createDataFrame([("v1", "p"), ("v1", "q"), ("v2", "r")], "venture_id string, person_id string")
    facts = spark.createDataFrame([("p", "x", dt.date(2020, 1, 1), dt.date(2021, 1, 1)), ("q", "x", dt.date(2020, 6, 1), dt.date(2023, 1, 1))], "person_id string, artifact string, first date, last date")
    scores = scoring.experience(members, bag).unionByName(scoring.schools(members, bag)).unionByName(scoring.prior_collaboration(members, facts)).unionByName(scoring.ideal_match(members, bag, {"stars_weighted": 0.5, "school_tier": 0.9}, {"school_tier": 2.0}))
    weights = spark.createDataFrame([(2.0, 1.0, 1.0, 1.0)], "w_individual_experience double, w_schools double, w_prior_collaboration double, w_ideal_match double")
    for c in scoring.CATEGORIES:
        if f"w_{c}" not in weights.columns:
            weights = weights.withColumn(f"w_{c}", F.lit(0.5))
    got = {r["venture_id"]: r for r in scoring.stage_a(members.select("venture_id").distinct(), scores, scoring.coverage(members, bag), weights, F.lit("2024-06-01").cast("timestamp")).collect()}
    one, two = got["v1"], got["v2"]
    assert one["s_schools"] == 95.0 and one["s_prior_collaboration"] == 90.0 and two["s_prior_collaboration"] is None and two["s_individual_experience"] is None
    # p: github percentiles 1, 1 and flag 1 -> 100; q: percentile .5 and papers 1 -> 66.67
    assert one["s_individual_experience"] == round(0.6 * (100 + 100 * (0.3 * 0.5 + 0.15 * 1) / 0.45) / 2 + 0.4 * 100, 1)
    used = [("s_individual_experience", 2.0), ("s_schools", 1.0), ("s_prior_collaboration", 1.0), ("ideal_match", 1.0)]
    assert one["final_score"] == pytest.approx(sum(one[c] * w for c, w in used) / 5.0, abs=0.06)
    assert two["s_schools"] == 50.0 and two["quality_tier"] == "needs_more_data" and one["is_latest"]
    order = scoring.rerank(spark.createDataFrame([(1, 10.0, None), (2, 5.0, 100.0)], "id long, a double, b double"), ["a", "b"], {"a": 1.0, "b": 1.0}, "id").orderBy("rank").collect()
    assert [(r["id"], r["final_score"]) for r in order] == [(2, 52.5), (1, 10.0)]


def test_pool_reasons_one_by_one(spark):
    base = dict(venture_id="v", market_tags=["ai"], country_code="DE", team_size=3, is_corporate_oss=False, funding_signal="none_found")
    schema = "venture_id string, market_tags array<string>, country_code string, team_size int, is_corporate_oss boolean, funding_signal string"
    for change, reason in (({}, []), ({"market_tags": ["bio"]}, ["sector_mismatch"]), ({"market_tags": []}, ["sector_mismatch"]), ({"country_code": "US"}, ["geo_mismatch"]), ({"country_code": None}, []), ({"team_size": 1}, ["team_too_small"]), ({"team_size": 9}, ["team_too_large"]), ({"is_corporate_oss": True}, ["corporate_oss"]), ({"funding_signal": "confirmed_funded"}, ["confirmed_funded"]), ({"funding_signal": "suspected"}, [])):
        got = scoring.pool(spark.createDataFrame([tuple((base | change).values())], schema), ["ai"], ["EU"], 2, 5, True, True).first()
        assert got["exclusion_reasons"] == reason and got["included"] == (not reason)


def test_funding_and_gaps_and_members(spark):
    probes = spark.createDataFrame([("v1", "u1", "A AG", ""), ("v2", "u2", "Big Robot GmbH", ""), ("v3", None, "C", "We raised CHF 2 million last year"), ("v4", None, "D", "raised beds in the garden"), ("v6", "u9", "F", None), ("v7", None, "G", "seeds only"), ("v5", None, "E", "a seed funding round was announced")], "venture_id string, uid string, company_name string, text string")
    filings = spark.createDataFrame([("u1", None, "Kapitalerhöhung vom 3. Mai"), ("u9", "HR02", None)], "uid string, sub_rubric string, text string")
    listed = spark.createDataFrame([("big robot",)], "org_key string")
    said = spark.createDataFrame([("v5", "none_found")], "venture_id string, verdict string")
    got = {r["venture_id"]: r["funding_signal"] for r in scoring.funding_signal(probes, filings, listed, said).collect()}
    assert got == {"v1": "confirmed_funded", "v2": "confirmed_funded", "v3": "suspected", "v4": "suspected", "v5": "none_found", "v6": "confirmed_funded", "v7": "none_found"}
    catalog = spark.createDataFrame([("f1", "market", 0.9, 1), ("f2", "traction", 0.5, 2), ("f3", "schools", 1.0, 3)], "field string, category string, importance double, position int")
    asked = scoring.gaps(probes.select("venture_id").limit(1), catalog, spark.createDataFrame([("v1", "f3")], "venture_id string, field string"), {"market": 1.0, "traction": 3.0}).orderBy("rank").collect()
    assert [r["field"] for r in asked] == ["f2", "f1"]
    shares = spark.createDataFrame([("g", "p", 0.6, 50), ("g", "q", 0.06, 10), ("g", "r", 0.06, 9)], "project_id string, person_id string, contribution_share double, commit_count int")
    repo = scoring.repo_members(shares)
    assert [(r["person_id"], r["weight"]) for r in repo.orderBy("person_id").collect()] == [("p", 0.9091), ("q", 0.0909)]
    officers = scoring.officer_members(spark.createDataFrame([("g", "p", "founder", "single"), ("g", "z", "board", "joint"), ("g", "y", "board", None)], "company_id string, person_id string, role_norm string, signing_authority string"))
    team = {r["person_id"]: r for r in scoring.merged_members(repo, officers.withColumnRenamed("company_id", "project_id"), "project_id").collect()}
    assert team["p"]["is_founder_guess"] and team["p"]["role_hint"] == "founder" and team["z"]["weight"] == round(0.5 / 1.5, 4) and set(team) == {"p", "q", "z"}
    projects = spark.createDataFrame([("p1", "repo", 0.7, None), ("p2", "corp", 0.9, True), ("p3", "low", None, False)], "project_id string, name string, venture_likeness double, is_corporate_oss boolean")
    firms = spark.createDataFrame([("c1", "Firm", scoring.STARTUP), ("c2", "Free", scoring.STARTUP), ("c3", "Old", None)], "company_id string, name string, startup_likeness string")
    found = scoring.anchors(projects, firms, spark.createDataFrame([("p1", "c1")], "project_id string, company_id string"))
    assert {tuple(r) for r in found.collect()} == {("github_repo", "p1", "Firm"), ("company", "c2", "Free")}


def test_twins_and_fallbacks(spark, people):
    links = spark.createDataFrame([("c1", "person-eva", "active")], "record_id string, person_id string, status string")
    other = people.withColumn("source", F.when(F.col("record_id") == "c2", "showcase").otherwise(F.col("source")))
    assert [tuple(r) for r in identity.linked_twins(other, links).collect()] == [("c2", "person-eva")] and identity.linked_twins(people, links).count() == 0
    rows = people.where("record_id like 'a%'").withColumn("person_id", F.lit("m"))
    assert identity.first_by_rank(rows, [F.col("orcid"), F.col("website_url_norm")], "x").first()["x"] == "0001"


def test_company_matches(spark):
    repo = spark.createDataFrame([("g1", "p"), ("g1", "q"), ("g2", "p"), ("g3", "p"), ("g4", "p")], "project_id string, person_id string")
    officers = spark.createDataFrame([("c1", "p"), ("c1", "q"), ("c2", "p")], "company_id string, person_id string")
    projects = spark.createDataFrame([("g1", "x", None, None), ("g2", "y", "https://www.two.ch/", None), ("g3", "z", None, "Tools of Two Robotics for all"), ("g4", "w", None, None)], "project_id string, name string, homepage_url string, description string")
    companies = spark.createDataFrame([("c1", "One AG", None, None), ("c2", "Two Robotics GmbH", "two.ch", "selling shoes")], "company_id string, name string, website_url string, purpose string")
    assert {tuple(r) for r in scoring.matching_companies(repo, officers, projects, companies).collect()} == {("g1", "c1"), ("g2", "c2"), ("g3", "c2"), ("g4", "c2")} - {("g4", "c2")}
    found = spark.createDataFrame([("company", "c1", "One")], "anchor_type string, anchor_id string, name string")
    first = scoring.ventures(found, spark.createDataFrame([], "venture_id string, status string, quality_tier string"))
    assert first.first()["status"] == "sourced"
    again = scoring.ventures(found, first.select("venture_id", F.lit("contacted").alias("status"), F.lit("scored").alias("quality_tier")))
    assert again.first()["status"] == "contacted"
    profiles = spark.createDataFrame([(1, False), (2, None), (3, True)], "k long, is_active boolean")
    assert scoring.first_active(profiles, "k").first()["k"] == 2


def test_training_of_linkage(spark):
    from tessera.operators import identity
    from tessera.plans import identity_queries
    from tessera.plans.registry import Tables

    records = identity_queries.records(Tables(spark, "/root/testdata/sf0.001")).drop("person_id")
    drawn = identity.random_pairs(records, 3000)
    assert 2900 < drawn.count() <= 3000 and drawn.where("left >= right").count() == 0
    got = identity.train(records, 3000, 2)
    for name, (levels, _) in identity.COMPARISONS.items():
        m, u = got[name]
        assert len(m) == len(u) == levels and sum(m) == pytest.approx(1) and sum(u) == pytest.approx(1)
    assert got["g_name"][0][0] > got["g_name"][1][0] and got["g_email"][0][0] > got["g_email"][1][0]


def test_em_over_patterns_equals_em_over_pairs(spark):
    """Sufficient statistics: the same m as a plain EM that looks at every pair in every round."""
    import math
    import random

    rng = random.Random(2)
    pairs = [(rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([0, 1, None])) for _ in range(500)]
    m = {"g_name": list(identity.NAME_M), "g_country": list(identity.COUNTRY_M)}
    u = {"g_name": identity.NAME_U, "g_country": identity.COUNTRY_U}
    prior = identity.PRIOR
    for _ in range(4):
        sums, expected = {c: [0.0] * len(v) for c, v in m.items()}, 0.0
        for pair in pairs:
            at = {c: len(m[c]) - 1 - x for c, x in zip(m, pair) if x is not None}
            odds = prior / (1 - prior) * math.prod(m[c][i] / u[c][i] for c, i in at.items())
            p = odds / (1 + odds)
            expected += p
            for c, i in at.items():
                sums[c][i] += p
        prior = expected / len(pairs)
        m = {c: [x / sum(v) for x in v] for c, v in sums.items()}
    levels = spark.createDataFrame(pairs, "g_name int, g_country int")
    got = identity.expectation_maximisation(levels, {c: ((identity.NAME_M, identity.COUNTRY_M)[i], u[c]) for i, c in enumerate(m)}, rounds=4)
    assert all(abs(a - b) < 1e-9 for c in m for a, b in zip(m[c], got[c]))
    assert identity.em_of_patterns([], {"g_name": (identity.NAME_M, identity.NAME_U)}) == {"g_name": identity.NAME_M}


def test_vectors_are_not_broadcast(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["n09_embeddings"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_by_code_are_not_grouped(spark):
    """Reasons in order, several URLs of one project, and no grouping over the pairs."""
    projects = spark.createDataFrame([(1, "u1", ["a1"], None), (1, "u2", None, None), (2, "u3", None, None), (3, None, ["a2"], None)], "project_id long, repo_url_norm string, arxiv_ids_in_readme array<string>, homepage_norm string")
    papers = spark.createDataFrame([(10, "a1", ["u1", "u2"]), (11, "a2", ["u2", "u1", "u2"]), (12, "a3", None)], "publication_id long, arxiv_id string, code_url_norms array<string>")
    archive = spark.createDataFrame([("u1", "a2", 0), ("u3", "a3", 0)], "repo_url_norm string, arxiv_id string, position int")
    firms = spark.createDataFrame([], "company_id long, website_norm string")
    found, _ = identity.crosslinks(projects, papers, archive, firms)
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert {tuple(r) for r in found.collect()} == {(1, 10, "readme a1"), (1, 11, "code u1"), (2, 12, "archive u3"), (3, 11, "readme a2")} and found.count() == 4


def test_tasks_follow_the_pairs_by_code(spark, monkeypatch):
    """1,000 projects of one URL and 800 papers make 800,000 pairs, in as many tasks as these take, not as the rows do; pairs of
    sides with several URLs beside them count by the first that both have."""
    import re

    from tessera.operators import skew

    monkeypatch.setattr(skew, "PART_ROWS", 2_000)
    projects = spark.range(1_000).selectExpr("id as project_id", "'u' as repo_url_norm", "cast(null as array<string>) as arxiv_ids_in_readme", "cast(null as string) as homepage_norm")
    projects = projects.unionByName(spark.range(5, 10).selectExpr("id as project_id", "'t' as repo_url_norm", "array('a7') as arxiv_ids_in_readme", "cast(null as string) as homepage_norm"))
    papers = spark.range(800).selectExpr("id as publication_id", "'a' || id as arxiv_id", "case when id % 100 = 0 then array('u', 't') else array('u') end as code_url_norms")
    archive, firms = (spark.createDataFrame([], x) for x in ("repo_url_norm string, arxiv_id string, position int", "company_id long, website_norm string"))
    found, _ = identity.crosslinks(projects, papers, archive, firms)
    dealt = re.findall(r"RepartitionByExpression \[.*\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())
    assert max(map(int, dealt), default=0) >= 1_000 * 800 // skew.PART_PAIRS // 2_000
    got = dict(found.groupBy("evidence").count().collect())
    assert got == {"readme a7": 5, "code t": 40, "code u": 800_000 - 5 - 40}
