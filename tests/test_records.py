import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents
from tessera.plans import records

T = ("2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z")


def raw(spark, schema, rows):
    df = spark.createDataFrame([(*r[:-1], json.dumps(r[-1]), "http://src", *T) for r in rows], f"{schema}, p string, source_url string, s string, i string")
    return df.select("*", F.parse_json("p").alias("payload"), F.to_timestamp("s").alias("scraped_at"), F.to_timestamp("i").alias("ingested_at")).drop("p", "s", "i")


def test_github(spark):
    users = raw(spark, "user_id long, login string", [(1, "AnnLee", {"name": "Dr. Ann Lée", "email": "Ann@X.org", "blog": "https://www.ann.dev/", "company": "Robots GmbH", "location": "Zürich, Switzerland", "socialAccounts": {"nodes": [{"provider": "X", "url": "u"}, {"provider": "LINKEDIN", "url": "https://linkedin.com/in/Ann"}]}}), (2, "bob", {"blog": "", "email": None}), (None, "x", {})])
    commits = raw(spark, "repo_id long, sha string, author_user_id long", [(7, "a", 1, {"author": {"email": "ann@work.org"}}), (7, "b", 1, {"author": {"email": "ann@work.org"}}), (8, "c", None, {"author": {"email": "z@z.org"}}), (7, "d", 2, {"author": {}})])
    repos = raw(spark, "repo_id long", [(7, {"topics": ["SLAM", "ai"]}), (8, {"topics": ["other"]})])
    got = {r["source_key"]: r for r in records.derive(records.github(users, commits, repos)).collect()}
    a, b = got["1"], got["2"]
    assert a["name_norm"] == "ann lee" and (a["first_name"], a["last_name"]) == ("ann", "lee") and a["emails"] == ["Ann@X.org", "ann@work.org"] and a["email_norms"] == ["ann@x.org", "ann@work.org"] and a["email_domain"] == "x.org"
    assert a["website_url_norm"] == "ann.dev" and a["linkedin_url"] == "https://linkedin.com/in/Ann" and a["org_norm"] == "robots" and a["country_code"] == "CH" and a["keywords"] == ["ai", "slam"]
    assert b["full_name"] == "bob" and b["last_name"] is None and b["emails"] == [] and b["website_url_norm"] is None and len(got) == 2


def test_paper_authors(spark):
    works = raw(spark, "openalex_id string, arxiv_id string", [("W2", None, {"authorships": [{"author": {"id": "A1", "display_name": "Ann"}, "institutions": [{"display_name": "Later"}]}]}), ("W1", "2101.1", {"authorships": [{"author": {"id": "A1", "display_name": "Ann Lee", "orcid": "https://orcid.org/0-1"}, "institutions": [{"display_name": "ETH Zurich"}, {"display_name": "x"}]}, {"author": {"id": None}}, {"author": {"id": "A2", "display_name": "Bo"}, "institutions": []}]})])
    seeds = spark.createDataFrame([("eth zurich", "Swiss Federal Institute")], "alias string, name string")
    got = {r["source_key"]: r for r in records.derive(records.catalogue_authors(works), seeds).collect()}
    assert got["A1"]["orcid"] == "0-1" and got["A1"]["affiliation_raw"] == "ETH Zurich" and got["A1"]["org_norm"] == "swiss federal institute" and got["A2"]["affiliation_raw"] is None and len(got) == 2
    papers = raw(spark, "arxiv_id string", [("2101.1", {"authors": ["covered"]}), ("2102.2", {"authors": ["Solo"], "comment": "mail solo@x.org."}), ("2103.3", {"authors": ["P", "Q"], "comment": "p@x.org"}), ("2104.4", {"authors": []})])
    assert sorted((r["source_key"], r["full_name"], tuple(r["emails"])) for r in records.preprint_authors(papers, works).collect()) == [("2102.2:1", "Solo", ("solo@x.org",)), ("2103.3:1", "P", ()), ("2103.3:2", "Q", ())]


def test_officers(spark):
    notices = raw(spark, "sogc_id string, uid string", [("s1", "u1", {"publicationText": "Neu, A, B, in C, D, mit E. Eingetragene Personen: Müller, Eva, in Bern, Präsidentin, mit Einzelunterschrift; Roth, Jan, in Zug, Mitglied, mit Kollektivunterschrift."}), ("s2", None, {"publicationText": "Eingetragene Personen: A, B, in C, D, mit E"}), ("s3", "u1", {})])
    companies = spark.createDataFrame([("u1", "Acme AG")], "uid string, name string")
    got = records.derive(records.register_officers(notices, companies)).orderBy("source_key").collect()
    assert [(r["source_key"], r["full_name"], r["location_raw"], r["affiliation_raw"], r["org_norm"]) for r in got] == [("u1:muller eva", "Eva Müller", "Bern", "Acme AG", "acme"), ("u1:roth jan", "Jan Roth", "Zug", "Acme AG", "acme")]


def test_showcase(spark):
    people = raw(spark, "user_id string", [("1", {"name": "Ann", "email": "a@x.org", "city": "Bern", "country": "Switzerland", "skills": ["ml"]})])
    projects = raw(spark, "project_id string", [("p1", {"authorProfile": {"userId": "1", "name": "Ignored", "githubUsername": "annlee", "cvUrl": "u1", "skills": ["ros", "ml"]}, "team": [{"userId": "2", "name": "Bo", "country": "de", "cvUrl": "u2"}, {"name": "no id"}]}), ("p2", {"authorProfile": {"userId": "1", "cvUrl": "u1"}})])
    cvs = raw(spark, "user_id string", [("1", {"extracted": {"education": [{"institution": "ETH"}, {}]}}), ("2", {"extracted": {"education": []}}), ("3", {"raw": "x"})])
    got = {r["source_key"]: r for r in records.derive(records.showcase(people, projects, cvs)).collect()}
    assert set(got) == {"1", "2"} and got["1"]["full_name"] == "Ann" and got["1"]["github_login"] == "annlee" and got["1"]["keywords"] == ["ml", "ros", "eth"] and got["1"]["location_raw"] == "Bern, Switzerland" and got["1"]["country_code"] is None and got["2"]["country_code"] == "DE"
    assert sorted((r["user_id"], r["cv_url"], r["seen"]["project_id"]) for r in records.cv_targets(projects).collect()) == [("1", "u1", "p1"), ("2", "u2", "p1")]
    landed = records.raw_rows(spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, "broken")], "id long, j string"), "id", "j", F.current_timestamp(), F.current_timestamp())
    assert landed.count() == 1


def test_contracts(spark):
    schema = {"$defs": {"score": {"type": ["number", "null"], "minimum": 0, "maximum": 100}}, "type": "object", "required": ["score"], "properties": {"score": {"$ref": "#/$defs/score"}, "kind": {"enum": ["a", "b"]}, "items": {"type": "array", "items": {"type": "object", "required": ["claim"]}}}, "additionalProperties": False}
    rows = [('{"score": 5, "items": [{"claim": "x"}]}', 0), ('{"score": 500}', 1), ("{}", 1), ('{"score": true}', 1), ('{"score": null, "kind": "c", "x": 1}', 2), ('{"score": 1, "items": [{}]}', 1), ("broken", 1)]
    df = spark.createDataFrame(rows, "j string, n int").withColumn("e", documents.payload_errors(F.col("j"), schema))
    assert all(len(r["e"]) == r["n"] for r in df.collect())
    memo = spark.createDataFrame([('{"sections": [{"title": "t", "bullets": [{"text": "good", "citations": ["c"]}, {"text": "open", "gap": "g"}, {"text": "bad", "citations": []}]}, {"title": "u"}]}',)], "j string")
    assert memo.select(documents.uncited(F.parse_json("j")).alias("u")).first()["u"] == ["bad"]
    said = spark.createDataFrame([('{"score": 70, "evidence": [{"claim": "c", "source_url": "u"}, {"claim": "d"}]}',), ("{}",)], "j string").select(documents.verdict(F.col("j")).alias("v")).collect()
    assert said[0]["v"]["confidence"] == 0.6 and len(said[0]["v"]["evidence"]) == 1 and said[1]["v"]["confidence"] == 0.3
    vec = spark.createDataFrame([("Robots in Bern",), ("",)], "t string").select(documents.hashed_embedding(F.col("t"), 64).alias("v")).collect()
    assert sum(x * x for x in vec[0]["v"]) == pytest.approx(1, abs=1e-5) and set(vec[1]["v"]) == {0.0}


def test_commits_repositories_and_schools(spark):
    repos = raw(spark, "repo_id long", [(1, {"history": {"nodes": [{"oid": "b", "author": {"email": "A@x.org", "user": {"login": "ann"}}}, {"oid": "a", "author": {"email": "a@x.org", "user": {"login": "ann"}}}, {"oid": "c", "author": {"email": "1+ann@users.noreply.github.com", "user": {"login": "ann"}}}, {"oid": "d", "author": {"email": "z@z.org", "user": None}}]}})])
    got = records.commit_authors(repos).collect()
    assert [(r["login"], [(c["email"], c["sha"]) for c in r["commits"]]) for r in got] == [("ann", [("a@x.org", "a"), ("a@x.org", "b")])]
    pitched = raw(spark, "id long", [(1, {"githubUrl": "https://github.com/a/b.git"}), (2, {"githubUrl": "http://GitHub.com/a/b/tree/main"}), (3, {})])
    assert [r["full_name"] for r in records.repositories_of(pitched, "payload", "$.githubUrl").collect()] == ["a/b"]
    dump = raw(spark, "id long", [(1, {"id": "ror1", "types": ["education", "funder"], "names": [{"value": "ETH Zurich", "types": ["ror_display", "label"]}, {"value": "ETHZ", "types": ["acronym"]}], "locations": [{"geonames_details": {"country_code": "CH"}}]}), (2, {"id": "ror2", "types": ["company"], "names": []})])
    assert [tuple(r) for r in records.registered_schools(dump).collect()] == [("ror1", "ETH Zurich", ["ETHZ"], "CH")]


def test_halves_are_cast_as_sql_casts(spark, tmp_path):
    """Cents that end on a half go to the even number, as the cast of SQL takes them."""
    import __spark_entry__

    rows = [(1, 0, 50.0, "A"), (2, 0, 49.0, "A"), (3, 0, 150.0, "A"), (4, 0, 250.0, "A"), (5, 0, 199.0, "A")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = __spark_entry__.queries()["q19_components"](spark, str(tmp_path)).collect()
    assert {r["id"]: r["component"] for r in found} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    pairs = __spark_entry__.queries()["q18_identity_rules"](spark, str(tmp_path)).where("rule = 'D1'").collect()
    assert {(r["left"], r["right"]) for r in pairs} == {(1, 2), (3, 4), (3, 5), (4, 5)}
    kept = __spark_entry__.queries()["g10_guard"](spark, str(tmp_path)).where("kept").collect()
    assert {r["id"] for r in kept} == {1, 3}
