import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.plans import outreach, scoring, views


def test_views(spark):
    ventures = spark.createDataFrame([("v1", "A"), ("v2", "B")], "venture_id string, name string")
    scores = spark.createDataFrame([("s1", "v1", 80.0, True), ("s0", "v1", 10.0, False), ("s2", "v2", 5.0, False)], "score_id string, venture_id string, final_score double, is_latest boolean")
    assert {tuple(r) for r in views.ranked_ventures(ventures, scores).collect()} == {("v1", "A", 80.0), ("v2", "B", None)}
    persons = spark.createDataFrame([("p", "P", "active"), ("q", "Q", "active"), ("z", "Z", "merged")], "person_id string, full_name string, status string")
    members = spark.createDataFrame([("v1", "p", 0.5), ("v1", "z", 0.5)], "venture_id string, person_id string, weight double")
    assert [r["full_name"] for r in views.venture_team(members, persons).collect()] == ["P"]
    edges = spark.createDataFrame([("p", "q", "coauthor", 1.0), ("p", "z", "co_officer", 2.0)], "person_a string, person_b string, connection_type string, weight double")
    net = {r["person_id"]: [x["other_person_id"] for x in r["people_connected"]] for r in views.person_network(edges).collect()}
    assert net == {"p": ["z", "q"], "q": ["p"], "z": ["p"]}
    vectors = spark.createDataFrame([("p", [1.0, 0.0]), ("q", None)], "person_id string, embedding array<float>")
    ideal = spark.createDataFrame([("i", [0.5, 0.5], True), ("j", [1.0, 0.0], False)], "profile_id string, embedding array<float>, is_active boolean")
    assert [tuple(r) for r in views.person_similarity(vectors, ideal).collect()] == [("p", "i", 0.5)]
    links = spark.createDataFrame([("p", "r1", "active"), ("p", "r2", "retracted"), ("z", "r3", "active")], "person_id string, record_id string, status string")
    facts = "record_id string, confidence double, source_url string"
    made = spark.createDataFrame([("r1", 1.0, "u", "g", 5, dt.datetime(2024, 1, 1)), ("r2", 1.0, "u", "g", 5, None)], f"{facts}, project_id string, commit_count long, last_commit_at timestamp")
    wrote = spark.createDataFrame([("r1", 1.0, "u", "w", 2)], f"{facts}, publication_id string, author_position int")
    leads = spark.createDataFrame([("r3", 1.0, "u", "c", "founder", dt.date(2020, 1, 1))], f"{facts}, company_id string, role_norm string, registered_at date")
    got = views.person_signals(persons, links, made, spark.createDataFrame([("g", "a/g")], "project_id string, full_name string"), wrote, spark.createDataFrame([("w", "T", 3, dt.date(2023, 1, 1))], "publication_id string, title string, citation_count int, published_at date"), leads, spark.createDataFrame([("c", "C")], "company_id string, name string"))
    assert tuple(got.columns) == views.SIGNAL
    assert {(r["person_id"], r["signal_type"], r["artifact_name"], r["role"], r["magnitude"]) for r in got.collect()} == {("p", "contribution", "a/g", None, 5), ("p", "authorship", "T", "2", 3)}


def test_contacts(spark):
    persons = spark.createDataFrame([("p", "p@x"), ("q", "q@x"), ("r", None), ("s", "s@x")], "person_id string, primary_email string")
    team = spark.createDataFrame([("v", "p", 0.9, False), ("v", "q", 0.1, True), ("v", "r", 1.0, True), ("w", "r", 1.0, True)], "venture_id string, person_id string, weight double, is_founder_guess boolean")
    assert [(r["venture_id"], r["to_email"]) for r in outreach.founders(team, persons).collect()] == [("v", "q@x")]
    sent = spark.createDataFrame([("p", "opted_out"), ("q", "sent")], "person_id string, status string")
    links = spark.createDataFrame([("s", "r1", "active"), ("q", "r2", "retracted")], "person_id string, record_id string, status string")
    records = spark.createDataFrame([("r1", "github", "7"), ("r2", "github", "8")], "record_id string, source string, source_key string")
    gone = spark.createDataFrame([("github", "7"), ("github", "8")], "source string, k string").select("source", F.sha2("k", 256).alias("key_hash"))
    assert sorted(r["person_id"] for r in outreach.forbidden(persons, sent, links, records, gone).collect()) == ["p", "s"]
    gaps = spark.createDataFrame([("v", "low", 0.1), ("v", "high", 0.9), ("v", None, 1.0)], "venture_id string, question_text string, importance double")
    assert outreach.question_plan(gaps).first()["questions"] == ["high", "low"]


def test_interviews(spark):
    seen = spark.createDataFrame([("i1", "v", "p", '{"education": [{"institution": "ETH"}, {"institution": "None"}], "traction_claims": ["x"]}'), ("i2", "w", "q", "{}")], "interview_id string, venture_id string, person_id string, extracted string")
    first = outreach.new_interviews(seen, spark.createDataFrame([], "fingerprint string, status string"))
    runs = first.select("fingerprint", F.lit("ok").alias("status"))
    assert first.count() == 2 and outreach.new_interviews(seen, runs).count() == 0
    feats = spark.createDataFrame([("p", {"school_tier": 0.5, "x": 1.0}), ("q", {"school_tier": 0.9})], "person_id string, features map<string,double>")
    seeds = spark.createDataFrame([("eth zurich", ["eth"], 95.0)], "name string, aliases array<string>, score double")
    got = {r["person_id"]: r["features"] for r in outreach.raised_school_tiers(feats, seen, seeds).collect()}
    assert got == {"p": {"school_tier": 0.95, "x": 1.0}, "q": {"school_tier": 0.9}}
    assert [r["venture_id"] for r in outreach.confirmed_traction(seen).collect()] == ["v"]
    table = spark.createDataFrame([("a", "x", 3), ("b", "y", 1)], "k string, v string, version int")
    assert sorted(map(tuple, outreach.revised(table, spark.createDataFrame([("a", "new")], "k string, v string"), "k", "version").collect())) == [("a", "new", 4), ("b", "y", 1)]


def test_unknown_features_do_not_match(spark):
    members = spark.createDataFrame([("v", "p"), ("w", "q")], "venture_id string, person_id string")
    feats = spark.createDataFrame([("p", {"school_tier": 0.45}), ("q", {"other": 1.0})], "person_id string, features map<string,double>")
    got = scoring.ideal_match(members, feats, {"stars_weighted": 0.5, "school_tier": 0.9}, {}).collect()
    assert [(r["venture_id"], r["score"]) for r in got] == [("v", pytest.approx(50.0))]
