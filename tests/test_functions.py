import uuid

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, text


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("Dr. Zoë  Müller, PhD", "zoe muller"), ("Weiß", "weiss"), ("Prof", ""), (None, None), ("ŁÓDŹ [x]", "łodz x")])
def test_name_key(spark, raw, want):
    assert one(spark, text.name_key(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw,want", [(" Ann@X.org ", "ann@x.org"), ("a@b@c", None), ("@x.org", None), ("a@", None), ("info@x.org", None), ("1+a@users.noreply.github.com", None), (None, None)])
def test_email_key(spark, raw, want):
    assert one(spark, text.email_key(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw,want", [("Müller & Co. GmbH", "muller &"), ("GmbH", ""), ("Acme, Inc.", "acme"), ("SA Tools", "sa tools"), ("A AG SE", "a")])
def test_org_key(spark, raw, want):
    assert one(spark, text.org_key(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw,want", [("https://WWW.Site.org/Path/?q#f", "site.org/Path"), ("site.org", "site.org"), ("http://", None), (" ", None), ("HTTP://a.b/", "a.b"), ("a.b/c/d//", "a.b/c/d"), (None, None)])
def test_url_key(spark, raw, want):
    assert one(spark, text.url_key(F.col("a")), a=raw) == want


def test_small_text_functions(spark):
    assert one(spark, text.strip_legal_form(F.col("a")), a="Acme Robotics GmbH") == "Acme Robotics"
    assert one(spark, text.strip_legal_form(F.col("a")), a="AG") == "AG"
    assert one(spark, text.paper_id(F.col("a")), a="2101.00001v3").asDict() == {"id": "2101.00001", "version": 3}
    assert one(spark, text.paper_id(F.col("a")), a="2101.00001")["version"] == 1
    assert one(spark, text.paper_id_of_work(F.col("a"), F.col("b")), a="10.48550/arXiv.2101.00001", b=[]) == "2101.00001"
    assert one(spark, text.paper_id_of_work(F.col("a"), F.col("b")), a="10.1/x", b=["http://x", "https://arxiv.org/abs/2202.12345v2"]) == "2202.12345"
    assert one(spark, text.lookup_doi(F.col("a"), F.col("b")), a=None, b="2101.1") == "10.48550/arxiv.2101.1"
    assert one(spark, text.code_links(F.col("a")), a="see https://github.com/A/b.git and github.com/a/B. Or gitlab.com/c/d.") == ["https://github.com/A/b", "https://gitlab.com/c/d"]
    assert one(spark, text.bare_orcid(F.col("a")), a="https://orcid.org/0000-1") == "0000-1"
    assert one(spark, text.first_email(F.col("a")), a="mail me: x.y@z.org, or a@b.c") == "x.y@z.org"
    assert one(spark, text.first_email(F.col("a")), a="none") is None
    assert one(spark, text.profile_text(F.col("a"), F.col("b")), a="Robots and AI", b="ai AND more") == "robots and ai more"
    assert one(spark, text.place(F.col("a"), F.col("b")), a="Bern", b="ch").asDict() == {"city": "Bern", "country": "CH"}
    assert one(spark, text.place(F.col("a"), F.col("b")), a="Bern", b="Switzerland").asDict() == {"city": "Bern, Switzerland", "country": None}
    assert one(spark, text.country_in(F.col("a"), {"zurich": "CH", "paris": "FR"}), a="near Paris or Zurich") == "FR"
    assert one(spark, text.persons_in(F.col("a"), r"(\w+), of (\w+)", 2), a="Ann, of Bern; Bob, of Sion") == [["Ann", "Bern"], ["Bob", "Sion"]]
    assert one(spark, text.unfence(F.col("a"))["raw"], a="```json\n{\"a\": 1}\n```") is None
    assert one(spark, text.unfence(F.col("a"))["raw"], a="not json {") == "not json {"
    assert one(spark, text.first_line(F.col("a")), a="TASK:x\nrest") == "TASK:x"
    assert one(spark, text.prefix_match(F.col("a"), F.col("b")), a="tacti", b="tactile") and not one(spark, text.prefix_match(F.col("a"), F.col("b")), a="tac", b="tactile")
    assert one(spark, text.login_is_name(F.col("a"), F.col("b")), a="AnnLee", b="ann lee") is True and one(spark, text.login_is_name(F.col("a"), F.col("b")), a=None, b="x") is False
    assert one(spark, text.first_matches(F.col("a"), {"yc": r"(?i)y combinator", "seed": "seed"}), a="seed by Y Combinator") == ["yc", "seed"]
    likeness = lambda n, d, r: one(spark, text.repo_likeness(F.col("a"), F.col("b"), F.col("c")), a=n, b=d, c=r)
    assert [likeness("x", "a tool", "see arXiv"), likeness("x", None, None), likeness("awesome-x", "a tool", None), likeness("x", "my demo", "paper")] == [0.75, 0.5, 0.2, 0.2]
    assert one(spark, text.first_matches(F.col("a"), text.FUNDED), a="Backed by Sequoia, YC W21; Series B") == ["backed_by", "series_round", "yc_batch", "sequoia"]
    assert one(spark, text.owner_signals(F.lit(True), F.array(F.lit("u")), F.col("a"), F.col("b")), a="https://www.x.org", b="x.org/app") == ["org_verified", "funding_links", "org_domain_matches_homepage"]
    assert one(spark, text.url_domain(F.col("a")), a="") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde ", max_size=12), st.text(alphabet="abcde ", max_size=12))
def test_jaro_winkler_equals_sql(a, b):
    if a and b:
        assert abs(text.jaro_winkler_of(a, b) - duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9


def test_partial_ratio():
    assert text.partial_ratio_of("robot", "a robot arm") == 1.0 and text.partial_ratio_of("", "x") == 0.0
    assert 0.5 < text.partial_ratio_of("robots", "a robot arm") < 1.0


def test_ids(spark):
    assert one(spark, ids.uuid5(F.col("a")), a="github:1") == str(uuid.uuid5(ids.NAMESPACE, "github:1"))
    assert one(spark, ids.entity_id("company", F.col("a")), a="é") == str(uuid.uuid5(ids.NAMESPACE, "company:é"))
    assert one(spark, ids.pair_id(F.col("a"), F.col("b")), a="x", b="y") == one(spark, ids.pair_id(F.col("a"), F.col("b")), a="y", b="x")
    assert one(spark, ids.publication_id(F.col("a"), F.col("b"), F.lit(None).cast("string")), a=None, b="2101") == str(uuid.uuid5(ids.NAMESPACE, "arxiv:2101"))
    assert one(spark, ids.content_hash(F.col("a")), a='{"b": 1, "a": [2]}') == one(spark, ids.content_hash(F.col("a")), a='{"a":[2],"b":1}')


def test_numbers(spark):
    assert one(spark, numbers.iso_week(F.col("a").cast("date")), a="2027-01-01") == "2026-W53"
    assert str(one(spark, numbers.day(F.col("a")), a="2024-02-30T10")) == "None" and str(one(spark, numbers.day(F.col("a")), a="2024-02-29T10")) == "2024-02-29"
    d = lambda c: F.col(c).cast("date")
    assert one(spark, numbers.recency(d("a"), d("b")), a="2024-01-01", b="2024-03-31") == 0.5 and one(spark, numbers.recency(d("a"), d("b")), a="2025-01-01", b="2024-01-01") == 1.0
    assert one(spark, numbers.edge_decay(d("a"), d("b")), a="2022-01-01", b="2024-01-01") == 0.25
    assert one(spark, numbers.span_weeks(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), a="2024-01-01", b="2024-01-15") == 2.0
    assert one(spark, numbers.weighted_mean([F.col("a"), F.lit(None).cast("double")], [F.lit(1.0), F.lit(5.0)]), a=7.0) == 7.0
    assert one(spark, numbers.weighted_mean([F.lit(None).cast("double")], [F.lit(1.0)]), a=7.0) is None
    assert one(spark, numbers.unit(F.array(F.lit(0.0), F.lit(0.0))), a=1.0) == [0.0, 0.0] and one(spark, numbers.unit(F.array(F.lit(3.0), F.lit(4.0))), a=1.0) == [0.6, 0.8]
    assert [one(spark, numbers.collaboration_score(F.lit(c), F.lit(y), F.lit(n)), a=1.0) for c, y, n in ((2, 0.0, 3), (1, 0.0, 3), (0, 2.5, 2), (0, 0.0, 2), (5, 9.0, 1))] == [90.0, 65.0, 90.0, 30.0, None]
    assert one(spark, numbers.in_regions(F.col("a"), F.array(F.lit("EU")), {"EU": ["DE"]}), a="DE") and one(spark, numbers.in_regions(F.col("a"), F.array(F.lit("EU")), {"EU": ["DE"]}), a=None)
    assert not one(spark, numbers.in_regions(F.col("a"), F.array(F.lit("EU")), {"EU": ["DE"]}), a="CH")
    assert one(spark, numbers.institution_score(F.lit(None).cast("double"), F.col("a")), a=1.0) == 35.0
    assert one(spark, numbers.closeness(F.col("a"), F.lit(2.0)), a=1.0) == 0.5
    assert one(spark, numbers.diversity(F.array(F.lit("x"), F.lit("y"))), a=1.0) == 1.0


def test_rounding_is_that_of_the_reference(spark):
    values = [258481.5, 32072.5, 130232.5, 259421.5, 75462.5, 0.5, -258481.5, 1.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(numbers.rounded(F.col("v") / 1000, 3).alias("r")).collect()
    assert [r["r"] for r in got] == [duckdb.execute("SELECT round(?::DOUBLE / 1000, 3)", [v]).fetchone()[0] for v in values]
