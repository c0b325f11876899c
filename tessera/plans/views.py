"""What readers see: ranked ventures, teams, networks, similarity to the ideal, signals of persons. All lazy; filters and
column choices of the caller reach the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import dot
from tessera.operators.relational import left_flagged, symmetric
from tessera.operators.skew import small

SIGNAL = ("person_id", "signal_type", "artifact_id", "artifact_name", "role", "magnitude", "confidence", "source_url", "occurred_at")


def ranked_ventures(ventures: DataFrame, scores: DataFrame) -> DataFrame:
    """Every venture with its latest score, unscored ones included."""
    return left_flagged(ventures, scores.drop("score_id", "thesis_id", "weights_id", "profile_id", "model_version"), ["venture_id"], F.col("is_latest")).drop("is_latest")


def venture_team(members: DataFrame, persons: DataFrame) -> DataFrame:
    """Members who are active persons."""
    shown = [c for c in ("person_id", "full_name", "headline", "github_login", "orcid", "linkedin_url", "affiliation", "avatar_url", "primary_email") if c in persons.columns]
    return members.join(persons.where("status = 'active'").select(*shown), "person_id")


def person_network(edges: DataFrame) -> DataFrame:
    """(person_id, people_connected): both directions of every edge as a list, the heaviest first."""
    both = symmetric(edges.select("person_a", "person_b", "connection_type", "weight"), "person_a", "person_b")
    item = F.struct("weight", F.col("person_b").alias("other_person_id"), "connection_type")
    return both.groupBy(F.col("person_a").alias("person_id")).agg(F.sort_array(F.collect_list(item), False).alias("people_connected"))


def person_similarity(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(person_id, profile_id, domain_fit) against the active profiles: every pair is the result that is wanted."""
    ideal = profiles.where("is_active").select("profile_id", F.col("embedding").alias("_ideal"))
    known = vectors.where("embedding is not null")
    return known.crossJoin(small(ideal)).select("person_id", "profile_id", dot(F.col("embedding"), F.col("_ideal")).alias("domain_fit"))


def person_signals(persons: DataFrame, links: DataFrame, contributions: DataFrame, projects: DataFrame, authorships: DataFrame, publications: DataFrame, officers: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per active person and fact reached through an active link; three shapes as one, with typed nulls."""
    reached = persons.where("status = 'active'").select("person_id").join(links.where("status = 'active'").select("person_id", "record_id"), "person_id")

    def facts(kind: str, df: DataFrame, artifact: DataFrame, key: str, name: str, role, magnitude, at) -> DataFrame:
        rows = df.join(reached, "record_id").join(artifact, key)
        return rows.select("person_id", F.lit(kind).alias("signal_type"), F.col(key).alias("artifact_id"), F.col(name).alias("artifact_name"), role.cast("string").alias("role"), magnitude.cast("int").alias("magnitude"), "confidence", "source_url", at.cast("timestamp").alias("occurred_at"))

    none = F.lit(None)
    made = facts("contribution", contributions, projects.select("project_id", "full_name"), "project_id", "full_name", none, F.col("commit_count"), F.col("last_commit_at"))
    wrote = facts("authorship", authorships, publications.select("publication_id", "title", "citation_count", "published_at"), "publication_id", "title", F.col("author_position"), F.col("citation_count"), F.col("published_at"))
    leads = facts("officer", officers, companies.select("company_id", "name"), "company_id", "name", F.col("role_norm"), none, F.col("registered_at"))
    return made.unionByName(wrote).unionByName(leads)


def bundles(members: DataFrame, features: DataFrame) -> DataFrame:
    """(venture_id, members): each venture with its members, the weightiest first (unknown weight counts as 0), and their features."""
    rows = members.join(features.select("person_id", "features"), "person_id", "left")
    item = F.struct((-F.coalesce("weight", F.lit(0.0))).alias("o"), "person_id", "weight", F.map_entries(F.coalesce("features", F.create_map().cast("map<string,double>"))).alias("f"))
    sorted_items = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["person_id"].alias("person_id"), x["weight"].alias("weight"), F.map_from_entries(x["f"]).alias("features")))
    return rows.groupBy("venture_id").agg(sorted_items.alias("members"))


def latest_memo(memos: DataFrame) -> DataFrame:
    """The newest memo of each venture; an unknown time counts as the oldest."""
    order = F.struct(F.coalesce("created_at", F.lit("")), "memo_id")
    return memos.groupBy("venture_id").agg(F.max_by(F.struct(*(c for c in memos.columns if c != "venture_id")), order).alias("m")).select("venture_id", "m.*")


def score_history(scores: DataFrame, key: str, at: str) -> DataFrame:
    """All scores, the newest first within a key."""
    return scores.orderBy(key, F.desc_nulls_last(at))
