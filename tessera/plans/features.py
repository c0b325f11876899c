"""Person features: one grouped aggregate per fact table, joined by person, then a map without unknown values.

Facts: contributions (person_id, project_id, commit_count, contribution_share, first_commit_at, last_commit_at), projects
(project_id, stars), authorships (person_id, publication_id), publications (publication_id, citation_count,
published_at), officers (person_id, role_norm, registered_at), persons (person_id, headline, affiliation).
Unknown is null and absent from the map; only centrality is 0.0 for a person without edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import log_mass, recency, span_weeks
from tessera.functions.text import strip_accents
from tessera.operators.graph import centrality
from tessera.operators.relational import alias_lookup

# The window in days, the longest span in weeks, and what makes a project a hit.
WINDOW_DAYS, MOST_WEEKS, HIT_STARS, HIT_SHARE = 365, 52.0, 500, 0.5
KEYS = ("stars_weighted", "commits_12mo", "active_weeks_12mo", "commit_quality", "experience_problem_fit", "zero_to_one_flag", "school_tier", "recency_score", "graph_centrality", "citations_total")


def contribution_features(contributions: DataFrame, projects: DataFrame, now: Column) -> DataFrame:
    """Sums over valid rows only, so a person without any has null."""
    rows = contributions.join(projects.select("project_id", "stars"), "project_id")
    start = now - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    inside = F.col("last_commit_at") >= start
    weeks = span_weeks(F.greatest("first_commit_at", start), F.col("last_commit_at"))
    return rows.groupBy("person_id").agg(
        log_mass(F.sum(F.col("stars") * F.col("contribution_share"))).alias("stars_weighted"),
        F.sum(F.when(inside & F.col("commit_count").isNotNull(), F.col("commit_count").cast("double"))).alias("commits_12mo"),
        F.max(F.when(inside & F.col("first_commit_at").isNotNull(), F.when(weeks > MOST_WEEKS, MOST_WEEKS).otherwise(weeks))).alias("active_weeks_12mo"),
        F.max((F.col("stars") > HIT_STARS) & (F.col("contribution_share") >= HIT_SHARE)).alias("_hit"),
        F.max("last_commit_at").alias("_last"),
    )


def publication_features(authorships: DataFrame, publications: DataFrame) -> DataFrame:
    rows = authorships.join(publications.select("publication_id", "citation_count", "published_at"), "publication_id")
    return rows.groupBy("person_id").agg(F.sum(F.coalesce("citation_count", F.lit(0)).cast("double")).alias("citations_total"), F.max("published_at").cast("timestamp").alias("_paper"))


def officer_features(officers: DataFrame) -> DataFrame:
    return officers.groupBy("person_id").agg(F.max(F.col("role_norm") == "founder").alias("_founder"), F.max("registered_at").cast("timestamp").alias("_filed"))


def person_features(persons: DataFrame, contributions: DataFrame, projects: DataFrame, authorships: DataFrame, publications: DataFrame, officers: DataFrame, edges: DataFrame, institutions: DataFrame, now: Column, extra: DataFrame | None = None, overrides: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(person_id, features). ``institutions``: name, aliases, score (0 to 100). ``extra``: person_id with further numeric columns,
    such as verdicts of a language model. ``overrides``: person_id, features; they win."""
    joined = persons.select("person_id", "headline", "affiliation")
    for part in (contribution_features(contributions, projects, now), publication_features(authorships, publications), officer_features(officers), centrality(persons, edges, "person_id", "person_a", "person_b").withColumnRenamed("centrality", "graph_centrality")):
        joined = joined.join(part, "person_id", "left")
    joined = alias_lookup(joined.withColumn("_school", F.lower(strip_accents("affiliation"))), "_school", institutions, "score", -1.0)
    if extra is not None:
        joined = joined.join(extra, "person_id", "left")
    signal = F.coalesce("_founder", F.lit(False)) | F.coalesce(F.lower("headline").contains("founder"), F.lit(False)) | F.coalesce("_hit", F.lit(False))
    values = {
        "zero_to_one_flag": F.when(signal, 1.0),
        "school_tier": F.when(F.col("score") >= 0, F.col("score") / 100.0),
        "recency_score": recency(F.greatest("_last", "_paper", "_filed"), now),
    }
    known = {k: values.get(k, F.col(k)) for k in keys if k in values or k in joined.columns}
    bag = F.map_filter(F.create_map(*(x for k, c in known.items() for x in (F.lit(k), c.cast("double")))), lambda _, v: v.isNotNull())
    out = joined.select("person_id", bag.alias("features"))
    if overrides is None:
        return out
    over = overrides.select("person_id", F.col("features").alias("_over"))
    merged = F.map_concat(F.map_filter("features", lambda k, _: ~F.array_contains(F.map_keys("_over"), k)), F.col("_over"))
    return out.join(over, "person_id", "left").select("person_id", F.when(F.col("_over").isNull(), F.col("features")).otherwise(merged).alias("features"))


def commit_sample(contributions: DataFrame, most: int = 20) -> DataFrame:
    """Up to twenty ``repository@commit`` strings a person, in row order (by project)."""
    rows = F.sort_array(F.collect_list(F.struct("project_id", F.transform("sample_commit_shas", lambda s: F.concat("full_name", F.lit("@"), s)).alias("c"))))
    return contributions.groupBy("person_id").agg(F.slice(F.flatten(F.transform(rows, lambda x: x["c"])), 1, most).alias("sample"))
