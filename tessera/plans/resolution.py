"""The identity job: rules, linkage, adjudication, clusters, links, reviews, persons, edges, as one lazy graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import identity
from tessera.operators.graph import collaboration_edges, ensure_checkpoint_folder
from tessera.operators.relational import artifact_pairs
from tessera.operators.storage import stored


@dataclass
class Resolution:
    matches: DataFrame
    placed: DataFrame
    links: DataFrame
    reviews: DataFrame
    persons: DataFrame


def resolve(records: DataFrame, active: DataFrame, candidates: DataFrame, teams: DataFrame | None = None, verdicts: DataFrame | None = None) -> Resolution:
    """``records`` as in operators.identity, with full_name, affiliation_raw, location_raw, last_seen_at. ``active``: links
    that hold (record_id, person_id). ``candidates``: left, right, evidence from linked artifacts. ``verdicts``: left, right, verdict."""
    ensure_checkpoint_folder(records)
    rules = identity.identifier_rules(records, every_pair=False).unionByName(identity.crosslink_matches(candidates, records))
    if teams is not None:
        rules = rules.unionByName(teams)
    review_only = stored(identity.name_org_pairs(records), "resolution-names")
    matches = identity.with_methods(rules.unionByName(review_only))
    linked = matches.where("auto").select("left", "right")
    open_pairs = identity.undecided_linkage(records, linked, active).where("band <> 'drop'")
    open_pairs = stored(open_pairs, "resolution-open")  # blocking and similarities once, whatever reads them
    likely = open_pairs.where("band = 'auto'").select("left", "right", F.lit("linkage").alias("rule"), F.round("probability", 4).cast("string").alias("evidence"), F.lit("linkage").alias("method"), F.col("probability").alias("confidence"), F.lit(True).alias("auto"))
    matches = matches.unionByName(likely.select(*matches.columns))
    if verdicts is not None:
        said = identity.adjudicate(open_pairs.where("band = 'adjudicate'"), verdicts).where("verdict = 'match'")
        matches = matches.unionByName(said.select("left", "right", F.lit("adjudicated").alias("rule"), F.lit("adjudicated").alias("evidence"), F.lit("adjudicated").alias("method"), F.lit(0.90).alias("confidence"), F.lit(True).alias("auto")).select(*matches.columns))
    matches = matches.checkpoint()
    placed = identity.clusters(records, matches).checkpoint()
    fresh = identity.new_links(placed, matches, active)
    links = active.select("record_id", "person_id", F.lit("active").alias("status")).unionByName(fresh.select("record_id", "person_id", "status")).checkpoint()
    doubtful = review_only.select("left", "right", F.lit(0.85).alias("score"), F.lit("det_name_org").alias("method")).unionByName(open_pairs.where("band in ('adjudicate', 'review')").select("left", "right", F.round("probability", 4).alias("score"), F.lit("linkage").alias("method")))
    matched = matches.where("auto").select(F.explode(F.array("left", "right")).alias("record_id"))
    anchored = active.select("record_id").union(matched).distinct()
    ejected = identity.ejections(placed, links)
    return Resolution(matches, placed, fresh, identity.best_reviews(identity.reviews(doubtful, links, anchored).unionByName(ejected)), identity.golden_persons(records, links))


def connections(facts: dict[str, DataFrame], now: Column) -> DataFrame:
    """Edges of all kinds. ``facts``: kind -> (artifact, person_id, start, end)."""
    out = None
    for kind, df in facts.items():
        edges = collaboration_edges(artifact_pairs(df, "artifact", "person_id"), kind, now, "artifact")
        out = edges if out is None else out.unionByName(edges)
    return out
