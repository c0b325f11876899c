"""Whom to contact and what to ask, and what an interview changes: joins and ranks, no state of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.documents import uncited
from tessera.functions.ids import content_hash, key_hash
from tessera.operators.dml import append_latest
from tessera.operators.relational import alias_lookup


def forbidden(persons: DataFrame, outreach: DataFrame, links: DataFrame, records: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Persons who must not be contacted: opted out, or an active source key of theirs is suppressed (source, key_hash)."""
    out = outreach.where("status = 'opted_out'").select("person_id")
    keys = records.select("record_id", "source", key_hash(F.col("source_key")).alias("key_hash")).join(suppressed, ["source", "key_hash"], "left_semi")
    held = links.where("status = 'active'").join(keys, "record_id", "left_semi").select("person_id")
    return persons.select("person_id").join(out.union(held).distinct(), "person_id", "left_semi")


def founders(team: DataFrame, persons: DataFrame) -> DataFrame:
    """The contact of each venture: founders first, then by weight; the first who has an address."""
    known = team.join(persons.where("primary_email is not null").select("person_id", F.col("primary_email").alias("to_email")), "person_id")
    w = Window.partitionBy("venture_id").orderBy(F.coalesce("is_founder_guess", F.lit(False)).desc(), F.coalesce("weight", F.lit(0.0)).desc(), "person_id")
    return known.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def question_plan(gaps: DataFrame) -> DataFrame:
    """(venture_id, questions): the open questions, the most important first."""
    asked = gaps.where("question_text is not null").groupBy("venture_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("importance", F.lit(0.0))).alias("i"), "question_text"))).alias("q"))
    return asked.select("venture_id", F.transform("q", lambda x: x["question_text"]).alias("questions"))


def new_interviews(interviews: DataFrame, runs: DataFrame) -> DataFrame:
    """Interviews (interview_id, venture_id, extracted as JSON text) whose fingerprint no finished run has: repeats are skipped."""
    marked = interviews.withColumn("fingerprint", F.sha2(F.concat_ws(":", "venture_id", "interview_id", content_hash(F.col("extracted"))), 256))
    return marked.join(runs.where("status = 'ok'").select("fingerprint"), "fingerprint", "left_anti")


def raised_school_tiers(features: DataFrame, interviews: DataFrame, institutions: DataFrame) -> DataFrame:
    """Features with the best school tier that an interview names, where it is higher. institutions: name, aliases, score."""
    named = interviews.select("person_id", F.explode(F.from_json(F.get_json_object("extracted", "$.education"), "array<struct<institution:string>>")).alias("e"))
    tiers = alias_lookup(named.select("person_id", F.lower("e.institution").alias("_i")), "_i", institutions, "score", -1.0).where("score >= 0").groupBy("person_id").agg((F.max("score") / 100).alias("_tier"))
    old = F.coalesce(F.col("features")["school_tier"], F.lit(0.0))
    kept = F.map_filter("features", lambda k, _: k != "school_tier")
    raised = F.map_concat(kept, F.create_map(F.lit("school_tier"), F.greatest(old, F.col("_tier"))))
    everyone = features.join(tiers, "person_id", "full").withColumn("features", F.coalesce("features", F.create_map().cast("map<string,double>")))
    return everyone.select("person_id", F.when(F.col("_tier").isNull(), F.col("features")).otherwise(raised).alias("features"))


def interview_gate(tokens: DataFrame, interviews: DataFrame, now: Column) -> DataFrame:
    """Interviews whose token's hash is asked for (column ``token``), with ``gate``: expired, closed, needs_consent or ready."""
    asked = tokens.select(key_hash(F.col("token")).alias("token_hash")).distinct()
    gate = F.when(F.col("expires_at") <= now, "expired").when(F.col("status") != "open", "closed").when(F.col("consent_at").isNull(), "needs_consent").otherwise("ready")
    return interviews.join(asked, "token_hash").withColumn("gate", gate)


def memo_rows(answers: DataFrame, repaired: DataFrame, history: DataFrame) -> DataFrame:
    """The memo history with a new latest row for each venture whose memo holds: every bullet cites a source or names its
    gap. ``answers`` and ``repaired``: venture_id, memo_id, memo as JSON text; a repaired memo counts where the first does not hold."""
    good = lambda df: df.where(F.size(uncited(F.try_parse_json("memo"))) == 0)
    first = good(answers)
    second = good(repaired).join(first.select("venture_id"), "venture_id", "left_anti")
    return append_latest(history, first.unionByName(second), ["venture_id"])


def confirmed_traction(interviews: DataFrame) -> DataFrame:
    """Ventures whose interview claims traction."""
    claims = F.from_json(F.get_json_object("extracted", "$.traction_claims"), "array<string>")
    return interviews.where(F.size(claims) > 0).select("venture_id").distinct()


def revised(table: DataFrame, row: DataFrame, key: str, version: str) -> DataFrame:
    """A table with one row replaced and its version counted up."""
    top: Column = F.coalesce(F.max(version), F.lit(0)) + 1
    new = row.drop(version).crossJoin(table.join(row.select(key), key, "left_semi").agg(top.alias(version)))
    return table.join(row.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))
