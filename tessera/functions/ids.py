"""Deterministic ids and hashes, all on the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of this engine's ids; give another where ids must agree with those of another store.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tessera.example")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version-5 UUID of a text: SHA-1 of namespace and text, version and variant put in place."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def record_id(source: Column, key: Column) -> Column:
    return uuid5(F.concat(source, F.lit(":"), key.cast("string")))


def entity_id(kind: str, key: Column) -> Column:
    """Id of an entity of a kind (a repository, a company, an anchor) by its natural key."""
    return uuid5(F.concat(F.lit(kind + ":"), key.cast("string")))


def publication_id(doi: Column, paper: Column, work: Column) -> Column:
    """DOI first, then the preprint id, then the catalogue id; null when none is known."""
    return uuid5(F.coalesce(doi, F.concat(F.lit("arxiv:"), paper), work))


def joined_id(*parts: Column) -> Column:
    """Id of a fact by the ids (and roles) that it joins."""
    return uuid5(F.concat(*parts))


def pair_id(a: Column, b: Column) -> Column:
    """One id for both orders of a pair."""
    return uuid5(F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b)))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces."""
    return F.to_json(F.parse_json(c))


def content_hash(c: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(c), 256)


def key_hash(c: Column) -> Column:
    """SHA-256 of a key's text, as suppression tables hold it."""
    return F.sha2(c.cast("string"), 256)


def random_id() -> Column:
    """A random UUID; never used where a result must be repeatable."""
    return F.uuid()
