"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, centroids, chat, exact, fingerprint, html, mixing, negatives, neardup, quality, tiff, toxicity, warc
from tessera.llm.common import table

#: The tokenizer file that the encoding queries use.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"), html.model(), ["page_id", "url"])


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as TIFF payloads, stored, read back and described."""
    return tiff.text_media(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, then read back through the index."""
    pages = table(spark, sf_dir, "pages")
    volumes = warc.write_archive(pages, "page_id", "url", "html")
    index = warc.write_index(volumes)
    return warc.read_back(volumes, index, warc.index_keys(pages, "page_id", "url")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base 32 from its hexadecimal form, five bits a letter.
_BASE32 = """list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(5), lambda b: (((('0x' || substr(hex, 1 + (i * 5 + b) // 4, 1))::INTEGER >> (3 - (i * 5 + b) % 4)) & 1) << (4 - b))))::INTEGER, 1)), lambda x, y: x || y)"""

OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
m AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h JOIN m USING (hex)
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to ids of a public vocabulary and back."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", WORD_VOCABULARY)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates: three-word shingles, similarity of 0.85 or more."""
    return neardup.link(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, percent=85)


OP5_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * shared >= 85 * (n + m - shared)),
t AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.y, r.low FROM r JOIN t ON t.x = r.id WHERE r.low < t.y),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document: sources are its hosts, their languages the paths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, F.col("source"), F.col("lang"), keep=["doc_id"])
    return scored.select("doc_id", "evidence", "site_rate", "posterior", (F.col("posterior") >= quality.THRESHOLD).alias("kept"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and of their edited forms."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix: weights in proportion to the root of a source's documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; rows whose checksum mod 3 is 1 are held out from fitting."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes, linked to what they answer and in reply order."""
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of texts that differ in white space only."""
    return exact.mark(table(spark, sf_dir, "documents"), "doc_id", "text")


OP11_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components after ten rounds."""
    return centroids.with_digest(*centroids.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def _op13_sql(rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after another: nearest centroids, then exact floors of their sums."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS b FROM v, c{i} GROUP BY vec_id, v)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(x.m, o.m) AS m FROM c{i} o LEFT JOIN m{i} x ON x.c = o.c)""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON c{rounds}.c = b.c"""


OP13_SQL = _op13_sql()


def queries() -> dict:
    return {f.__name__: f for f in (op1_html, op2_tiff_media, op3_warc, op4_bpe, op5_neardup, op6_quality, op7_syncmers, op8_mixing, op9_toxicity, op10_chat, op11_exact, op12_negatives, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_neardup": OP5_SQL, "op11_exact": OP11_SQL, "op12_negatives": OP12_SQL, "op13_centroids": OP13_SQL}
