"""A stored positional index for text search: queries read the postings of their own concepts only.

A posting is (canon, key, field, weight, positions of the token in the field). Postings are sorted by token and by block of
documents, with Bloom filters, so that a filter on tokens reaches the scan. A second, small table holds for each token and
block the most that it can add to a document's score there. A search for the best k scores the blocks with the largest bounds
first; their k-th score is a threshold, and of the others only blocks whose bound reaches it are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import CAP, PAIR_BONUS, alike, best_first, passes_text, snippets, tokenise, with_tokens
from tessera.operators.skew import small

DOCUMENTS_A_BLOCK = 1024
FIRST_BLOCKS = 64  # blocks that set the threshold of a search for the best


def _of_concept(concept: str, token: Column) -> Column:
    """``alike`` in a form that scans can push down: equality, a list of shorter words, a prefix."""
    words = [concept, *(concept[:n] for n in range(4, len(concept)))]
    return token.isin(words) | token.startswith(concept) if len(concept) >= 4 else token == concept


@dataclass
class TextIndex:
    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, df: DataFrame, fields: list[tuple[str, str, float]], key: str, folder: str, postings_a_file: int = 2_000_000) -> TextIndex:
        """Tokens are made once a text. A token of very many documents goes over several files, block by block."""
        keyed = with_tokens(df.select(F.col(key).alias("key"), *dict.fromkeys(c for _, c, _ in fields)), fields)
        each = keyed.select("key", F.explode("_fields").alias("f")).select("key", "f.field", "f.weight", F.posexplode("f.toks").alias("at", "t"))
        found = each.groupBy(F.col("t.canon").alias("canon"), "key", "field", "weight").agg(F.sort_array(F.collect_list("at")).alias("positions"))
        blocks = max(1, -(-df.count() // DOCUMENTS_A_BLOCK))
        placed = found.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        placed.write.parquet(f"{folder}/unsorted")
        placed = df.sparkSession.read.schema(placed.schema).parquet(f"{folder}/unsorted")
        files = max(1, -(-placed.count() // postings_a_file))
        laid = placed.repartitionByRange(files, "canon", "block").sortWithinPartitions("canon", "block", "key")
        laid.write.option("parquet.bloom.filter.enabled#canon", "true").parquet(f"{folder}/postings")
        most = placed.groupBy("canon", "block", "key").agg(F.least(F.lit(CAP), F.sum("weight")).alias("w")).groupBy("canon", "block").agg(F.max("w").alias("most"))
        most.repartitionByRange(max(1, files // 64), "canon").sortWithinPartitions("canon", "block").write.parquet(f"{folder}/bounds")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/unsorted")
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        return cls(df.sparkSession, folder)

    @staticmethod
    def _parts(query: str) -> tuple[list[str], list[tuple[str, str]]]:
        found = [c for c, _, _ in tokenise(query)]
        return list(dict.fromkeys(found)), list(zip(found, found[1:]))

    def _of(self, table: str, concepts: list[str]) -> DataFrame:
        """Rows of a table whose token is alike to a concept, one for each such concept (``c``, its number)."""
        wanted = _of_concept(concepts[0], F.col("canon"))
        for c in concepts[1:]:
            wanted = wanted | _of_concept(c, F.col("canon"))
        which = F.filter(F.array(*(F.when(alike(c, F.col("canon")), i) for i, c in enumerate(concepts))), lambda x: x.isNotNull())
        return self.spark.read.parquet(f"{self.folder}/{table}").where(wanted).withColumn("c", F.explode(which))

    def _share(self, raw: Column, concepts: list[str], pairs: list) -> Column:
        return F.round(F.least(F.lit(1.0), raw / (len(concepts) * CAP + len(pairs) * PAIR_BONUS)), 4)

    def _scores(self, postings: DataFrame, concepts: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
        hit = postings.groupBy("key", "c", "field").agg(F.max("weight").alias("weight"), F.flatten(F.collect_list("positions")).alias("at"))
        docs = hit.groupBy("key").agg(F.collect_list(F.struct("c", "field", "weight", "at")).alias("hits"))  # one a concept and field
        number = {c: i for i, c in enumerate(concepts)}
        of = lambda c: F.filter("hits", lambda h: h["c"] == number[c])
        raw = F.lit(0.0)
        for c in concepts:
            raw = raw + F.least(F.lit(CAP), F.aggregate(of(c), F.lit(0.0), lambda s, h: s + h["weight"]))
        for a, b in pairs:
            near = F.exists(of(a), lambda x: F.exists(of(b), lambda y: (x["field"] == y["field"]) & F.arrays_overlap(F.transform(x["at"], lambda p: p + 1), y["at"])))
            raw = raw + F.when(near, PAIR_BONUS).otherwise(0.0)
        return docs.select("key", self._share(raw, concepts, pairs).alias("relevance")).where("relevance > 0")

    def hits(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        """(key, relevance) of all documents that hold a concept of the query; ``allowed`` (column key) keeps some."""
        concepts, pairs = self._parts(query)
        postings = self._of("postings", concepts)
        if allowed is not None:
            postings = postings.join(allowed.select("key"), "key", "left_semi")
        return self._scores(postings, concepts, pairs)

    def best(self, query: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(key, relevance) of the best k documents, and of all others as good as the last of them."""
        concepts, pairs = self._parts(query)
        by_concept = self._of("bounds", concepts).groupBy("block", "c").agg(F.least(F.lit(CAP), F.sum("most")).alias("most"))
        bounds = by_concept.groupBy("block").agg(self._share(F.sum("most") + len(pairs) * PAIR_BONUS, concepts, pairs).alias("bound"))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        postings = self._of("postings", concepts)
        if allowed is not None:
            postings = postings.join(allowed.select("key"), "key", "left_semi")
        top = self._scores(postings.where(F.col("block").isin(first)), concepts, pairs)
        last = top.orderBy(F.desc("relevance")).limit(k).agg(F.min("relevance").alias("r"), F.count("*").alias("n")).first()
        least = last["r"] if last["n"] == k else 0.0
        more = small(bounds.where((F.col("bound") >= least) & ~F.col("block").isin(first)).select("block"))
        rest = self._scores(postings.join(more, "block", "left_semi"), concepts, pairs)
        return top.unionByName(rest).where(F.col("relevance") >= least)

    def search(self, df: DataFrame, fields: list[tuple[str, str, float]], query: str, where: Column | None = None, score: str = "final_score", key: str = "id", k: int | None = None) -> DataFrame:
        """The rows that ``operators.search.search`` gives, the first ``k`` of them if set. Texts are read for the hits only, to
        cut their snippets."""
        kept = df if where is None else df.where(where)
        if not passes_text(query):
            return kept.withColumn("relevance", F.lit(None).cast("double"))
        allowed = None if where is None else kept.select(F.col(key).alias("key"))
        found = self.hits(query, allowed) if k is None else self.best(query, k, allowed)
        hits = kept.join(found.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key")).drop("_key").orderBy(F.desc("relevance"), F.desc_nulls_last(score), key)
        hits = hits if k is None else hits.limit(k)
        return best_first(with_tokens(hits, fields).withColumn("matched", snippets(query)).drop("_fields"), score, key, kept.count() if k is None else k)
