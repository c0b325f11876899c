"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

1. A text's words (A-Z lower-cased) give its set of distinct word shingles. Texts with equal sets form a class; from
   there on only class representatives take part.
2. A representative's signature has ``SYMBOLS`` b-bit values a chunk. By the pigeonhole principle two signatures
   that differ in fewer than twice as many places as there are chunks agree, in some chunk, up to one place. Each
   chunk is therefore indexed under every choice of one left-out place, so all such pairs meet in a bucket. The number
   of chunks is the least that leaves a pair at the threshold unmet with a probability below MISS.
3. A bucket's pairs are never listed. Its members are compared with its hub, the member that meets most others over all
   buckets. Links are confirmed on full sets.
4. Buckets that then still hold several components are settled exactly: members outside a bucket's largest
   component meet those members of other components that share one of their rarest shingles and are of a like size
   (prefix, position and length filters), and those pairs are confirmed on full sets.
5. Components come from random contraction (``operators.graph``), whose tables shrink each round.

Buckets, classes, labels and nodes with a large part of all rows are split over tasks. Only the result stays in the
shared folder.

Defined results: texts without words have empty sets, are linked with nothing and are components of their own;
fewer words than a shingle make one shingle; rows that share an id are one document, linked by each of its
texts; a row without id gets no component (null) and is kept; ids that are not whole numbers are ordered as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import absent, drop_stored, is_whole, map_rows, shared_dir, stored, with_numbers
from tessera.operators import graph
from tessera.operators.skew import HEAVY_KEYS, HEAVY_ROWS, heavy_keys, join_split

SYMBOLS, BITS = 6, 16  # values in a chunk, bits of a value
MISS = 1e-6
SALTS = 32  # parts that the members of a class are dealt into
BROADCAST_IDS = 500_000  # ids sent to all workers up to here, else joined by a shuffle

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _F1
    x = (x ^ (x >> _S33)) * _F2
    return x ^ (x >> _S33)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""
    found = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    out = h[: n - words + 1].copy()
    for k in range(1, words):
        out = (out ^ (out >> _S33)) * _M1 + h[k : n - words + 1 + k]
    return np.unique(_mix(out))


def chunks_for(percent: int) -> int:
    """The least number of chunks such that a pair at the threshold meets in none of them with probability below MISS."""
    s = percent / 100
    alone = 1 - s**SYMBOLS - SYMBOLS * (1 - s) * s ** (SYMBOLS - 1)
    m = 1
    while alone**m >= MISS:
        m += 1
    return m


def distance_bound(chunks: int) -> int:
    """Signatures that differ in at most so many places meet for certain."""
    return 2 * chunks - 1


def signature(hashes: np.ndarray, places: int) -> bytes:
    """``places`` b-bit minima of a set."""
    rng = np.random.default_rng(20240501)
    odd = rng.integers(0, 2**63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, places, dtype=np.uint64)
    low = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048]
        low = np.minimum(low, ((part[None, :] ^ flip[:, None]) * odd[:, None]).min(axis=1))
    return (_mix(low) >> np.uint64(64 - BITS)).astype(np.uint16).tobytes()


def chunk_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """Keys of all chunks with each place left out in turn: rows x (chunks * SYMBOLS)."""
    rng = np.random.default_rng(20240502)
    values = signatures.reshape(len(signatures), chunks, SYMBOLS).astype(np.uint64) + np.uint64(1)
    out = np.empty((len(signatures), chunks, SYMBOLS), np.uint64)
    for left_out in range(SYMBOLS):
        odd = rng.integers(0, 2**63, (chunks, SYMBOLS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        odd[:, left_out] = 0
        salt = np.uint64(0x51ED270B) * (np.arange(chunks, dtype=np.uint64) * np.uint64(SYMBOLS) + np.uint64(left_out + 1))
        out[:, :, left_out] = _mix((_mix(values * odd[None]) * (odd[None] | np.uint64(1))).sum(axis=2, dtype=np.uint64) + salt[None])
    return out.reshape(len(signatures), chunks * SYMBOLS)


# ---- stages -----------------------------------------------------------------------------------


def signatures(docs: DataFrame, key: str, text: str, words: int, chunks: int) -> DataFrame:
    """(id, n, class, sig): size, digest and signature of each text's set. Texts without words have no class."""
    places = chunks * SYMBOLS

    def rows(parts):
        for part in parts:
            n, classes, sigs = [], [], []
            for t in part["t"]:
                s = shingle_set(t, words)
                n.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, places) if len(s) else None)
            yield [part["k"], n, classes, sigs]

    keyed = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    return map_rows(keyed, "id long, n long, class binary, sig binary", rows)


def index_rows(representatives: DataFrame, chunks: int) -> DataFrame:
    """(key, id) for each chunk and left-out place."""

    def rows(parts):
        for part in parts:
            if part["id"]:
                sigs = np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part["id"]), -1)
                keys = chunk_keys(sigs, chunks)
                yield [keys.view(np.int64).ravel(), np.repeat(np.array(part["id"], np.int64), keys.shape[1])]

    return map_rows(representatives.select("id", "sig"), "key long, id long", rows)


def _within(a: str, b: str, inter: str, percent: int):
    return F.expr(f"100 * {inter} >= {percent} * ({a} + {b} - {inter})")


def sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """(id, class, n, set) of the texts whose id and class are in ``wanted``, repeated rows as often as they
    are there. The ids go to all workers only when they are few."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keyed = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("t")).join(F.broadcast(wanted) if few else wanted, "id")

    def rows(parts):
        for part in parts:
            out = []
            for i, t, c in zip(part["id"], part["t"], part["class"]):
                data = (s := shingle_set(t, words)).tobytes()
                if xxhash.xxh3_128_digest(data) == c:
                    out.append((i, c, len(s), data))
            yield list(zip(*out)) if out else [[] for _ in range(4)]

    return map_rows(keyed.select("id", "t", "class"), "id long, class binary, n long, set binary", rows)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. A hub is in very many pairs, which are dealt over tasks, so that no
    task holds its set that often. ``pairs`` are a stored table."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))

    def rows(parts):
        for part in parts:
            a, b = [], []
            for i, j, x, y in zip(part["a"], part["b"], part["set_a"], part["set_b"]):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int(np.count_nonzero(t[at] == s))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a.append(i)
                    b.append(j)
            yield [a, b]

    half = join_split(pairs, left, "a", "b", heavy_keys(pairs, "a"))
    return map_rows(join_split(half, right, "b", "a", heavy_keys(pairs, "b")).select("a", "b", "set_a", "set_b"), "a long, b long", rows)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable."""
    shared_dir(nodes.sparkSession)
    return graph.components(nodes, edges).withColumnRenamed("component", "label")


def _prefix_rows(sets: DataFrame, df: DataFrame, percent: int) -> DataFrame:
    """(s, id, n, pos): the rarest shingles of each set that a partner must share one of, by ascending frequency."""
    exploded = explode_sets(sets).join(df, "s")
    ranked = exploded.groupBy("id", "class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("all"))
    keep = F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 as int)")
    return ranked.select("id", "n", F.posexplode(F.slice("all", F.lit(1), keep)).alias("pos", "x")).select(F.col("x.s").alias("s"), "id", "n", "pos")


def explode_sets(sets: DataFrame) -> DataFrame:
    """(id, class, n, s): one row a shingle."""

    def rows(parts):
        for part in parts:
            for i, c, n, x in zip(part["id"], part["class"], part["n"], part["set"]):
                yield [np.full(n, i, np.int64), [c] * n, np.full(n, n, np.int64), np.frombuffer(x, np.int64)]

    return map_rows(sets.select("id", "class", "n", "set"), "id long, class binary, n long, s long", rows)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id, kept."""
    if not is_whole(docs, key):
        ranked, ids = with_numbers(docs.select(key, text), key)
        linked = link(ranked, key, text, words, percent)
        a, b = (ids.select(F.col("rank").alias(c), F.col("id").alias(f"{c}_id")) for c in ("k", "component"))
        named = linked.toDF("k", "n_shingles", "component", "kept").join(a, "k", "left").join(b, "component", "left")
        return named.select(F.col("k_id").alias(key), "n_shingles", F.col("component_id"), "kept")
    chunks = chunks_for(percent)
    signed = stored(signatures(docs, key, text, words, chunks), "neardup-signatures")
    classes = signed.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.count("*").alias("copies"))
    reps = stored(classes, "neardup-classes")

    # Buckets with more than one member, and what their members meet.
    index = index_rows(reps.select(F.col("rep").alias("id"), "sig"), chunks)
    shared = stored(index.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key", "size"), "neardup-shared")
    # Fewer than HEAVY_KEYS buckets can be so large.
    total = shared.agg(F.sum("size").alias("n")).first()["n"] or 0
    heavy = shared.where(F.col("size") > max(HEAVY_ROWS, total // HEAVY_KEYS)).select("key")
    met = stored(join_split(index, shared, "key", "id", heavy), "neardup-buckets")
    mass = met.groupBy("id").agg(F.sum("size").alias("mass"))
    hubs = met.join(mass, "id").groupBy("key").agg(F.max(F.struct("mass", (-F.col("id")).alias("minus"))).alias("h")).select("key", (-F.col("h.minus")).alias("hub"))
    pairs = stored(join_split(met, hubs, "key", "id", heavy).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "neardup-pairs")

    # Full sets of the representatives that met others. An id may stand for several classes (rows that share an id).
    wanted = reps.select(F.col("rep").alias("id"), "class").join(met.select("id").distinct(), "id", "left_semi")
    sets = stored(sets_of(docs, key, text, wanted, words), "neardup-sets")
    first = stored(confirm(pairs, sets, percent), "neardup-links")
    labels = stored(components(met.select("id"), first), "neardup-labels")

    # Buckets that hold several components still: their smaller parts against the rest, by the rarest shingles.
    placed = met.select("key", "id").join(labels, "id")
    mixed = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    among = join_split(placed, mixed, "key", "id", heavy)
    sizes = among.groupBy("key", "label").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("main"))
    role = stored(join_split(among, largest, "key", "id", heavy).groupBy("id", "label").agg(F.max(F.col("label") != F.col("main")).alias("active")), "neardup-rest")
    rest = sets.join(role, "id", "left_semi").dropDuplicates(["id", "class"])
    df = explode_sets(rest).groupBy("s").agg(F.count("*").alias("df"))
    prefix = stored(_prefix_rows(rest, df, percent).join(role, "id"), "neardup-prefixes")
    # Sets that are alike enough are of one size band or of neighbouring ones.
    size = F.log(F.col("n").cast("double")) / log(100 / percent)
    x = prefix.select(F.struct("s", F.floor(size).alias("band")).alias("k"), "id", "n", "pos", "label")
    bands = F.explode(F.sequence(F.floor(size - 1 - 1e-6), F.floor(size + 1 + 1e-6)))
    y = prefix.where("active").withColumn("band", bands).select(F.struct("s", "band").alias("k"), *(F.col(c).alias(f"{c}_2") for c in ("id", "n", "pos", "label")))
    need = f"ceil({percent} * (n + n_2) / {100.0 + percent})"
    # A shingle that very many prefixes share is met in many tasks.
    more = join_split(x, y, "k", "id", heavy_keys(x, "k")).where((F.col("label") != F.col("label_2")) & F.expr(f"100 * n >= {percent} * n_2 and 100 * n_2 >= {percent} * n and 1 + least(n - pos - 1, n_2 - pos_2 - 1) >= {need}"))
    close = stored(more.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct(), "neardup-close")
    second = confirm(close, sets, percent)

    # Components of representatives, then of all ids.
    apart = components(reps.select(F.col("rep").alias("id")).distinct(), first.union(second))
    final = stored(_with_members(apart, reps, signed), "neardup-components")
    label = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    out = stored(signed.select("id", "n").join(final, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept")), "neardup-result")
    for done in (signed, reps, shared, met, pairs, sets, first, labels, role, prefix, close, final):
        drop_stored(done)
    return out


def _with_members(labels: DataFrame, reps: DataFrame, signed: DataFrame) -> DataFrame:
    """Labels of class members from their representatives. An id in several classes joins their components. The join is
    salted, since one class may hold a third of all rows; only classes with copies take part."""
    classes = reps.where("copies > 1").select("class", F.col("rep").alias("id")).join(labels, "id").select("class", "label", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    members = signed.where("class is not null and id is not null").select("id", "class", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    spread = members.join(classes, ["class", "salt"]).select("id", "label")
    everyone = labels.unionByName(spread)
    twice = everyone.groupBy("id").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    joined = twice.where("a <> b").select("a", "b")
    if joined.limit(1).count() == 0:
        return twice.select("id", F.col("a").alias("label"))
    again = components(labels.select(F.col("label").alias("id")).distinct(), everyone.join(twice, "id").where("a <> b").select("a", F.col("label").alias("b")).distinct())
    return twice.join(again.select(F.col("id").alias("a"), F.col("label").alias("to")), "a").select("id", F.col("to").alias("label"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id."""
    name = absent(docs, "_gone")
    gone = stored(link(docs, key, text, words, percent).where("not kept").select(F.col(key).alias(name)).distinct(), "neardup-gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone[name], "left_anti")
