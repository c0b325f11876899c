import hashlib
from array import array
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import test_neardup
import test_others
from tessera.llm import mixing, neardup, quality, toxicity
from tessera.llm.common import stored
from tessera.llm.queries import WORD_VOCABULARY

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = seen
        out = stored(stage(spark, docs, FOLDER), "test-stage")
        if name != "bpe":
            assert out.columns == docs.columns
        rows = out.select("doc_id").collect()
        seen = {r["doc_id"] for r in rows}
        assert seen <= before and len(rows) == len(seen)
        assert (name in ("mixing", "bpe")) <= (seen == before)
        docs = out
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(seen)


def test_run_equals_plain_python(spark):
    """Every stage again, row by row; only the fitted models are shared."""
    table, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in table.collect()]
    model = toxicity.fit(table, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    rows = [r for r in rows if test_others.brute_score(model, r[1]) < toxicity.THRESHOLD]

    good = quality.fit(table.where(F.col("doc_id").isin([r[0] for r in rows])), labels)
    rows = [r for r, (_, _, p) in zip(rows, test_others.brute_quality([(t, s, lang) for _, t, s, lang in rows], good)) if p >= quality.THRESHOLD]

    first = {i for i, _, _, kept in test_neardup.brute([r[:2] for r in rows], 5, 80) if kept}
    rows = [r for r in rows if r[0] in first]

    hashed = {r["doc_id"]: r["h"] for r in table.select("doc_id", F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string")).alias("h")).collect()}
    lines = {}
    for i, _, s, _ in rows:
        lines.setdefault(s, []).append((hashed[i], i))
    names = sorted(lines)
    weights = [Fraction(len(lines[s]) ** 0.5) for s in names]
    due = {i: slot for s, own in zip(names, test_others.brute_schedule(weights, [len(lines[s]) for s in names])) for slot, (_, i) in zip(own, sorted(lines[s]))}

    library = Tokenizer.from_file(WORD_VOCABULARY)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), due[i]))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position")) for r in got] == sorted(want, key=lambda x: x[4])


def test_run_leaves_one_table(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: {n for n in os.listdir(folder) if n.split("-")[0] in ("pipeline", "neardup", "quality", "toxicity")}
    before = held()
    corpus_pipeline.run(spark, FOLDER)
    assert len(held() - before) == 1


def test_run_follows_the_mix(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
    due = [(r["doc_id"], r["position"]) for r in mixing.mix(docs).orderBy("position").collect()]
    assert [p for _, p in due] == list(range(len(due))) and len(due) > 1
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert [(r["doc_id"], r["position"]) for r in rows] == due


def test_positions_do_not_depend_on_part_files(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "abc"[i % 7 % 3]) for i in range(500)], "doc_id long, text string, source string")
    due = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}
    shuffled = corpus_pipeline.mix_sources(spark, docs, FOLDER).repartition(5)
    rows = corpus_pipeline.encode(spark, shuffled, FOLDER).collect()
    assert [r["position"] for r in rows] == list(range(500)) and all(due[r["doc_id"]] == r["position"] for r in rows)


def test_empty_table_passes_all_stages(spark, tmp_path):
    for n in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "1 as score", "2 as position", "'x' as posterior", "3 as block", "doc_id as id")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
    assert docs.columns[-5:] == ["score", "position", "posterior", "block", "id"]
    assert {(r["score"], r["position"], r["posterior"], r["block"]) for r in docs.collect()} == {(1, 2, "x", 3)}


@pytest.mark.parametrize("module", [toxicity, quality, neardup, mixing])
def test_results_are_described(module):
    assert "Defined results" in module.__doc__


def test_names_do_not_clash(spark):
    """Columns named like the operators' own."""
    names = [f"{p}{c}" for p in ("", "_") for c in ("h", "s", "n", "b", "z", "gone", "soft", "host", "path", "rank", "row", "bucket", "before", "spread", "source_1", "key", "good", "rate", "k", "t", "id", "quality_posterior", "mix_position")]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", *(f"{i} as {n}" for i, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = docs.columns
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == before and docs.count()
    assert {r["z"] for r in docs.select("z").collect()} == {names.index("z")}


def test_ids_may_be_names(spark):
    from tessera.llm import fingerprint

    texts = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "something else altogether that is long enough"]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id string, text string")
    linked = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.link(df).collect()}
    assert linked == {"d0": ("d0", True), "d1": ("d0", False), "d2": ("d2", True), None: (None, True)}
    assert sorted(r["doc_id"] for r in neardup.keep_one(df.dropna()).collect()) == ["d0", "d2"]
    numbered = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [r[1:] for r in sorted(map(tuple, fingerprint.edited_pairs(numbered, "doc_id", "text").collect()))]
    assert [r[1:] for r in sorted(map(tuple, fingerprint.edited_pairs(df.dropna(), "doc_id", "text").collect()))] == want
