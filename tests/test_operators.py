import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import dml, graph, relational, search, validation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- keyed writes -------------------------------------------------------------------------------


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "c", None)], "id long, v string, content_hash string")
    staged = spark.createDataFrame([(2, "B", "h2x"), (1, "ignored", "h1"), (4, "d", "h4"), (3, "C", "h3")], "id long, v string, content_hash string")
    first = dml.upsert(target, staged, ["id"])
    assert rows(first.select("id", "v", "action")) == [(1, "a", "unchanged"), (2, "B", "updated"), (3, "c", "unchanged"), (4, "d", "inserted")]  # a null hash never counts as changed
    again = dml.upsert(first.drop("action"), staged.where("id <> 3"), ["id"])
    assert {r["action"] for r in again.collect()} == {"unchanged"}


def test_upsert_by_whole_rows(spark):
    schema = "id long, m map<string,int>, a array<string>"
    target = spark.createDataFrame([(1, {"x": 1}, ["p"]), (2, None, None)], schema)
    staged = spark.createDataFrame([(1, {"x": 1}, ["p"]), (2, None, ["q"]), (None, None, None)], schema)
    got = dml.upsert(target, staged, ["id"], None)
    assert sorted((r["id"] or 0, r["action"]) for r in got.collect()) == [(0, "inserted"), (1, "unchanged"), (2, "updated")]


def test_suppression_counts(spark):
    people = spark.createDataFrame([(i, f"h{i}") for i in range(6)], "id long, content_hash string")
    gone = dml.suppression_rows(people.where("id = 5"), F.lit("github"), "id")
    got = dml.upsert_counts(people.where("id < 2"), people, ["id"], suppressed=gone, key="id", source=F.lit("github")).first().asDict()
    assert got == {"staged": 6, "suppressed": 1, "inserted": 3, "updated": 0, "skipped_unchanged": 2}
    assert dml.suppress(people, gone, "id", F.lit("other")).count() == 6


def test_flips_transitions_and_erasure(spark):
    history = spark.createDataFrame([("v", 1, True), ("w", 2, True)], "k string, s long, is_latest boolean")
    out = dml.append_latest(history, spark.createDataFrame([("v", 3)], "k string, s long"), ["k"])
    assert rows(out) == [("v", 1, False), ("v", 3, True), ("w", 2, True)]
    assert rows(dml.invalidate(out, spark.createDataFrame([("w",)], "k string"), ["k"])) == [("v", 1, False), ("v", 3, True), ("w", 2, False)]
    df = spark.createDataFrame([(1, "draft", [("draft", dt.datetime(2024, 1, 1), "a")]), (2, "sent", [])], "id long, state string, history array<struct<state:string,ts:timestamp,actor:string>>")
    moved = dml.transition(df, F.lit(True), "sent", F.lit("2024-02-01").cast("timestamp"), "b", allowed=["draft"])
    assert [(r["state"], [h["state"] for h in r["history"]]) for r in moved.orderBy("id").collect()] == [("sent", ["draft", "sent"]), ("sent", [])]
    left = dml.erase({"a": history, "b": history}, {"a": ["k"]}, spark.createDataFrame([("v",)], "subject string"), "subject")
    assert left["a"].count() == 1 and left["b"].count() == 2


# ---- relational ---------------------------------------------------------------------------------


def test_typed_getters(spark):
    df = spark.createDataFrame([('{"a": true, "b": 3, "c": "x", "d": "7"}',)], "j string").select(F.parse_json("j").alias("v"))
    got = df.select(*(relational.typed(F.col("v"), f"$.{k}", t).alias(k + t) for k, t in (("a", "double"), ("b", "double"), ("c", "double"), ("a", "boolean"), ("z", "int"), ("c", "string")))).first()
    assert tuple(got) == (None, 3.0, None, True, None, "x")


def test_overlap_and_equal_pairs(spark):
    df = spark.createDataFrame([(1, ["b", "a"], "x"), (2, ["a", "b"], "x"), (3, None, None), (4, ["c"], None)], "id long, mails array<string>, o string")
    assert rows(relational.overlap_pairs(df, "id", "mails")) == [(1, 2, "a")]
    assert rows(relational.equal_pairs(df, "id", ["o"])) == [(1, 2, "x")]


def test_folds(spark):
    df = spark.createDataFrame([("g", 2, "late", ["b", "c"]), ("g", 1, None, ["a", "b"]), ("h", 1, None, None)], "k string, o long, v string, a array<string>")
    got = df.groupBy("k").agg(relational.first_known("v", "o").alias("v"), relational.ordered_union("a", "o").alias("a"))
    assert rows(got) == [("g", "late", ["a", "b", "c"]), ("h", None, [])]
    assert rows(relational.conflicts(df, "k", ["o"])) == [("g", "o", [1, 2])]


def test_fingerprint_ignores_order(spark):
    a = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert relational.fingerprint(a).first() == relational.fingerprint(a.orderBy(F.desc("id")).select("x", "id")).first()
    assert relational.fingerprint(a).first() != relational.fingerprint(a.where("id > 0")).first()


def test_fingerprint_of_any_depth(spark):
    a = spark.range(3000)
    assert relational.fingerprint(a, most=1).first() == relational.fingerprint(a.orderBy(F.desc("id")), most=1).first() != relational.fingerprint(a.where("id <> 7"), most=1).first()
    assert relational.fingerprint(a.limit(0)).count() == 1


def test_ranks_and_shares_over_ranges(spark):
    values = [(i, "ab"[i % 2] if i % 7 else None, None if i % 5 == 0 else float(i * 37 % 100)) for i in range(500)]
    df = spark.createDataFrame(values, "id long, g string, v double").repartition(7)
    ranked = relational.global_rank(df, [F.desc_nulls_last("v"), F.col("id")]).collect()
    want = sorted(values, key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
    assert [r["id"] for r in sorted(ranked, key=lambda r: r["rank"])] == [x[0] for x in want] and {r["rank"] for r in ranked} == set(range(1, 501))
    for within in ((), ("g",)):
        for r in relational.with_share(df, "v", "s", within).collect():
            peers = [v for _, g, v in values if v is not None and (not within or g == r["g"])]
            assert r["s"] == (None if r["v"] is None else sum(p <= r["v"] for p in peers) / len(peers))


def test_windows(spark):
    df = spark.createDataFrame([("r", "a", 50), ("r", "b", 30), ("r", "c", 2), ("s", "a", 3)], "repo string, login string, n long")
    assert rows(relational.core_contributors(df, "repo", "n", "login").select("repo", "login")) == [("r", "a"), ("r", "b"), ("s", "a")]
    assert rows(relational.top_members(df, "repo", "n", "login", most=2).select("repo", "login", "weight")) == [("r", "a", 0.625), ("r", "b", 0.375), ("s", "a", 1.0)]
    assert relational.leading_columns(["x_id", "y_id", "z_id", "note", "name", "score"]) == ["x_id", "y_id", "name", "score", "note"]


# ---- graphs -------------------------------------------------------------------------------------


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 500]], "id long")
    got = dict(rows(graph.components(nodes, spark.createDataFrame(edges, "a long, b long"))))
    assert {got[i] for i in range(61)} == {0} and got[102] == 100 and got[500] == 500
    assert rows(graph.components(nodes.limit(0), spark.createDataFrame([], "a long, b long"))) == []


def test_reach(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert dict(rows(graph.centrality(nodes, edges, "id", "a", "b"))) == {0: 0.6667, 1: 1.0, 2: 1.0, 3: 0.6667, 4: 0.0}
    near = graph.neighbours(edges, "a", "b")
    assert dict(rows(graph.hops(near, spark.createDataFrame([(0,)], "node long")))) == {0: 0, 1: 1, 2: 2}
    assert dict(rows(graph.degrees(nodes, edges, "id", "a", "b"))) == {0: 1, 1: 2, 2: 2, 3: 1, 4: 0}
    assert rows(graph.unresolved(nodes.where("id < 3"), edges, "id", "a", "b")) == [(2, 3)]


# ---- search -------------------------------------------------------------------------------------


def test_tokenise():
    assert [c for c, _, _ in search.tokenise("TactiSense grippers for the Zürich warehouses")] == ["tacti", "tactile", "gripper" and search.tokenise("grasp")[0][0], "zurich", "warehouse"]
    assert search.tokenise("the of a") == [] and search.stem("studies") == "study" and search.stem("speed") == "speed" and search.stem("bus") == "bus"


def test_search(spark):
    df = spark.createDataFrame(
        [(1, "Robot Arm", ["Robotics"], "Tactile skins for robots in Zürich", 80.0, "scored"), (2, "Farm Drone", ["Agri"], "A drone over crops near EPFL, EPFL and Bern", 70.0, None), (3, "Other", [], None, 60.0, "scored")],
        "id long, name string, market_tags array<string>, one_liner string, final_score double, quality_tier string",
    ).withColumn("tags", F.array_join("market_tags", " · "))
    fields = [("name", "name", 3.0), ("tags", "tags", 2.5), ("one_liner", "one_liner", 2.0)]
    hits = search.search(df, fields, "tactile robots").collect()
    assert [h["id"] for h in hits] == [1]
    assert hits[0]["relevance"] == round((2.0 + 4.5 + 1.25) / (2 * 4.5 + 1.25), 4)  # skins count as tactile, next to robots
    assert hits[0]["matched"][0]["field"] == "one_liner" and hits[0]["matched"][0]["snippet"].startswith("Tactile")
    for m in hits[0]["matched"]:
        assert all(m["snippet"][a:b] for a, b in m["ranges"])
    stored = search.with_tokens(df, fields)
    assert search.search(stored, fields, "tactile robots").select("id", "relevance").collect() == [(h["id"], h["relevance"]) for h in hits]
    assert [h["id"] for h in search.search(df, fields, "  the ").collect()] == [1, 2, 3]
    assert [h["id"] for h in search.search(df, fields, "", where=search.passes(sectors=["ROBOTICS"], min_score=75)).collect()] == [1]
    assert [h["id"] for h in search.search(df, fields, "", where=search.passes(tiers=["untiered"])).collect()] == [2]
    places = df.select("id", search.location(F.col("one_liner")).alias("p")).collect()
    assert [(r["p"] and tuple(r["p"])) for r in places] == [("Zurich", "explicit"), ("Lausanne", "inferred"), None]


# ---- validation ---------------------------------------------------------------------------------


def test_checks(spark):
    df = spark.createDataFrame([(1, "ok", 0.5, True), (1, "odd", 2.0, True), (2, None, None, False)], "id long, s string, x double, f boolean")
    checks = [validation.unique("u", df, ["id"]), validation.one_of("e", df, "s", ["ok"], "id"), validation.in_range("r", df, "x", 0, 1, "id"), validation.one_flagged("f", df, F.col("f"), ["id"]), validation.foreign_key("k", df, "id", spark.createDataFrame([(1,)], "p long"), "p"), validation.recomputed("c", df, "s", F.lit("ok"), "id")]
    assert dict(rows(validation.summary(checks, list("uerfkc") + ["none"]))) == {"u": 1, "e": 1, "r": 1, "f": 1, "k": 1, "c": 2, "none": 0}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_heavy_keys_are_not_broadcast(spark):
    """Copies of heavy rows look as small as the rows; they must not go through the driver."""
    from tessera.operators.skew import heavy_keys, join_split

    rows = spark.range(2_000).selectExpr("id", "id % 4 as k")
    found = join_split(rows, rows.selectExpr("k", "id as other"), "k", "id", heavy_keys(rows, "k"))
    assert _plan(found).count("SortMergeJoin") == 1 and found.count() == 4 * 500 * 500


def test_records_of_pairs_are_not_broadcast(spark):
    from tessera.operators import identity

    held = "record_id string, name_norm string, email_norms array<string>, org_norm string, country_code string, keywords array<string>"
    r = spark.createDataFrame([("a", "x y", ["x@y"], "o", "CH", ["k"]), ("b", "x z", None, "o", None, None)], held)
    pairs = spark.createDataFrame([("a", "b")], "left string, right string")
    assert "Broadcast" not in _plan(identity.compare(pairs, r)) and identity.compare(pairs, r).count() == 1
    linked = spark.createDataFrame([], "left string, right string")
    active = spark.createDataFrame([("a", "p")], "record_id string, person_id string")
    open_ = identity.undecided(pairs, r, linked, active)
    assert _plan(open_).count("SortMergeJoin") >= 2 and open_.count() == 1


def test_graphs_of_groups_equal_graphs_of_pairs(spark):
    members = spark.createDataFrame([(i, g) for i in range(60) for g in {i // 7, 100 + i * i % 23, None if i % 5 else 200}], "node long, g long")
    nodes = spark.range(70).withColumnRenamed("id", "node")
    groups = graph.memberships(members, "node", ["g"])
    edges = relational.equal_pairs(members, "node", ["g"]).select(F.col("left").alias("a"), F.col("right").alias("b"))
    near = graph.neighbours(edges, "a", "b")
    targets = nodes.where("node in (3, 40, 65)")
    assert rows(graph.hops_by_groups(groups, targets)) == rows(graph.hops(near, targets))
    assert rows(graph.degrees_by_groups(nodes, groups, "node")) == rows(graph.degrees(nodes, edges, "node", "a", "b"))
    assert rows(graph.centrality_by_groups(nodes, groups, "node")) == rows(graph.centrality(nodes, edges, "node", "a", "b"))


def test_a_large_group_makes_no_pairs(spark):
    """Its 5 billion pairs would not end."""
    groups = graph.memberships(spark.range(100_000).selectExpr("id", "1 as g"), "id", ["g"])
    nodes = spark.range(100_001)
    assert {r["degree"] for r in graph.degrees_by_groups(nodes, groups, "id").collect()} == {99_999, 0}
    assert {r["centrality"] for r in graph.centrality_by_groups(nodes, groups, "id").collect()} == {1.0, 0.0}
    assert graph.hops_by_groups(groups, spark.createDataFrame([(5,)], "node long")).where("hops = 1").count() == 99_999


def test_first_matches_are_matches_and_connect_the_same(spark):
    """One row a member gives the same components and the same first match of every record as all pairs do."""
    from tessera.operators import identity

    def row(i):
        shared = [f"m{j}" for j in {i % 9, i * i % 13, i // 4} if (i + j) % 3]
        site = f"github.com/g{i * 5 % 6}" if i % 3 == 0 else f"s{i % 7}" if i % 3 == 1 else None
        return (f"r{i:03}", shared, f"o{i % 17}" if i % 4 == 0 else None, f"g{i % 6}" if i % 2 == 0 else None, site, f"https://linkedin.com/in/u{i // 6}" if i % 5 == 0 else None, f"t{i % 8}" if i % 7 == 0 else None)

    r = spark.createDataFrame([row(i) for i in range(60)], "record_id string, email_norms array<string>, orcid string, github_login string, website_url_norm string, linkedin_url string, twitter_handle string")
    every, few = (identity.with_methods(identity.identifier_rules(r, every_pair=e)) for e in (True, False))
    assert set(rows(few.select("left", "right", "rule"))) <= set(rows(every.select("left", "right", "rule")))
    assert rows(identity.best_incident(few)) == rows(identity.best_incident(every))
    linked = [m.select(F.col("left").alias("a"), F.col("right").alias("b")) for m in (every, few)]
    whole, star = (rows(graph.components(r, x, "record_id")) for x in linked)
    assert whole == star


def test_reviews_in_groups_equal_reviews_of_pairs(spark):
    """Persons with several records in a group, anchored and not, and ties of scores; pairs are neither grouped nor shuffled."""
    from tessera.operators import identity

    r = spark.createDataFrame([(f"r{i:03}", f"p{i * i % 23}" if i % 11 else None, f"o{i % 3}" if i % 7 else None, i) for i in range(120)], "record_id string, person_id string, org_norm string, n long")
    anchored = r.where("n % 4 = 1").select("record_id").unionByName(r.where("n = 5").select("record_id"))
    score = lambda a, b: F.round((a("n") * 3 + b("n")) % 10 / 10, 2)
    method = lambda a, b: F.when(a("n") % 2 == 0, "x").otherwise("y")
    pairs = relational.equal_pairs(r, "record_id", ["org_norm"]).join(r.selectExpr("record_id as left", "n as a"), "left").join(r.selectExpr("record_id as right", "n as b"), "right")
    pairs = pairs.select("left", "right", score(lambda _: F.col("a"), lambda _: F.col("b")).alias("score"), method(lambda _: F.col("a"), lambda _: F.col("b")).alias("method"))
    got = identity.reviews_in_groups(r, ["org_norm"], anchored, score, method)
    want = identity.reviews(pairs, r.select("record_id", "person_id"), anchored)
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 500
    plan = _plan(got)
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")]


def test_rows_of_a_group_are_copied_to_as_many_parts_as_it_needs(spark):
    """A group of 1,200 rows needs 3 parts, not 64: its copies are what reviews shuffle and keep on disk."""
    from tessera.operators import skew

    rows_ = spark.range(1_200).selectExpr("id", "id % 2 as k").withColumn("k", F.when(F.col("id") < 1_150, 7).otherwise(F.col("k")))
    heavy, dealt = skew.heavy_keys(rows_, "k"), skew.parts_of_pairs(1_150)
    assert [skew.parts_of_pairs(n) for n in (0, 1, 500, 501, 10**9)] == [1, 1, 1, 2, skew.PARTS] and dealt == 3
    assert skew.copied_rows(rows_, "k", heavy, dealt) == 1_200 + 2 * 1_150
    assert skew.join_split(rows_, rows_.selectExpr("k", "id as other"), "k", "id", heavy, dealt=dealt).count() == 1_150**2 + 2 * 25**2


def test_pairs_by_handles_are_not_grouped(spark):
    """Each pair once with its smallest evidence, whichever of three ways finds it, without a group a pair."""
    from tessera.operators import identity

    made = [(f"r{i:03}", f"t{i % 5}" if i % 3 == 0 else None, f"u{i * 7 % 9}" if i % 4 else None, f"u{i * i % 11}" if i % 5 else None) for i in range(90)]
    got = identity._handle_pairs(spark.createDataFrame(made, "record_id string, t string, h string, w string"))
    want = {}
    for a, t1, h1, w1 in made:
        for b, t2, h2, w2 in made:
            said = [x for x, y in ((t1, t2), (h1, w2), (h2, w1)) if x is not None and x == y]
            if a < b and said:
                want[a, b] = min(said)
    assert rows(got) == sorted((a, b, e) for (a, b), e in want.items()) and {e[0] for e in want.values()} == {"t", "u"}
    plan = _plan(got)
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")]


def test_tasks_take_a_bounded_number_of_rows(spark):
    from tessera.operators import skew

    df = spark.range(1_000).selectExpr("id", "id % 100 as k")
    assert skew.in_parts(df, ["k"], 1_000, 100).rdd.getNumPartitions() == 10
    assert skew.in_parts(df, ["k"], 1_000).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert skew.copied_rows(df, "k", spark.createDataFrame([(3,), (200,)], "k long")) == 1_000 + 10 * (skew.PARTS - 1)


def test_texts_of_a_small_file_are_searched_once_in_many_tasks(spark, monkeypatch):
    """Rows are dealt before the search and before the sort, which reads its rows twice."""
    df = spark.range(1_000).selectExpr("id", "if(id % 3 = 0, 'tactile robots', 'x') as name", "1.0D as final_score").coalesce(1)
    fields = [("name", "name", 3.0)]
    want = [tuple(r) for r in search.search(df, fields, "tactile robots").collect()]
    monkeypatch.setattr(search, "TEXTS", 100)
    hits = search.search(df, fields, "tactile robots")
    plan = _plan(hits)
    assert plan.count("ArrowEvalPython") == 1 and plan.count("REPARTITION_BY_NUM") == 2
    assert plan.index("rangepartitioning") < plan.index("REPARTITION_BY_NUM") < plan.index("ArrowEvalPython") < plan.rindex("REPARTITION_BY_NUM")
    assert [tuple(r) for r in hits.collect()] == want and len(want) == 334


def test_shared_counts_are_grouped_in_tasks_of_bounded_rows(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    from tessera.operators import skew

    made = [(g, i * i % 97) for i in range(600) for g in (i // 4, i // 4, 900 if i % 2 else None)]
    want = Counter(p for g in {g for g, _ in made if g is not None} for p in combinations(sorted({i for h, i in made if h == g}), 2))
    members = spark.createDataFrame(made, "g long, i long")
    for most in (skew.PART_ROWS, 100):
        monkeypatch.setattr(skew, "PART_ROWS", most)
        edges, pairs = relational.shared_counts(members, "g", "i")
        assert {(a, b): n for a, b, n in rows(edges)} == want and pairs == sum(want.values())
    assert f", {-(-pairs // 100)}), REPARTITION_BY_NUM" in _plan(edges)


def test_constraints_are_checked_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Keys are neither gathered before they are dealt nor sorted, and a child's heavy key is no burden."""
    from tessera.operators import skew

    monkeypatch.setattr(skew, "PART_ROWS", 100)
    child = spark.range(1_000).selectExpr("id", "case when id % 2 = 0 then -1 when id % 10 = 1 then null else id % 300 end as p")
    parent = spark.range(200).selectExpr("if(id = 7, null, id) as k").unionByName(spark.range(50).selectExpr("id as k"))
    lost, twice = validation.foreign_key("f", child, "p", parent, "k"), validation.unique("u", child, ["p"])
    plan, plan_twice = _plan(lost), _plan(twice)
    want = [p for p in (-1 if i % 2 == 0 else None if i % 10 == 1 else i % 300 for i in range(1_000)) if p is not None and not 0 <= p < 200]
    assert sorted(r["key"] for r in lost.collect()) == sorted(map(str, want))
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert sorted(r["key"] for r in twice.collect()) == sorted({"", *(str(p) for p in (-1, *range(300)) if sum((-1 if i % 2 == 0 else None if i % 10 == 1 else i % 300) == p for i in range(1_000)) > 1)})
    assert plan_twice.rindex("HashAggregate") < plan_twice.index("REPARTITION_BY_NUM")
