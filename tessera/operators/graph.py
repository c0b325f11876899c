"""Graphs as edge tables: components, collaboration edges, reach."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import edge_decay
from tessera.operators.skew import HEAVY_KEYS, HEAVY_ROWS, heavy_keys, join_split
from tessera.operators.order import running_total
from tessera.operators.storage import drop, shared_folder, stored

REMNANT = 50_000  # edges (each both ways) that one task settles


def ensure_checkpoint_folder(df: DataFrame) -> None:
    """Checkpoints go to the folder that driver and executors share."""
    shared_folder(df.sparkSession)


def _by_degree(left: DataFrame, right: DataFrame, key: str, by: str, heavy: DataFrame | None) -> DataFrame:
    return left.join(right, key) if heavy is None else join_split(left, right.select(*right.columns), key, by, heavy.toDF(key))


def _settled(edges: DataFrame) -> DataFrame:
    """(x, to) of at most REMNANT edges: the smallest node reachable, by merging sets in one task."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        up = {x: x for x in part["x"]}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in zip(part["x"], part["y"]):
            x, y = sorted((top(x), top(y)))
            up[y] = x
        return pd.DataFrame({"x": list(up), "to": [top(x) for x in up]})

    kind = edges.schema["x"].dataType.simpleString()
    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merge, f"x {kind}, to {kind}")


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable.

    Random contraction: each round orders the nodes anew by a hash, every node goes to the first node within two hops, and
    edges are rewritten between those. Whatever the graph, at most three quarters of the nodes are expected to be left
    after a round (a third on a path, one of a star), so rounds grow with the logarithm of the nodes, and tables shrink
    as fast. What is left of them is settled in one task once it has at most REMNANT edges, whatever the graph was. Labels
    then go back through the rounds. Every table is stored; nothing is collected. Nodes of very many edges are split over
    tasks."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    left = stored(both.union(both.select(F.col("y"), F.col("x"))).distinct(), "components-edges")
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while total := left.count():
        if total <= REMNANT:
            chosen, moved, around = stored(_settled(left), "components-round"), left.where("false"), None
        else:
            place = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
            around = stored(left.groupBy("x").agg(F.min(place("y")).alias("m"), F.count("*").alias("n")).select("x", F.least("m", place("x")).alias("m"), "n"), "components-around")
            heavy = around.where(F.col("n") > max(HEAVY_ROWS, total // HEAVY_KEYS)).select("x")
            heavy = None if heavy.isEmpty() else heavy
            first = _by_degree(left, around.select(F.col("x").alias("y"), "m"), "y", "x", heavy).groupBy("x").agg(F.min("m").alias("m"))
            chosen = stored(first.select("x", F.col("m.v").alias("to")), "components-round")
            moved = _by_degree(left, chosen.withColumnRenamed("to", "u"), "x", "y", heavy)
            moved = _by_degree(moved, chosen.select(F.col("x").alias("y"), F.col("to").alias("v")), "y", "x", heavy).where("u <> v")
            moved = moved.select(F.col("u").alias("x"), F.col("v").alias("y")).distinct()
        lows = chosen.withColumn("low", F.col("x")) if not rounds else chosen.join(rounds[-1][1].select(F.col("to").alias("x"), "low"), "x")
        low = stored(lows.groupBy("to").agg(F.min("low").alias("low"), F.count("*").alias("n")), "components-low")
        rounds.append((chosen, low))
        left, before = stored(moved, "components-edges"), left
        drop(before, *([around] if around else []))
    drop(left)
    labels = None
    for chosen, low in reversed(rounds):
        known = low.select("to", "low") if labels is None else low.join(labels.withColumnRenamed("x", "to"), "to", "left").select("to", F.coalesce("label", "low").alias("low"))
        many = low.where(F.col("n") > max(HEAVY_ROWS, chosen.count() // HEAVY_KEYS)).select("to")
        named = stored(_by_degree(chosen, known, "to", "x", None if many.isEmpty() else many).select("x", F.col("low").alias("label")), "components-labels")
        drop(chosen, low, *([] if labels is None else [labels]))
        labels = named
    found = nodes.select(F.col(node)).distinct()
    if labels is None:
        return found.withColumn("component", F.col(node))
    return found.join(labels.withColumnRenamed("x", node), node, "left").select(node, F.coalesce("label", F.col(node)).alias("component"))


def collaboration_edges(pairs: DataFrame, kind: str, now: Column, artifact: str, start: str = "start", end: str = "end") -> DataFrame:
    """Fold pairs on shared artifacts (columns person_a, person_b, a_/b_ start and end) into typed edges: weight
    is the sum of decayed artifacts, with first and last day and sorted evidence. A pair's window begins at the later start and ends at the later
    end; undated pairs are left out."""
    dated = pairs.withColumn("first", F.greatest(f"a_{start}", f"b_{start}")).withColumn("last", F.greatest(f"a_{end}", f"b_{end}")).where("first is not null and last is not null")
    return dated.groupBy("person_a", "person_b").agg(
        F.lit(kind).alias("connection_type"),
        F.round(F.sum(edge_decay(F.col("last"), now)), 4).alias("weight"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.sort_array(F.collect_list(artifact)).alias("evidence"),
    )


def collapse(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Parallel edges, either direction, as one: weights summed, 0 and null counting as 1."""
    w = F.when(F.coalesce(F.col(weight), F.lit(0.0)) == 0, 1.0).otherwise(F.col(weight))
    return edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.sum(w).alias(weight))


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, other) both ways, each once."""
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).where("node <> other").distinct()


def ring(near: DataFrame) -> DataFrame:
    """(node, other) at exactly two hops: neighbours of neighbours without the neighbours and the node. The pairs around a node
    with a large part of all edges are made in many tasks."""
    ways = near.select("node", F.col("other").alias("mid"))
    two = join_split(ways, near.select(F.col("node").alias("mid"), "other"), "mid", "node", heavy_keys(ways, "mid")).select("node", "other").where("node <> other").distinct()
    return two.join(near, ["node", "other"], "left_anti")


def numbered(near: DataFrame) -> DataFrame:
    """(node, number): nodes from 1 on, nodes with a common smallest neighbour side by side, so that what is around a node has
    numbers close together."""
    first = near.groupBy("node").agg(F.min("other").alias("first")).select("node", F.least("node", "first").alias("first"))
    return running_total(first, [F.col("first"), F.col("node")], F.lit(1), "number").select("node", "number")


def reached(near: DataFrame) -> DataFrame:
    """(node, reached): how many others lie within two hops, exactly, without a row for each of them. A node's neighbours and
    itself are bits of a bitmap that is kept as its words of 64 numbers which are not empty; bitmaps of neighbours are put
    together word by word, on the map side first, and their bits counted. As neighbours have numbers close together, a word
    stands for many of them."""
    named = stored(numbered(near), "reach-numbers")
    other = near.join(named.withColumnRenamed("node", "other"), "other").select("node", "number")
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    words = other.unionByName(named).groupBy("node", F.expr("number div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    balls = stored(words, "reach-balls")
    ways = near.select("node", F.col("other").alias("mid"))
    met = join_split(ways, balls.withColumnRenamed("node", "mid"), "mid", "node", heavy_keys(ways, "mid"))
    whole = met.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    return whole.groupBy("node").agg((F.sum(F.bit_count("bits")) - 1).alias("reached"))


def centrality(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Share of the other nodes of the graph within two hops, rounded to 4; 0.0 (not null) for a node without edges."""
    near = stored(neighbours(edges, a, b), "reach-neighbours")
    reach = reached(near).withColumnRenamed("node", node)
    size = near.agg(F.count_distinct("node").alias("n"))
    joined = nodes.select(node).join(reach, node, "left").crossJoin(F.broadcast(size))  # one row
    return joined.select(node, F.round(F.when(F.col("n") > 1, F.coalesce("reached", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0), 4).alias("centrality"))


def hops(near: DataFrame, targets: DataFrame, radius: int = 2) -> DataFrame:
    """(node, hops) to the nearest of the targets, within a radius: one join a step."""
    done = targets.select("node").distinct().withColumn("hops", F.lit(0))
    front = done
    for step in range(1, radius + 1):
        front = front.select(F.col("node").alias("other")).join(near, "other").select("node").distinct().join(done.select("node"), "node", "left_anti").withColumn("hops", F.lit(step))
        done = done.unionByName(front)
    return done


def degrees(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, degree), 0 where isolated."""
    ends = edges.select(F.col(a).alias(node)).union(edges.select(F.col(b).alias(node))).groupBy(node).agg(F.count("*").alias("degree"))
    return nodes.select(node).join(ends, node, "left").select(node, F.coalesce("degree", F.lit(0)).alias("degree"))


# ---- graphs of groups ----------------------------------------------------------------------------
# Where edges are all pairs of members of groups, (node, group) says as much in a row a member.


def memberships(df: DataFrame, node: str, on: list[str]) -> DataFrame:
    """(node, group) of rows that know all of ``on``, each once: what ``equal_pairs`` would write out as pairs."""
    return df.dropna(subset=on).select(F.col(node).alias("node"), F.struct(*on).alias("group")).distinct()


def _with_groups(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` joined to one row a group; groups with a large part of all members are split over tasks."""
    return join_split(members, groups, "group", "node", heavy_keys(members, "group"))


def hops_by_groups(members: DataFrame, targets: DataFrame, radius: int = 2) -> DataFrame:
    """``hops`` where all members of a group are neighbours: from nodes to their groups to the members of these."""
    members = stored(members, "hops-members")  # read several times a step
    done = targets.select("node").distinct().withColumn("hops", F.lit(0))
    front = done
    for step in range(1, radius + 1):
        met = members.join(front.select("node"), "node").select("group").distinct()
        front = _with_groups(members, met).select("node").distinct().join(done.select("node"), "node", "left_anti").withColumn("hops", F.lit(step))
        front = stored(front, "hops-front")
        done = done.unionByName(front)
    return done


def degrees_by_groups(nodes: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """``degrees`` where all members of a group are neighbours, once for each group that they share."""
    members = stored(members, "degrees-members")
    others = members.groupBy("group").agg((F.count("*") - 1).alias("others"))
    ends = _with_groups(members, others).groupBy(F.col("node").alias(node)).agg(F.sum("others").alias("degree"))
    return nodes.select(node).join(ends, node, "left").select(node, F.coalesce("degree", F.lit(0)).alias("degree"))


def centrality_by_groups(nodes: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """``centrality`` where all members of a group are neighbours. Nodes of the same groups reach the same nodes and are one
    class with a size, so that rows grow with the classes within two hops of each other, not with pairs of nodes."""
    named = stored(members.groupBy("node").agg(F.sort_array(F.collect_set("group")).alias("class")), "reach-classes")  # a node's own groups
    classes = named.groupBy("class").agg(F.count("*").alias("n"))
    held = stored(classes.select("class", "n", F.explode("class").alias("group")), "reach-groups")
    met = held.select("class", "group").join(held.select("class", F.col("group").alias("next")), "class").select("group", "next").distinct()
    two = held.select(F.col("class").alias("from"), "group").join(met, "group").select("from", "next").distinct()
    far = two.join(held.select(F.col("group").alias("next"), "class", "n"), "next").select("from", "class", "n").distinct()
    reach = stored(far.groupBy(F.col("from").alias("class")).agg((F.sum("n") - 1).alias("reached")), "reach-sums")
    size = classes.join(reach.where("reached > 0"), "class").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    around = join_split(named, reach, "class", "node", heavy_keys(named, "class")).select(F.col("node").alias(node), "reached")
    joined = nodes.select(node).join(around, node, "left").crossJoin(F.broadcast(size))  # one row
    return joined.select(node, F.round(F.when(F.col("all") > 1, F.coalesce("reached", F.lit(0)) / (F.col("all") - 1)).otherwise(0.0), 4).alias("centrality"))


def unresolved(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Edges that name a node which is not there."""
    known = nodes.select(F.col(node))
    lost_a = edges.join(known.withColumnRenamed(node, a), a, "left_anti").select(*edges.columns)
    lost_b = edges.join(known.withColumnRenamed(node, b), b, "left_anti").select(*edges.columns)
    return lost_a.union(lost_b).distinct()
