"""Paths over edge tables: bounded simple paths, shortest paths, transitive closure, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferweave.functions.lineage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their flips, with the same predicate and id."""
    flipped = edges.select(*[F.col({"src_id": "dst_id", "dst_id": "src_id"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.union(flipped)


def hop_confidence(c: Column) -> Column:
    """A missing or non-positive confidence counts as 1."""
    return F.when(c > 0, c).otherwise(F.lit(1.0))


def simple_paths(starts: DataFrame, edges: DataFrame, max_hops: int = 4, decay: float = 0.9, min_conf: float = 0.0, directed: bool = False) -> DataFrame:
    """Paths without repeated nodes of 1 to max_hops edges from starts (req_id, start).

    req_id, nodes, preds, ids, conf (product, less by decay for each hop after the first), hops, node (the last). Each
    hop is one equi-join; confidence only falls along a path, so paths under min_conf are cut at once.
    """
    e = (edges if directed else both_ways(edges)).select("src_id", "dst_id", "edge_id", "pred", hop_confidence(F.col("confidence")).alias("c"))
    empty = lambda: F.array().cast("array<string>")
    at = starts.select("req_id", F.array("start").alias("nodes"), empty().alias("preds"), empty().alias("ids"), F.lit(1.0).alias("conf"), F.lit(0).alias("hops"), F.col("start").alias("node"))
    levels = []
    for hop in range(1, max_hops + 1):
        step = at.join(e, at["node"] == e["src_id"]).where(~F.array_contains("nodes", F.col("dst_id")))
        conf = F.col("conf") * F.col("c") * F.lit(decay if hop > 1 else 1.0)
        at = step.select("req_id", F.array_append("nodes", F.col("dst_id")).alias("nodes"), F.array_append("preds", F.col("pred")).alias("preds"), F.array_append("ids", F.col("edge_id")).alias("ids"), conf.alias("conf"), F.lit(hop).alias("hops"), F.col("dst_id").alias("node"))
        at = at.where(F.col("conf") >= min_conf) if min_conf > 0 else at
        levels.append(at)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest_distances(starts: DataFrame, edges: DataFrame, max_hops: int = 8, directed: bool = False) -> DataFrame:
    """start, node, hops: level by level, each level joined once and without nodes seen before; ends when a level is empty."""
    e = (edges if directed else both_ways(edges)).select("src_id", "dst_id").distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    level = seen
    for hop in range(1, max_hops + 1):
        step = level.join(e, level["node"] == e["src_id"]).select("start", F.col("dst_id").alias("node")).distinct()
        level = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def shortest_paths(starts: DataFrame, edges: DataFrame, max_hops: int = 4, limit: int = 8, directed: bool = False) -> DataFrame:
    """req_id, node, hops, nodes, ids: the shortest ways from each start (req_id, start) to every node it reaches, at most limit of each, by edge ids.

    Level by level: only ways that end in a node not met before go on, so no longer way is ever made.
    """
    e = (edges if directed else both_ways(edges)).select("src_id", "dst_id", "edge_id")
    level = starts.select("req_id", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("ids"))
    seen, out = level.select("req_id", "node"), None
    for hop in range(1, max_hops + 1):
        step = level.join(e, level["node"] == e["src_id"]).select("req_id", F.col("dst_id").alias("node"), F.concat("nodes", F.array("dst_id")).alias("nodes"), F.concat("ids", F.array("edge_id")).alias("ids"))
        order = Window.partitionBy("req_id", "node").orderBy("ids")
        step = step.join(seen, ["req_id", "node"], "left_anti").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
        level = cut(step)
        if level.isEmpty():
            break
        found = level.select("req_id", "node", F.lit(hop).alias("hops"), "nodes", "ids")
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(level.select("req_id", "node").distinct())
    return out if out is not None else level.select("req_id", "node", F.lit(0).alias("hops"), "nodes", "ids")


def transitive_closure(edges: DataFrame, max_hops: int = 8) -> DataFrame:
    """src_id, dst_id, hops (the least): semi-naive, each round joins only what the last one found."""
    base = edges.select("src_id", "dst_id").distinct()
    new = base.withColumn("hops", F.lit(1))
    found = new
    for hop in range(2, max_hops + 1):
        step = new.alias("a").join(base.alias("b"), F.col("a.dst_id") == F.col("b.src_id")).select("a.src_id", "b.dst_id").distinct()
        new = cut(step.join(found.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti").withColumn("hops", F.lit(hop)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """node, scc (its smallest member) for nodes that lie on cycles of any length: those that reach each other.

    Nodes without an edge in or out lie on no cycle and go first, again and again. Of the rest, each node takes the least
    node that reaches it as its colour; what reaches such a least node within its colour is a component of its own and
    goes too. Rounds are as many as the longest way within what is left; each is a join and an aggregation.
    """
    pairs = edges.select("src_id", "dst_id").distinct()
    found = pairs.where("src_id = dst_id").select(F.col("src_id").alias("node"), F.col("src_id").alias("scc"))
    left = trimmed(cut(pairs.where("src_id != dst_id")))
    while not left.isEmpty():
        colours = least_reaching(left)
        of = lambda side: colours.select(F.col("node").alias(side), F.col("low").alias(f"{side}_low"))  # noqa: E731, B023
        inner = left.join(of("src_id"), "src_id").join(of("dst_id"), "dst_id").where("src_id_low = dst_id_low")
        inner = cut(inner.select("src_id", "dst_id", F.col("src_id_low").alias("low")))
        members = frontier = colours.where("node = low").join(inner.select(F.col("low")).distinct(), "low", "left_semi").select("node", "low")
        while not frontier.isEmpty():
            step = inner.join(frontier.withColumnRenamed("node", "dst_id"), ["dst_id", "low"]).select(F.col("src_id").alias("node"), "low").distinct()
            frontier = cut(step.join(members, ["node", "low"], "left_anti"))
            members = members.unionByName(frontier)
        members = cut(members)
        # a least node that nothing reaches back from is alone and on no cycle
        on_cycles = members.join(members.groupBy("low").count().where("count > 1").select("low"), "low", "left_semi")
        found = found.unionByName(on_cycles.select("node", F.col("low").alias("scc")))
        gone = members.select("node").union(colours.where("node = low").select("node")).distinct()
        rest = left.join(gone.withColumnRenamed("node", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("node", "dst_id"), "dst_id", "left_anti")
        left = trimmed(cut(rest))
    return found.groupBy("node").agg(F.min("scc").alias("scc"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges (src_id, dst_id) without those that can't lie on a cycle because an end has no edge in or none out."""
    n = edges.count()
    while n:
        heads, tails = edges.select(F.col("dst_id").alias("src_id")).distinct(), edges.select(F.col("src_id").alias("dst_id")).distinct()
        edges = cut(edges.join(heads, "src_id", "left_semi").join(tails, "dst_id", "left_semi").select("src_id", "dst_id"))
        was, n = n, edges.count()
        if n == was:
            break
    return edges


def least_reaching(edges: DataFrame) -> DataFrame:
    """node, low: the least node from which a way leads to the node, itself included. Only lows that fell are carried on."""
    low = edges.select(F.col("src_id").alias("node")).union(edges.select("dst_id")).distinct().withColumn("low", F.col("node"))
    fell = low = cut(low)
    while not fell.isEmpty():
        step = edges.join(fell, edges["src_id"] == fell["node"]).groupBy(F.col("dst_id").alias("node")).agg(F.min("low").alias("new"))
        low = cut(low.join(step, "node", "left").select("node", F.least("low", F.coalesce("new", "low")).alias("low"), F.coalesce(F.col("new") < F.col("low"), F.lit(False)).alias("fell")))
        fell, low = low.where("fell").select("node", "low"), low.select("node", "low")
    return low
