"""The generalization graph: facts of a scope lifted onto its taxonomy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferweave.functions.lineage import cut
from inferweave.functions.scalars import norm_key, positive_or, stable_relation_id
from inferweave.operators.paths import strong_components


@dataclass
class BuildConfig:
    max_level: int = 4
    min_parent_support: int = 2
    min_support: int = 2
    use_edge_confidence: bool = False


def taxonomy_edges(scope: DataFrame, edges: DataFrame, config: BuildConfig | None = None, parent_to_child: bool = False) -> DataFrame:
    """child, parent, pred, confidence up to max_level rounds above the scope (id). Self edges go, duplicates keep the greatest confidence."""
    config = config or BuildConfig()
    child, parent = ("dst_id", "src_id") if parent_to_child else ("src_id", "dst_id")
    conf = F.col("confidence") if config.use_edge_confidence else F.lit(1.0)
    steps = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"), "pred", conf.alias("confidence")).where("child != parent")
    frontier = scope.select(F.col("id").alias("child")).distinct()
    seen, out = frontier, None
    for _ in range(config.max_level):
        level = cut(steps.join(frontier, "child"))
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        frontier = level.select(F.col("parent").alias("child")).distinct().join(seen, "child", "left_anti")
        seen = seen.union(frontier)
    out = steps.where("false") if out is None else out
    return out.groupBy("child", "parent", "pred").agg(F.max("confidence").alias("confidence"))


def levelled(scope: DataFrame, taxonomy: DataFrame, config: BuildConfig | None = None) -> DataFrame:
    """child, parent, pred, confidence, depth of the edges that rise: longest-path levels on the condensation of cycles.

    Scope nodes start at level 0; a parent's level is one more than its highest child's, at most max_level + 1; an edge
    stays if its ends lie on different cycles and the parent's level is within bounds and above the child's.
    """
    config = config or BuildConfig()
    cycles = strong_components(taxonomy.select(F.col("child").alias("src_id"), F.col("parent").alias("dst_id")))
    of = lambda side: cycles.select(F.col("node").alias(side), F.col("scc").alias(f"{side}_scc"))
    edges = taxonomy.join(of("child"), "child", "left").join(of("parent"), "parent", "left")
    edges = cut(edges.withColumn("c", F.coalesce("child_scc", "child")).withColumn("p", F.coalesce("parent_scc", "parent")).drop("child_scc", "parent_scc"))
    steps = edges.where("c != p").select("c", "p").distinct()
    start = scope.select(F.col("id").alias("node")).join(cycles, "node", "left").select(F.coalesce("scc", "node").alias("node")).distinct()
    levels = start.withColumn("level", F.lit(0))
    for _ in range(config.max_level + 1):
        raised = steps.join(levels, steps["c"] == levels["node"]).select(F.col("p").alias("node"), F.least(F.col("level") + 1, F.lit(config.max_level + 1)).alias("level"))
        levels = cut(levels.unionByName(raised).groupBy("node").agg(F.max("level").alias("level")))
    low, high = levels.select(F.col("node").alias("c"), F.col("level").alias("low")), levels.select(F.col("node").alias("p"), F.col("level").alias("depth"))
    kept = edges.where("c != p").join(low, "c").join(high, "p").where((F.col("depth") > 0) & (F.col("depth") <= config.max_level) & (F.col("depth") > F.col("low")))
    return kept.select("child", "parent", "pred", "confidence", "depth")


def selected_parents(edges: DataFrame, config: BuildConfig | None = None) -> DataFrame:
    """parent, children, depth: parents with enough distinct children, and the parents below a kept one."""
    config = config or BuildConfig()
    parents = cut(edges.groupBy("parent").agg(F.countDistinct("child").alias("children"), F.max("depth").alias("depth")))
    kept = parents.where(F.col("children") >= config.min_parent_support).select("parent")
    for _ in range(config.max_level):
        below = edges.join(kept, "parent").select(F.col("child").alias("parent")).join(parents.select("parent"), "parent", "left_semi").distinct()
        kept = cut(kept.union(below).distinct())
    return parents.join(kept, "parent")


def lifted_relations(facts: DataFrame, edges: DataFrame, parents: DataFrame, config: BuildConfig | None = None) -> DataFrame:
    """parent, pred, target, support, confidence, sources, level: what enough children of a parent have in common.

    facts: child, pred, target, confidence, source (an id). A bucket's confidence is the mean over its rows times the
    share of the parent's children that have it; buckets under the support still climb; the first level that reaches
    the support emits a relation.
    """
    config = config or BuildConfig()
    links = cut(edges.join(parents.select("parent", "children"), "parent").select("child", "parent", "children").distinct())
    now = facts.select("child", "pred", "target", positive_or(F.col("confidence")).alias("confidence"), F.array("source").alias("sources"))
    out = None
    for level in range(1, config.max_level + 1):
        bucket = now.join(links, "child").groupBy("parent", "pred", "target")
        bucket = bucket.agg(F.countDistinct("child").alias("support"), F.avg("confidence").alias("mean"), F.max("children").alias("children"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
        bucket = cut(bucket.withColumn("confidence", F.col("mean") * F.col("support") / F.col("children")).withColumn("level", F.lit(level)).drop("mean", "children"))
        if bucket.isEmpty():
            break
        new = bucket.where(F.col("support") >= config.min_support)
        key = ["parent", "pred", "target"]
        out = new if out is None else out.unionByName(new.join(out.select(*key), key, "left_anti"))
        now = bucket.select(F.col("parent").alias("child"), "pred", "target", "confidence", "sources")
    return out


def assemble(scope: DataFrame, edges: DataFrame, parents: DataFrame, facts: DataFrame, lifted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, depth, support) and relations (id, source_id, predicate, target_id, confidence, support, lifted) of the generalization graph."""
    rank = F.when(F.col("kind") == "scope", 0).when(F.col("kind") == "concept", 1).otherwise(2)
    ends = facts.select(F.col("target").alias("id")).union(lifted.select("target"))
    nodes = scope.select("id", F.lit("scope").alias("kind"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("support"))
    nodes = nodes.unionByName(parents.select(F.col("parent").alias("id"), F.lit("concept").alias("kind"), "depth", F.col("children").alias("support")))
    nodes = nodes.unionByName(ends.select("id", F.lit("endpoint").alias("kind"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("support")))
    nodes = nodes.groupBy("id").agg(F.min_by("kind", rank).alias("kind"), F.coalesce(F.min(F.when(F.col("depth") > 0, F.col("depth"))), F.lit(0)).alias("depth"), F.max("support").alias("support"))
    inside = parents.select(F.col("parent").alias("child")).union(scope.select("id")).distinct()
    tax = edges.join(parents.select("parent"), "parent", "left_semi").join(inside, "child", "left_semi")
    rel = lambda df, s, p, t, conf, sup, up, first: df.select(stable_relation_id(F.col(s), F.col(p), F.col(t), *([F.lit("lifted")] if up else [])).alias("id"), F.col(s).alias("source_id"), F.col(p).alias("predicate"), F.col(t).alias("target_id"), conf.alias("confidence"), sup.cast("bigint").alias("support"), F.lit(up).alias("lifted"), F.lit(first).alias("turn"))
    relations = rel(tax, "child", "pred", "parent", F.col("confidence"), F.lit(1), False, 0).unionByName(rel(facts, "child", "pred", "target", positive_or(F.col("confidence")), F.lit(1), False, 1)).unionByName(rel(lifted, "parent", "pred", "target", F.col("confidence"), F.col("support"), True, 2))
    relations = relations.where("trim(source_id) != '' AND trim(predicate) != '' AND trim(target_id) != ''")
    columns = [c for c in relations.columns if c not in ("id", "turn")]
    relations = relations.groupBy("id").agg(F.min(F.struct("turn", *columns)).alias("r")).select("id", *[F.col(f"r.{c}") for c in columns])
    return nodes, relations


def dropped_edges(all_edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges (src_id, pred, dst_id) whose key, whatever its case, is not among the kept ones (source_id, predicate, target_id); duplicates stay."""
    key = lambda *c: F.concat_ws("|", *[F.lower(x) for x in c])
    return all_edges.withColumn("_key", key("src_id", "pred", "dst_id")).join(kept.select(key("source_id", "predicate", "target_id").alias("_key")), "_key", "left_anti").drop("_key")


def resolved_entities(entities: DataFrame) -> DataFrame:
    """id, node for entities (id, name): ids whose own or whose name's spelling agrees, whatever the case, are one node, the least id of them.

    An entity's aliases are its id and its name; the first that another entity has too (the id before the name) says
    which node it is. Blank names are no aliases.
    """
    alias = F.explode(F.array(F.struct(F.lit(0).alias("turn"), norm_key(F.col("id")).alias("key")), F.struct(F.lit(1).alias("turn"), norm_key(F.col("name")).alias("key"))))
    keyed = entities.select("id", alias.alias("a")).select("id", "a.*").where("key != ''")
    owners = keyed.groupBy("key").agg(F.min("id").alias("owner"))
    best = F.min_by("owner", F.struct((F.col("owner") == F.col("id")).cast("int"), "turn")).alias("node")
    return keyed.join(owners, "key").groupBy("id").agg(best)


def on_nodes(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """edges (src_id, dst_id, ...) between resolved nodes; edges whose ends are aliases of one node go."""
    of = lambda side: resolved.select(F.col("id").alias(side), F.col("node").alias(f"{side}_node"))
    out = edges.join(of("src_id"), "src_id", "left").join(of("dst_id"), "dst_id", "left")
    out = out.withColumn("src_id", F.coalesce("src_id_node", "src_id")).withColumn("dst_id", F.coalesce("dst_id_node", "dst_id"))
    return out.where("src_id != dst_id").select(*edges.columns)


def statistics(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """What the graph holds, in long form: measure, n."""
    kinds = nodes.groupBy(F.concat(F.lit("nodes:"), "kind").alias("measure")).agg(F.count("*").alias("n"))
    levels = nodes.where("kind = 'concept'").groupBy(F.concat(F.lit("level:"), F.col("depth").cast("string")).alias("measure")).agg(F.count("*").alias("n"))
    lifted = relations.groupBy(F.when(F.col("lifted"), "relations:lifted").otherwise("relations:direct").alias("measure")).agg(F.count("*").alias("n"))
    return kinds.unionByName(levels).unionByName(lifted)


def explained_edges(facts: DataFrame, edges: DataFrame, lifted: DataFrame) -> DataFrame:
    """Facts (child, pred, target, ...) that a lifted relation of one of the child's parents says as well; the others are what compression must keep."""
    said = edges.select("child", "parent").join(lifted.select("parent", "pred", "target"), "parent").select("child", "pred", "target").distinct()
    return facts.join(said, ["child", "pred", "target"], "left_semi")


def lowered(lifted: DataFrame, edges: DataFrame) -> DataFrame:
    """What lifted relations let expect of each child: child, pred, target, confidence (the best)."""
    return lifted.join(edges.select("child", "parent"), "parent").groupBy("child", "pred", "target").agg(F.max("confidence").alias("confidence"))


def coverage(scope: DataFrame, edges: DataFrame) -> DataFrame:
    """covered, total, share: entities of the scope with a parent."""
    has = edges.select(F.col("child").alias("id")).distinct().withColumn("has", F.lit(1))
    return scope.join(has, "id", "left").agg(F.count("has").alias("covered"), F.count("*").alias("total"), F.try_divide(F.count("has"), F.count("*")).alias("share"))


def statistic_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """measure, n, change between two tables of statistics."""
    old = before.select("measure", F.col("n").alias("was"))
    return now.join(old, "measure", "full").select("measure", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("change"))
