"""Derive, entails and contradicts over tables of requests and claims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferweave.functions.lineage import cut
from inferweave.functions.registry import Registry
from inferweave.functions.scalars import base_name, norm_key
from inferweave.operators.paths import both_ways, simple_paths, transitive_closure
from inferweave.sources.kg import Graph


@dataclass
class Config:
    max_hops: int = 4
    decay: float = 0.9
    min_conf: float = 0.05
    limit: int = 8
    exclude_deduced: bool = True
    directed: bool = False
    contradiction: str = "predicate"  # or class, or none
    by_name: bool = False  # whether sources and targets may be names of entities


def proofs(requests: DataFrame, graph: Graph, registry: Registry, config: Config) -> DataFrame:
    """Proofs of requests (req_id, source, and optionally target, predicate, include_inverse), before ranking.

    Sources and targets are met by id, whatever the case and the space around it, and with config.by_name by entity
    name too; several nodes may be met. req_id, source, node, predicate (effective, '' if the path amounts to nothing),
    conf, hops, ids, steps, rule_class.
    """
    g = graph.quarantined(config.exclude_deduced)
    # paths depend on the source alone: requests that share one share its paths
    keys = requests.select("source").distinct().withColumn("_key", norm_key(F.col("source")))
    nodes = (g.edges if config.directed else both_ways(g.edges)).select(F.col("src_id").alias("start"), norm_key(F.col("src_id")).alias("_key"))
    starts = nodes.join(keys, "_key").select("source", "start").distinct()
    if config.by_name and g.entities is not None:
        starts = starts.union(g.entities.select(F.col("id").alias("start"), norm_key(F.col("name")).alias("_key")).join(keys, "_key").select("source", "start")).distinct()
    starts = starts.withColumnRenamed("source", "req_id")
    found = simple_paths(starts, g.edges, config.max_hops, config.decay, config.min_conf, config.directed).withColumnRenamed("req_id", "source")
    found = found.withColumn("predicate", F.coalesce(registry.effective_column(F.col("preds")), F.lit("")))
    wanted = [c for c in ("target", "predicate", "include_inverse") if c in requests.columns]
    asked = requests.select("req_id", "source", *[F.col(c).alias(f"want_{c}") for c in wanted])
    if "target" in wanted:
        at = found.withColumn("_key", norm_key(F.col("node")))
        if config.by_name and g.entities is not None:
            named = g.entities.select(F.col("id").alias("node"), norm_key(F.col("name")).alias("_key"))
            at = at.unionByName(found.join(named, "node").where(F.col("_key") != norm_key(F.col("node"))).select(*at.columns))
        some = asked.where("want_target IS NOT NULL").withColumn("_key", norm_key(F.col("want_target"))).join(at, ["source", "_key"])
        out = some.unionByName(asked.where("want_target IS NULL").withColumn("_key", F.lit("")).join(found, "source"))
    else:
        out = asked.join(found, "source")
    if "predicate" in wanted:
        closure = registry.closure_table(requests.sparkSession)
        inverse = registry.canonical_column(F.col("want_predicate"))
        out = out.withColumn("goal", inverse)
        pairs = F.broadcast(closure.select(F.col("pred").alias("predicate"), F.col("super").alias("goal"), F.lit(True).alias("direct")))  # the registry's closure
        out = out.join(pairs, ["predicate", "goal"], "left")
        ok = F.col("goal").isNull() | F.coalesce("direct", F.lit(False)) | ((F.col("predicate") == F.col("goal")) & (F.col("predicate") != ""))
        if "include_inverse" in wanted:
            turned = [{"goal": p, "predicate": q} for p, (i, _, _) in registry.predicates.items() if i and i != p for q in registry.entailing(i)]
            from inferweave.functions.registry import inline

            flips = F.broadcast(inline(requests.sparkSession, turned, "goal string, predicate string").withColumn("turned", F.lit(True)))
            out = out.join(flips, ["predicate", "goal"], "left")
            ok = ok | (F.col("want_include_inverse") & F.coalesce("turned", F.lit(False)))
        out = out.where(ok)
    n = F.size("preds")
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ids", i).alias("edge_id"), F.get("preds", i).alias("predicate"), F.get("nodes", i).alias("source"), F.get("nodes", i + 1).alias("target")))
    return out.select("req_id", "source", "node", "predicate", "conf", "hops", "ids", steps.alias("steps"), F.when(n == 1, "edge").otherwise("composition").alias("rule_class"))


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """The best proofs of each request: confidence, then fewer hops, then edge ids."""
    order = Window.partitionBy("req_id").orderBy(F.desc(F.round("conf", 9)), "hops", "ids")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def derive(requests: DataFrame, graph: Graph, registry: Registry, config: Config | None = None) -> DataFrame:
    config = config or Config()
    return ranked(proofs(requests, graph, registry, config), config.limit)


def contradicts_predicate(claims: DataFrame, graph: Graph, registry: Registry, config: Config | None = None) -> DataFrame:
    """claim_id, witness_predicate, witness_object: an edge from the claim's subject to its object (or a variant of it) whose predicate is disjoint with the claim's."""
    config = config or Config()
    spark = claims.sparkSession
    edges = graph.quarantined(config.exclude_deduced).edges.select(norm_key(F.col("src_id")).alias("s"), F.col("pred").alias("conflict"), F.col("dst_id").alias("found"))
    asked = claims.select("claim_id", norm_key(F.col("subject")).alias("s"), registry.canonical_column(F.col("predicate")).alias("pred"), F.lower("object").alias("o"))
    asked = asked.join(F.broadcast(registry.disjoint_table(spark)), "pred")  # the registry's pairs
    # an object matches in full, or if the claim's base name is its beginning up to a space: both are equalities of keys
    words = F.split(F.lower("found"), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
    edges = edges.select("s", "conflict", "found", F.explode(F.array_distinct(prefixes)).alias("key"))
    asked = asked.withColumn("base", base_name(F.col("o"))).withColumn("key", F.explode(F.array_distinct(F.array("o", "base"))))
    hit = asked.join(edges, ["s", "conflict", "key"]).where((F.col("key") == F.col("base")) | (F.lower("found") == F.col("o")))
    return hit.groupBy("claim_id").agg(F.min(F.struct("conflict", "found")).alias("w")).select("claim_id", F.col("w.conflict").alias("witness_predicate"), F.col("w.found").alias("witness_object"))


def contradicts_class(claims: DataFrame, graph: Graph, registry: Registry, disjoint: DataFrame, config: Config | None = None) -> DataFrame:
    """claim_id, class, hops: a class of the subject (itself, or reached over transitive predicates) that is disjoint with the object.

    disjoint: class_a, class_b, in either order. Of several classes the nearest, then the first by name.
    """
    config = config or Config()
    edges = graph.quarantined(config.exclude_deduced).restricted(*registry.transitive()).edges
    closure = transitive_closure(edges, config.max_hops)
    own = claims.select(F.col("subject").alias("src_id"), F.col("subject").alias("dst_id"), F.lit(0).alias("hops")).distinct()
    classes = closure.unionByName(own).select(F.col("src_id").alias("subject"), F.lower("dst_id").alias("class"), "hops")
    pairs = disjoint.select(F.lower("class_a").alias("class"), F.lower("class_b").alias("o")).union(disjoint.select(F.lower("class_b"), F.lower("class_a"))).distinct()
    hit = claims.select("claim_id", "subject", F.lower("object").alias("o")).join(pairs, "o").join(classes, ["subject", "class"])
    return hit.groupBy("claim_id").agg(F.min(F.struct("hops", "class")).alias("w")).select("claim_id", F.col("w.class").alias("class"), F.col("w.hops").alias("hops"))


def entails(claims: DataFrame, graph: Graph, registry: Registry, config: Config | None = None, disjoint: DataFrame | None = None) -> DataFrame:
    """claim_id, verdict, confidence, best (the best proof): contradictions first, then proofs in either direction, else unsupported."""
    config = config or Config()
    requests = claims.select(F.col("claim_id").alias("req_id"), F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", F.lit(True).alias("include_inverse"))
    best = ranked(proofs(requests, graph, registry, config), 1).select(F.col("req_id").alias("claim_id"), "conf", F.struct("predicate", "conf", "hops", "ids", "rule_class").alias("best"))
    if config.contradiction == "class":
        against = contradicts_class(claims, graph, registry, disjoint, config).select("claim_id", F.pow(F.lit(config.decay), F.greatest(F.col("hops") - 1, F.lit(0))).alias("against"))
    elif config.contradiction == "predicate":
        against = contradicts_predicate(claims, graph, registry, config).select("claim_id", F.lit(1.0).alias("against"))
    else:
        against = claims.select("claim_id", F.lit(None).cast("double").alias("against")).where("false")
    out = claims.join(against, "claim_id", "left").join(best, "claim_id", "left")
    verdict = F.when(F.col("against").isNotNull(), "contradicted").when(F.col("conf").isNotNull(), "entailed").otherwise("unsupported")
    return out.select(*claims.columns, verdict.alias("verdict"), F.coalesce("against", "conf", F.lit(0.0)).alias("confidence"), F.when(F.col("against").isNull(), F.col("best")).alias("best"))


def constrained(results: DataFrame, accepted: list[str]) -> DataFrame:
    """Entailed claims whose best proof has another predicate become unsupported; rule proofs are left alone."""
    bad = (F.col("verdict") == "entailed") & (F.col("best.rule_class") != "conditional") & ~F.col("best.predicate").isin(*accepted)
    return results.withColumn("verdict", F.when(bad, "unsupported").otherwise(F.col("verdict"))).withColumn("confidence", F.when(bad, 0.0).otherwise(F.col("confidence")))


BACKENDS = {"symbolic-graph": entails}


def native_confidence(hops, prior: float = 0.8, decay: float = 0.9):
    """The confidence of the shortest-path mode: a prior per hop and the decay."""
    return F.pow(F.lit(prior), hops) * F.pow(F.lit(decay), hops - 1)


def native_entails(claims: DataFrame, graph: Graph, registry: Registry, config: Config | None = None) -> DataFrame:
    """The shortest-path mode: only shortest paths count, a fixed prior per hop, no entity labelled GENE on the way, names as they
    are written, and a path amounts to a predicate only if all its hops have that one.

    claim_id, verdict, confidence, hops. Levels are expanded once for all claims and stop for a claim when its object is met.
    """
    config = config or Config()
    g = graph.quarantined(config.exclude_deduced, ("GENE",))
    accepted = claims.select("predicate").distinct()
    names = {r[0]: registry.accepted(registry.canonical(r[0])) for r in accepted.collect()}  # the predicates that are asked about
    from inferweave.functions.registry import inline

    goals = inline(claims.sparkSession, [{"predicate": p, "pred": q} for p, qs in names.items() for q in {*qs, registry.canonical(p)}], "predicate string, pred string")
    spelled = F.translate(F.lower(F.trim("pred")), " -", "__")
    e = g.edges.select("src_id", "dst_id", spelled.alias("pred")).union(g.edges.select("dst_id", "src_id", spelled)).distinct()
    open_ = claims.join(F.broadcast(goals), "predicate").select("claim_id", "object", "pred", F.col("subject").alias("node"))
    found, seen = None, open_.select("claim_id", "pred", "node")
    for hop in range(1, config.max_hops + 1):
        level = open_.join(e.withColumnRenamed("src_id", "node"), ["node", "pred"]).select("claim_id", "object", "pred", F.col("dst_id").alias("node")).distinct()
        level = cut(level.join(seen, ["claim_id", "pred", "node"], "left_anti"))
        if level.isEmpty():
            break
        hit = level.where("node = object").select("claim_id", F.lit(hop).alias("hops")).distinct()
        found = hit if found is None else found.unionByName(hit.join(found.select("claim_id"), "claim_id", "left_anti"))
        seen = seen.unionByName(level.select("claim_id", "pred", "node"))
        open_ = level.join(found.select("claim_id"), "claim_id", "left_anti")
    hits = found if found is not None else claims.select("claim_id", F.lit(0).alias("hops")).where("false")
    out = claims.join(hits, "claim_id", "left")
    return out.select("claim_id", F.when(F.col("hops").isNotNull(), "entailed").otherwise("unsupported").alias("verdict"), F.coalesce(native_confidence(F.col("hops")), F.lit(0.0)).alias("confidence"), "hops")


BACKENDS["native"] = native_entails


def answer(claims: DataFrame, graph: Graph, registry: Registry, backend: str = "symbolic-graph", config: Config | None = None) -> DataFrame:
    """The claims' verdicts by a named backend."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}; there are {sorted(BACKENDS)}")
    return BACKENDS[backend](claims, graph, registry, config)


def proof_json(proofs: DataFrame) -> DataFrame:
    """Proofs with their steps as JSON."""
    return proofs.withColumn("proof", F.to_json(F.struct("predicate", "conf", "hops", "rule_class", "steps")))


STEP = "struct<edge_id:string,predicate:string,source:string,target:string>"


def proofs_of_json(rows: DataFrame) -> DataFrame:
    """Rows with a column proof, as proof_json writes it, and what it says in columns; a broken proof is null in all of them."""
    kind = f"struct<predicate:string,conf:double,hops:int,rule_class:string,steps:array<{STEP}>>"
    return rows.select("*", F.from_json("proof", kind).alias("_p")).select(*rows.columns, "_p.*")


def joined_contexts(paths: DataFrame) -> DataFrame:
    """Paths whose hops carry conditions (contexts: array of arrays of strings): their union, and confidence 0 where one contradicts another (x and not x)."""
    every = F.array_sort(F.array_distinct(F.flatten("contexts")))
    against = F.exists(every, lambda c: F.array_contains(every, F.concat(F.lit("not "), c)))
    return paths.withColumn("conditions", every).withColumn("conf", F.when(against, 0.0).otherwise(F.col("conf")))


def supports_diagnosis(findings: DataFrame, graph: Graph, predicate: str, config: Config | None = None) -> DataFrame:
    """case, disease, support (direct or by_subclass) for findings (case, finding): the finding has the predicate to the disease, or to one of its classes."""
    config = config or Config()
    g = graph.quarantined(config.exclude_deduced)
    direct = findings.join(g.restricted(predicate).edges.select(F.col("src_id").alias("finding"), F.col("dst_id").alias("disease")), "finding").select("case", "disease", F.lit("direct").alias("support"))
    below = transitive_closure(g.restricted("is_a").edges, config.max_hops).select(F.col("src_id").alias("lower"), F.col("dst_id").alias("disease"))
    by_class = direct.select("case", F.col("disease").alias("lower")).join(below, "lower").select("case", "disease", F.lit("by_subclass").alias("support"))
    return direct.unionByName(by_class).groupBy("case", "disease").agg(F.max_by("support", F.col("support") == "direct").alias("support"))
