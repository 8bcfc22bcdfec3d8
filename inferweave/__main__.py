"""Command line: build-generalization, load-rules, reason-check."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inferweave.functions.registry import general, load_registry
from inferweave.operators import generalization as G
from inferweave.operators.reasoning import Config
from inferweave.operators.rules import parse_rule
from inferweave.plans.engine import Engine, Generation
from inferweave.sources import readers, sinks
from inferweave.sources.kg import read_graph


def registry_of(path: str | None):
    if not path:
        return general()
    with open(path) as f:
        return load_registry(f.read())


def build_generalization(spark: SparkSession, a: argparse.Namespace) -> None:
    registry = registry_of(a.registry)
    graph = read_graph(spark, a.graph).canonicalized(registry).quarantined()
    scope = graph.entities.where(F.col("group_id") == a.scope).select("id")
    if a.scope_file:
        names = readers.read_scope(spark, a.scope_file)
        scope = graph.entities.join(names, (graph.entities["id"] == names["name"]) | (F.lower(graph.entities["name"]) == F.lower(names["name"])), "left_semi").select("id")
    config = G.BuildConfig(a.max_level, a.min_parent_support, a.min_support)
    taxonomy = a.taxonomy or ["is_a"]
    edges = G.levelled(scope, G.taxonomy_edges(scope, graph.restricted(*taxonomy).edges, config, a.parent_to_child), config)
    parents = G.selected_parents(edges, config)
    predicates = sorted({p for t in taxonomy for p in registry.inheritable(t)}) if not a.predicates else a.predicates
    facts = graph.edges.join(scope.withColumnRenamed("id", "src_id"), "src_id", "left_semi").where(F.col("pred").isin(*predicates))
    facts = facts.select(F.col("src_id").alias("child"), "pred", F.col("dst_id").alias("target"), "confidence", F.col("edge_id").alias("source"))
    nodes, relations = G.assemble(scope, edges, parents, facts, G.lifted_relations(facts, edges, parents, config))
    for name, df in (("nodes", nodes), ("relations", relations), ("dropped", G.dropped_edges(graph.edges, relations))):
        sinks.publish_snapshot(df, f"{a.out}/{name}")
    G.statistics(nodes, relations).orderBy("measure").show(100, False)


def load_rules(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_rules_jsonl(spark, a.rules, a.limit)
    nodes = sinks.rule_nodes(rows, a.scope)
    sinks.publish_snapshot(nodes, f"{a.out}/rules")
    if a.with_facts:
        sinks.publish_snapshot(sinks.condition_facts(rows), f"{a.out}/rule_facts")
    readers.decode_rules(nodes).groupBy("state").count().show()


def reason_check(spark: SparkSession, a: argparse.Namespace) -> None:
    engine = Engine(spark, registry_of(a.registry), Config(max_hops=a.max_hops))
    found = []
    if a.rules:
        with open(a.rules) as f:
            found = [parse_rule(line) for line in f if line.strip()]
    engine.swap(Generation("cli", read_graph(spark, a.graph).canonicalized(engine.registry), found))
    for row in engine.entails([tuple(a.claim)]).toJSON().collect():
        print(json.dumps(json.loads(row), indent=2))


def main() -> None:
    top = argparse.ArgumentParser(prog="inferweave")
    verbs = top.add_subparsers(required=True)
    b = verbs.add_parser("build-generalization")
    for name, kind, default in (("graph", str, None), ("out", str, None), ("scope", str, ""), ("scope-file", str, None), ("registry", str, None), ("max-level", int, 4), ("min-parent-support", int, 2), ("min-support", int, 2)):
        b.add_argument(f"--{name}", type=kind, default=default, required=name in ("graph", "out"))
    b.add_argument("--taxonomy", nargs="*")
    b.add_argument("--predicates", nargs="*")
    b.add_argument("--parent-to-child", action="store_true")
    b.set_defaults(run=build_generalization)
    r = verbs.add_parser("load-rules")
    for name, kind, default in (("rules", str, None), ("out", str, None), ("scope", str, ""), ("limit", int, None)):
        r.add_argument(f"--{name}", type=kind, default=default, required=name in ("rules", "out"))
    r.add_argument("--with-facts", action="store_true")
    r.set_defaults(run=load_rules)
    c = verbs.add_parser("reason-check")
    c.add_argument("claim", nargs=3)
    for name, kind, default in (("graph", str, None), ("registry", str, None), ("rules", str, None), ("max-hops", int, 4)):
        c.add_argument(f"--{name}", type=kind, default=default, required=name == "graph")
    c.set_defaults(run=reason_check)
    args = top.parse_args()
    spark = SparkSession.builder.appName("inferweave").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
