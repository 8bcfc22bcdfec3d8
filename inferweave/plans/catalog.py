"""The registry of queries: every operator over the demo graph or the source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.functions import registry as R
from inferweave.functions import scalars as S
from inferweave.operators import generalization as G
from inferweave.operators import mining as M
from inferweave.operators import paths as P
from inferweave.operators import reasoning as E
from inferweave.operators import rules as U
from inferweave.operators import telemetry as T
from inferweave.plans.oracles import ORACLES
from inferweave.sources import kg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLACES = ("customer_nation", "supplier_nation", "nation_region")
TYPES = ("part_type", "type_any", "part_brand", "brand_maker")
SUPPLY = ("supplier_part", "supplier_recall")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# paths and reasoning


@query
def derive_two_hop(spark, sf_dir):
    """All directed two-hop paths, folded by the predicate algebra."""
    g = kg.demo_graph(spark, sf_dir, (*PLACES, *TYPES, "supplier_part"))
    e = g.edges.select("src_id", "dst_id", "pred", "confidence")
    a, b = e.alias("a"), e.alias("b")
    hops = a.join(b, F.col("a.dst_id") == F.col("b.src_id")).where("a.src_id != b.dst_id")
    eff = kg.demo_registry().effective_column(F.array("a.pred", "b.pred"))
    conf = F.round(F.col("a.confidence") * F.col("b.confidence") * 0.9, 6)
    return hops.select(eff.alias("predicate"), conf.alias("c")).where("predicate IS NOT NULL").groupBy("predicate").agg(F.count("*").alias("n"), F.round(F.sum("c"), 3).alias("total"))


@query
def derive_bounded_paths(spark, sf_dir):
    """Simple undirected paths of up to three hops from every supplier over places, by what they amount to."""
    g = kg.demo_graph(spark, sf_dir, ("supplier_nation", "nation_region"))
    starts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("req_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("start"))
    found = P.simple_paths(starts, g.edges, 3)
    eff = F.coalesce(kg.demo_registry().effective_column(F.col("preds")), F.lit(""))
    return found.groupBy("req_id", "hops", eff.alias("predicate")).agg(F.count("*").alias("n"), F.round(F.sum(F.round("conf", 6)), 4).alias("total"))


@query
def shortest_path_bfs(spark, sf_dir):
    """Nodes by distance from each region, against and along the edges of places."""
    g = kg.demo_graph(spark, sf_dir, PLACES)
    starts = read(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("start"))
    return P.shortest_distances(starts, g.edges, 4).groupBy("start", "hops").agg(F.count("*").alias("n"))


@query
def transitive_closure_is_a(spark, sf_dir):
    g = kg.demo_graph(spark, sf_dir, TYPES).restricted("is_a")
    return P.transitive_closure(g.edges, 4)


def location_claims(spark, sf_dir):
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("claim_id"), F.concat(F.lit("customer:"), key).alias("subject"), F.lit("located in").alias("predicate"), F.concat(F.lit("region:"), key % 5).alias("object"))


def supply_claims(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.concat_ws(":", F.lit("s"), "l_suppkey", "l_partkey").alias("claim_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("part:"), "l_partkey").alias("object"))


@query
def entails_claims(spark, sf_dir):
    """Whether customers are located in a region (proofs of two hops), and whether suppliers supply parts (unless they recall them)."""
    reg, config = kg.demo_registry(), E.Config(max_hops=2, directed=True)
    places = E.entails(location_claims(spark, sf_dir), kg.demo_graph(spark, sf_dir, ("customer_nation", "nation_region")), reg, config)
    supply = E.entails(supply_claims(spark, sf_dir), kg.demo_graph(spark, sf_dir, SUPPLY), reg, E.Config(max_hops=1, directed=True))
    return places.unionByName(supply).select("claim_id", "verdict", r6(F.col("confidence"), "confidence"), F.coalesce("best.predicate", F.lit("")).alias("proof_predicate"))


@query
def constrained_claims(spark, sf_dir):
    """The same claims where only a proof by part_of would do: everything entailed becomes unsupported."""
    reg = kg.demo_registry()
    found = E.entails(location_claims(spark, sf_dir), kg.demo_graph(spark, sf_dir, ("customer_nation", "nation_region")), reg, E.Config(max_hops=2, directed=True))
    return E.constrained(found, reg.accepted("part_of")).groupBy("verdict").agg(F.count("*").alias("n"))


@query
def contradicts_class(spark, sf_dir):
    """Parts whose type is disjoint with the type that is claimed."""
    g = kg.demo_graph(spark, sf_dir, TYPES)
    claims = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("claim_id"), F.concat(F.lit("part:"), "p_partkey").alias("subject"), F.lit("is_a").alias("predicate"), F.lit("type:ECONOMY").alias("object"))
    disjoint = R.inline(spark, [{"class_a": "type:PROMO", "class_b": "type:ECONOMY"}, {"class_a": "type:ECONOMY", "class_b": "type:STANDARD"}], "class_a string, class_b string")
    return E.contradicts_class(claims, g, kg.demo_registry(), disjoint, E.Config(max_hops=2))


@query
def contradicts_predicate(spark, sf_dir):
    return E.contradicts_predicate(supply_claims(spark, sf_dir), kg.demo_graph(spark, sf_dir, SUPPLY), kg.demo_registry())


@query
def topk_proofs(spark, sf_dir):
    """The three best proofs that each supplier supplies a type."""
    g = kg.demo_graph(spark, sf_dir, ("supplier_part", "part_type"))
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("req_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("source"), F.lit("supplies").alias("predicate"), F.lit("type:PROMO").alias("target"))
    found = E.derive(asked, g, kg.demo_registry(), E.Config(max_hops=2, limit=3, directed=True))
    return found.select("req_id", "rank", "hops", "predicate", r6(F.col("conf"), "conf"), F.array_join("ids", ",").alias("ids"))


# predicate algebra


@query
def canonicalize_predicates(spark, sf_dir):
    return kg.demo_graph(spark, sf_dir).edges.groupBy("pred_raw", "pred").agg(F.count("*").alias("n"))


@query
def effective_predicate(spark, sf_dir):
    """Every pair of the general pack."""
    reg = R.general()
    names = R.inline(spark, [{"p": p} for p in reg.predicates], "p string")
    pairs = names.select(F.col("p").alias("a")).crossJoin(names.select(F.col("p").alias("b")))  # 15 x 15 names
    return pairs.withColumn("predicate", reg.effective_column(F.array("a", "b"))).where("predicate IS NOT NULL")


@query
def subproperty_closure(spark, sf_dir):
    return R.medical().closure_table(spark)


@query
def accepted_predicates(spark, sf_dir):
    """For each predicate of the medical pack how many predicates entail it in either direction."""
    reg = R.medical()
    return R.inline(spark, [{"pred": p, "n": len(reg.accepted(p))} for p in reg.predicates], "pred string, n bigint")


@query
def domain_range_check(spark, sf_dir):
    reg = kg.demo_registry()
    g = kg.demo_graph(spark, sf_dir, ("customer_nation", "supplier_nation", "supplier_part"))
    kind = lambda c: F.upper(F.substring_index(c, ":", 1))
    fits = {(p, side): [t for t in reg.types if any(reg.is_a(t, w) for w in declared[p])] for side, declared in (("head", reg.domains), ("tail", reg.ranges)) for p in declared}
    ok = F.lit(True)
    for (p, side), good in fits.items():
        end = kind("src_id" if side == "head" else "dst_id")
        ok = ok & ((F.col("pred") != p) | end.isin(*good))
    return g.edges.groupBy("pred", ok.alias("ok")).agg(F.count("*").alias("n"))


# filters


@query
def quarantine_status(spark, sf_dir):
    return kg.demo_graph(spark, sf_dir, ("supplier_part",)).quarantined().edges.groupBy("src_id").agg(F.count("*").alias("n"))


@query
def label_filter(spark, sf_dir):
    return kg.demo_graph(spark, sf_dir, PLACES).quarantined(labels=("SUPPLIER",)).edges.groupBy("pred").agg(F.count("*").alias("n"))


@query
def plausible_entities(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("name"))
    return docs.where(S.plausible_name(F.col("name"))).select("doc_id", "name")


@query
def tautology_filter(spark, sf_dir):
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    claims = conv.select("conv_id", "turn", F.get("w", 0).alias("s"), F.when(F.col("turn") % 2 == 0, "inhibits").otherwise("treats").alias("p"), F.when(F.col("conv_id") % 3 == 0, S.upper_by_letter(F.get("w", 0))).otherwise(F.get("w", 1)).alias("o"))
    return claims.where("o IS NOT NULL").where(~S.tautology(F.col("s"), F.col("p"), F.col("o"), R.medical().reflexive())).groupBy("p").agg(F.count("*").alias("n"))


@query
def base_name_match(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Segment "), "c_mktsegment", F.lit(" "), F.col("c_custkey") % 7).alias("name"))
    return names.select("c_custkey", S.base_name(F.col("name")).alias("base"), S.matches_variant(F.lit("segment building 3"), F.col("name")).alias("ok"))


@query
def normalize_entities(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.normalize_entity(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")-"), "p_type")).alias("entity"))


@query
def claim_hash(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", S.hash_entity(F.concat(F.lit(" "), "c_name")).alias("subject_hash"), F.sha2(S.claim_key(F.col("c_name"), F.lit("Prefers"), F.col("c_mktsegment")).cast("binary"), 256).alias("claim_hash"))


# mining


@query
def degree_out(spark, sf_dir):
    return M.top_degrees(kg.demo_graph(spark, sf_dir, SUPPLY).edges, "out", 20)


@query
def degree_in(spark, sf_dir):
    return M.top_degrees(kg.demo_graph(spark, sf_dir, SUPPLY).edges, "in", 20, 5)


@query
def shared_neighbours_head(spark, sf_dir):
    g = kg.demo_graph(spark, sf_dir, ("supplier_part",))
    return M.shared_neighbours(g.edges, "head").groupBy("seed").agg(F.count("*").alias("partners"), F.sum("shared").alias("shared"), F.max("shared").alias("most"))


@query
def shared_neighbours_tail(spark, sf_dir):
    """Types that suppliers have in common, by way of the parts that they supply."""
    e = kg.demo_graph(spark, sf_dir, ("supplier_part", "part_type")).edges
    a, b = e.where("pred = 'supplies'").alias("a"), e.where("pred = 'is_a'").alias("b")
    supplied = a.join(b, F.col("a.dst_id") == F.col("b.src_id")).select("a.src_id", "a.pred", "b.dst_id").distinct()
    return M.shared_neighbours(supplied, "tail").groupBy("seed").agg(F.count("*").alias("partners"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"))


@query
def bridge_candidates(spark, sf_dir):
    found = M.bridge_candidates(kg.demo_graph(spark, sf_dir, ("supplier_part",)).edges, "head")
    return found.select("seed", "pred", "partner", "shared", "claim", r6(F.col("gain"), "gain"))


@query
def missing_links(spark, sf_dir):
    found = M.missing_links(kg.demo_graph(spark, sf_dir, (*PLACES, *TYPES)).edges)
    return found.select("seed", "predicate", "far", r6(F.col("gain"), "gain"))


@query
def structural_holes(spark, sf_dir):
    return M.structural_holes(kg.demo_graph(spark, sf_dir, (*PLACES, *TYPES)).edges).groupBy("far").agg(F.count("*").alias("n"))


@query
def predicate_inventory(spark, sf_dir):
    g = kg.demo_graph(spark, sf_dir)
    return M.predicate_inventory(g.edges, g.entities, kg.demo_registry())


@query
def undeclared_predicates(spark, sf_dir):
    g = kg.demo_graph(spark, sf_dir)
    found = M.predicate_inventory(g.edges, g.entities, kg.demo_registry())
    return found.where("side = 'all'").agg(F.count_if(~F.col("declared")).alias("undeclared"), F.count("*").alias("predicates"))


@query
def nearest_neighbour(spark, sf_dir):
    """The nearest other vector of every hundredth one."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.nearest(v.where("id % 100 = 0"), v)


@query
def truth_energy(spark, sf_dir):
    g = kg.demo_graph(spark, sf_dir, (*PLACES, *TYPES))
    axioms = read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node"))
    return M.truth_energy(g.edges, axioms, 3).where("node NOT LIKE 'part:%'").select("node", r6(F.col("energy"), "energy"))


@query
def conflict_resolution(spark, sf_dir):
    """One claim per supplier and part among what line items say, by status."""
    li = read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "observation").when(F.col("l_returnflag") == "A", "axiom").otherwise("induced")
    claims = li.select("l_suppkey", "l_partkey", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), status.alias("status"), (1 - F.col("l_discount")).alias("confidence"), F.month("l_shipdate").alias("says"))
    return M.resolved_conflicts(claims, ["l_suppkey", "l_partkey"], "says").select("l_suppkey", "l_partkey", "id", "status", "review")


@query
def topic_routing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.tokens(F.col("text")).alias("tokens"))
    topics = R.inline(spark, [{"topic": "english", "t": "the and of that with is"}, {"topic": "french", "t": "le la les des que est"}, {"topic": "german", "t": "der die und das ist ein"}, {"topic": "spanish", "t": "el los las que una es"}], "topic string, t string")
    return M.route_topics(docs, topics.select("topic", S.tokens(F.col("t")).alias("tokens")))


# generalization


def scope_and_edges(spark, sf_dir):
    g = kg.demo_graph(spark, sf_dir, ("customer_nation", "nation_region"))
    scope = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return scope, G.levelled(scope, G.taxonomy_edges(scope, g.edges))


def customer_facts(spark, sf_dir):
    e = kg.demo_graph(spark, sf_dir, ("customer_segment",)).edges
    return e.select(F.col("src_id").alias("child"), "pred", F.col("dst_id").alias("target"), "confidence", F.col("edge_id").alias("source"))


def generalized(spark, sf_dir):
    scope, edges = scope_and_edges(spark, sf_dir)
    parents = G.selected_parents(edges)
    facts = customer_facts(spark, sf_dir)
    return G.assemble(scope, edges, parents, facts, G.lifted_relations(facts, edges, parents))


@query
def taxonomy_levels(spark, sf_dir):
    return scope_and_edges(spark, sf_dir)[1].groupBy("parent", "depth").agg(F.count("*").alias("n"))


def ring_graph(spark, sf_dir):
    """Customers below nations, of which the first nine form a ring and the fourth also lies in a region; the others lie in regions."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    up = lambda df, child, parent: df.select(F.concat_ws("->", child, parent).alias("edge_id"), child.alias("src_id"), F.lit("is_a").alias("pred"), parent.alias("dst_id"), F.lit(1.0).alias("confidence"))
    nation = F.concat(F.lit("nation:"), "n_nationkey")
    edges = up(c, F.concat(F.lit("customer:"), "c_custkey"), F.concat(F.lit("nation:"), "c_nationkey"))
    edges = edges.union(up(n.where("n_nationkey < 9"), nation, F.concat(F.lit("nation:"), (F.col("n_nationkey") + 1) % 9)))
    return edges.union(up(n.where("n_nationkey >= 9 OR n_nationkey = 3"), nation, F.concat(F.lit("region:"), "n_regionkey")))


@query
def strong_components(spark, sf_dir):
    """What lies on cycles, and the least member of each."""
    return P.strong_components(ring_graph(spark, sf_dir))


@query
def cyclic_levels(spark, sf_dir):
    """Levels of a taxonomy with a long cycle, of which no edge may stay."""
    scope = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return G.levelled(scope, G.taxonomy_edges(scope, ring_graph(spark, sf_dir))).groupBy("parent", "depth").agg(F.count("*").alias("n"))


@query
def anchored_proofs(spark, sf_dir):
    """Where suppliers are, asked for in capitals and by name."""
    g = kg.demo_graph(spark, sf_dir, ("supplier_nation", "nation_region"))
    key = F.col("s_suppkey")
    asked = read(spark, sf_dir, "supplier").select(key.alias("req_id"), F.when(key % 2 == 0, F.concat(F.lit(" SUPPLIER:"), key)).otherwise(F.concat(F.lit("Supplier no "), key)).alias("source"), F.lit("located_in").alias("predicate"), F.lit("Region:1").alias("target"))
    names = kg.Graph(g.edges, read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), key).alias("id"), F.concat(F.lit("supplier NO "), key).alias("name")))
    found = E.derive(asked, names, kg.demo_registry(), E.Config(max_hops=2, directed=True, by_name=True))
    return found.select("req_id", "node", "hops", r6(F.col("conf"), "conf"))


@query
def sql_functions(spark, sf_dir):
    """The table functions of SQL over the demo graph, joined like any table."""
    from inferweave.plans.engine import Engine, Generation

    engine = Engine(spark, kg.demo_registry(), E.Config(max_hops=2, directed=True))
    engine.swap(Generation("demo", kg.demo_graph(spark, sf_dir, ("nation_region", "supplier_nation"))))
    return engine.sql(
        "SELECT 'derive' AS what, node AS x, predicate AS y, CAST(hops AS BIGINT) AS n FROM REASON_DERIVE('nation:7') UNION ALL "
        "SELECT 'entails', object, verdict, 1 FROM REASON_ENTAILS('nation:7', 'part of', 'region:3') UNION ALL "
        "SELECT 'entails', object, verdict, 1 FROM REASON_ENTAILS('nation:7', 'part of', 'region:1') UNION ALL "
        "SELECT 'contradicts', '', '', count(*) FROM reason_contradicts('nation:7', 'part_of', 'region:3')"
    )


@query
def select_parents(spark, sf_dir):
    return G.selected_parents(scope_and_edges(spark, sf_dir)[1], G.BuildConfig(min_parent_support=40))


@query
def lift_relations(spark, sf_dir):
    _, edges = scope_and_edges(spark, sf_dir)
    found = G.lifted_relations(customer_facts(spark, sf_dir), edges, G.selected_parents(edges))
    return found.select("parent", "pred", "target", "support", "level", r6(F.col("confidence"), "confidence"), F.size("sources").cast("bigint").alias("n_sources"))


@query
def generalization_nodes(spark, sf_dir):
    return generalized(spark, sf_dir)[0]


@query
def generalization_stats(spark, sf_dir):
    return G.statistics(*generalized(spark, sf_dir))


@query
def stable_relation_ids(spark, sf_dir):
    return generalized(spark, sf_dir)[1].where("lifted OR predicate != 'prefers'").select("id", "source_id", "predicate", "target_id", "support", "lifted")


@query
def dropped_edges(spark, sf_dir):
    """Edges of the demo graph's places and preferences that the generalization graph doesn't hold."""
    _, relations = generalized(spark, sf_dir)
    every = kg.demo_graph(spark, sf_dir, (*PLACES, "customer_segment")).edges
    return G.dropped_edges(every, relations).select("src_id", "pred", "dst_id")


@query
def explained_edges(spark, sf_dir):
    """Preferences that a nation's lifted relation says as well, by segment."""
    _, edges = scope_and_edges(spark, sf_dir)
    facts = customer_facts(spark, sf_dir)
    lifted = G.lifted_relations(facts, edges, G.selected_parents(edges), G.BuildConfig(min_support=12))
    return G.explained_edges(facts, edges, lifted).groupBy("target").agg(F.count("*").alias("n"))


@query
def scope_coverage(spark, sf_dir):
    scope, edges = scope_and_edges(spark, sf_dir)
    return G.coverage(scope, edges).select("covered", "total", r6(F.col("share"), "share"))


@query
def rank_fusion(spark, sf_dir):
    """Suppliers by what they supply and by what they recall, fused."""
    e = kg.demo_graph(spark, sf_dir, SUPPLY).edges
    rank = lambda p: M.ranks(M.degrees(e.where(F.col("pred") == p)), F.desc("degree"), F.col("name")).select(F.col("name").alias("id"), "rank")
    return M.fused_ranks(rank("supplies"), rank("recalls")).select("id", r6(F.col("score"), "score"))


# rules

#: has a place in a region, unless the customer prefers machinery; and what follows from that
DEMO_RULES = [
    U.Rule("based", ("?x", "based_in", "?r", False), [("?x", "located_in", "?n", False), ("?n", "part_of", "?r", False), ("?x", "prefers", "segment:BUILDING", False)], [("?x", "located_in", "nation:3", False)], 0.9),
    U.Rule("served", ("?x", "served_by", "hub:1", False), [("?x", "based_in", "region:1", False), ("?x", "prefers", "segment:MACHINERY", True)], [], 0.8),
]


def place_facts(spark, sf_dir):
    return U.facts_of(kg.demo_graph(spark, sf_dir, ("customer_nation", "nation_region", "customer_segment")).edges)


def compiled():
    return U.compile_rules(DEMO_RULES, kg.demo_registry())[0]


@query
def rule_bindings(spark, sf_dir):
    found = U.rule_bindings(compiled()[0], place_facts(spark, sf_dir), kg.demo_registry())
    return found.select(F.col("`?x`").alias("x"), F.col("`?n`").alias("n"), F.col("`?r`").alias("r"), r6(F.col("conf"), "conf"))


@query
def rule_backward(spark, sf_dir):
    found = U.saturate(compiled(), place_facts(spark, sf_dir), kg.demo_registry())
    return found.select("s", "p", "o", r6(F.col("conf"), "conf"), "steps", "rule_id")


@query
def rule_forward_fire(spark, sf_dir):
    """What fires for an assumed preference."""
    rules = [*compiled(), U.Rule("other", ("?x", "likes", "?y", False), [("?x", "prefers", "segment:NONE", False), ("?x", "located_in", "?y", False)])]
    found = U.fire_rules(rules, place_facts(spark, sf_dir), kg.demo_registry(), [("customer:1", "prefers", "segment:BUILDING")])
    return found.select("rule_id", "s", "p", "o", r6(F.col("conf"), "conf"))


@query
def rule_exception_veto(spark, sf_dir):
    """How many bindings the exception takes away."""
    facts, reg = place_facts(spark, sf_dir), kg.demo_registry()
    rule = compiled()[0]
    free = U.Rule(rule.id, rule.consequent, rule.conditions, [], rule.confidence)
    return U.rule_bindings(free, facts, reg).agg(F.count("*").alias("without")).crossJoin(U.rule_bindings(rule, facts, reg).agg(F.count("*").alias("with_exception")))  # one row each


@query
def assumed_facts_union(spark, sf_dir):
    facts = U.assume(place_facts(spark, sf_dir), [("customer:1", "prefers", "segment:BUILDING"), ("Customer:1", "prefers", "(any) segment BUILDING")])
    return facts.groupBy("p").agg(F.count("*").alias("n"), r6(F.sum("conf"), "total"))


# quantities


@query
def formula_eval(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    inputs = F.create_map(F.lit("weight_kg"), F.col("p_size").cast("double"), F.lit("height_m"), F.when(F.col("p_size") % 10 == 0, 0.0).otherwise(F.col("p_retailprice") / 1000), F.lit("na"), F.col("p_retailprice"), F.lit("glucose_mgdl"), F.lit(150.0), F.lit("sbp"), F.lit(120.0), F.lit("dbp"), F.col("p_size").cast("double"))
    p = p.withColumn("m", inputs)
    return p.select("p_partkey", *[r6(S.formula(f, F.col("m")), f) for f in ("bmi", "map", "corrected_na", "anion_gap")])


@query
def arithmetic_ops(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    a, b = F.col("c_acctbal"), (F.col("c_custkey") % 4).cast("double")
    return c.select("c_custkey", *[r6(S.BINARY[k](a, b), k) for k in ("add", "sub", "mul", "div", "min", "max")], *[r6(S.UNARY[k](a), f"u_{k}") for k in ("neg", "abs", "round", "floor", "ceil", "ln")], *[S.COMPARE[k](a, b).alias(f"c_{k}") for k in S.COMPARE])


@query
def classify_ranges(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.groupBy(S.classify(F.col("s_acctbal"), F.lit(0.0), F.lit(5000.0)).alias("kind")).agg(F.count("*").alias("n"))


@query
def finding_labels(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.groupBy(S.finding_label(F.concat(F.lit(" "), "c_mktsegment"), S.classify(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0))).alias("label")).agg(F.count("*").alias("n"))


# telemetry


def query_events(spark, sf_dir):
    verdict = F.when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "click", "unsupported").otherwise("entailed")
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.concat(F.lit("User:"), "user_id").alias("claim"), verdict.alias("verdict"), "event_type", F.col("value").alias("latency"))


@query
def hot_keys(spark, sf_dir):
    return T.hot_keys(query_events(spark, sf_dir), "user_id", 10)


@query
def unresolved_claims(spark, sf_dir):
    return T.unresolved_claims(query_events(spark, sf_dir), 10)


@query
def latency_p95(spark, sf_dir):
    return T.latency_quantile(query_events(spark, sf_dir), ["event_type"], "latency")


@query
def qps_windows(spark, sf_dir):
    return T.rate_windows(query_events(spark, sf_dir), "ts", "1 hour", 3600)


@query
def session_gaps(spark, sf_dir):
    found = T.idle_gaps(query_events(spark, sf_dir), "user_id", 6 * 3600)
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query
def golden_validation(spark, sf_dir):
    """Golden claims that don't come out as wanted."""
    claims = location_claims(spark, sf_dir)
    wanted = F.when(F.substring("claim_id", -1, 1) == "0", "entailed").otherwise("not-entailed")
    got = E.entails(claims, kg.demo_graph(spark, sf_dir, ("customer_nation", "nation_region")), kg.demo_registry(), E.Config(max_hops=2, directed=True))
    return got.withColumn("wanted", wanted).groupBy(S.verdict_class(F.col("wanted")).alias("wanted"), S.verdict_matches(F.col("wanted"), F.col("verdict")).alias("ok")).agg(F.count("*").alias("n"))


@query
def scope_scoring(spark, sf_dir):
    ev = query_events(spark, sf_dir).withColumn("scope", F.concat(F.lit("scope:"), F.col("user_id") % 10))
    return T.scope_scores(ev, 100.0)


@query
def rate_decay(spark, sf_dir):
    """The decayed rate at the end of each day."""
    return T.ewma_rate(query_events(spark, sf_dir))


@query
def epistemic_upsert(spark, sf_dir):
    """Line items as observations, with those of returned goods put again as axioms."""
    from inferweave.sources.sinks import upsert

    li = read(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_returnflag", F.lit("observation").alias("status"))
    return upsert(li, li.where("l_returnflag = 'R'").withColumn("status", F.lit("axiom")), "id").groupBy("status").agg(F.count("*").alias("n"))


@query
def extract_triples(spark, sf_dir):
    """Edges from extraction results that are made of conversations."""
    from inferweave.sources.readers import extracted_edges

    conv = read(spark, sf_dir, "conversations")
    word = F.split("text", " ")
    triple = F.struct(F.get(word, 0).alias("subject"), F.lit("mentions").alias("predicate"), F.get(word, 1).alias("object"), F.when(F.col("conv_id") % 2 == 0, "always").alias("condition"), F.lit("").alias("location"), F.lit(0.5).alias("confidence"))
    results = conv.select(F.concat_ws("/", "conv_id", "turn").alias("doc"), F.to_json(F.struct(F.array(triple).alias("triples"))).alias("json"))
    return extracted_edges(results).select("id", "subject", "predicate", "object", "status", F.array_join("conditions", ",").alias("conditions"))


@query
def streamed_rates(spark, sf_dir):
    """Hourly counts from a stream over the event table, the last hours included."""
    import uuid

    from inferweave.functions.lineage import shared_folder
    from inferweave.streaming import telemetry as ST

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = ST.rate_stream(ST.event_stream(spark, sf_dir, schema, "events.parquet"), "ts", "1 hour")
    return ST.latest_to_end(stream, f"{folder}/out", f"{folder}/state", ["window_start"])


def queries() -> dict[str, Query]:
    from inferweave.plans import catalog_services  # noqa: F401  adds its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from inferweave.plans import catalog_services

    return ORACLES | catalog_services.ORACLES
