"""Queries of sources, sinks, proofs as data, mining services and quantities, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from inferweave.functions import registry as R
from inferweave.functions import scalars as S
from inferweave.functions.lineage import shared_folder
from inferweave.operators import cognition as C
from inferweave.operators import generalization as G
from inferweave.operators import mining as M
from inferweave.operators import paths as P
from inferweave.operators import reasoning as E
from inferweave.operators import rules as U
from inferweave.operators import telemetry as T
from inferweave.plans import catalog as K
from inferweave.plans.oracles import GENERALIZED, graph
from inferweave.sources import kg, readers, sinks

query, read, r6 = K.query, K.read, K.r6


def folder_of(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# sinks


@query
def emitted_entities(spark, sf_dir):
    """The generalization's nodes that the graph lacks, as entity rows."""
    nodes, _ = K.generalized(spark, sf_dir)
    old = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    out = sinks.in_order(sinks.emit_nodes(nodes.withColumn("name", F.upper("id")), old, "gen"))
    return out.select("id", "name", F.array_join("labels", ",").alias("labels"), "group_id", "attributes")


@query
def emitted_relations(spark, sf_dir):
    """The generalization's relations as edge rows."""
    _, relations = K.generalized(spark, sf_dir)
    named = relations.withColumn("source_name", F.upper("source_id")).withColumn("target_name", F.col("target_id")).withColumn("sources", F.array(F.col("predicate")))
    return sinks.emit_relations(named, "gen").select("id", "source_id", "target_id", "name", "fact", "support", "group_id", "attributes")


def part_rules(spark, sf_dir):
    """A rule per part, read from the JSON lines that it is written to first; every seventh has a consequent that nothing binds."""
    term = lambda entity, var: F.struct(entity.alias("entity"), var.alias("var"))
    no = F.lit(None).cast("string")
    pattern = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), no.alias("predicate_canonical"), o.alias("object"), F.lit(False).alias("negated"))
    var = F.when(F.col("p_partkey") % 7 == 0, "z").otherwise("x")
    fact = pattern(term(F.concat(F.lit(" Brand "), "p_brand"), no), "made_by", term(F.lit("Maker"), no))
    held = pattern(term(no, F.lit("x")), "is_a", term(F.col("p_type"), no))
    rules = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), "p_partkey").alias("id"), F.concat(F.repeat(F.lit("é"), 45), "p_partkey", F.lit(" of a long name")).alias("name"), F.lit(0.5).alias("confidence"), F.array(held, fact).alias("conditions"), pattern(term(no, var), "sold_as", term(F.col("p_brand"), no)).alias("consequent"), F.array().cast(f"array<{readers.PATTERN}>").alias("exceptions"))
    folder = folder_of(spark)
    rules.write.json(folder)
    return readers.read_rules_jsonl(spark, folder).join(rules.select("id", "name"), "id")


@query
def stored_rules(spark, sf_dir):
    """Rules to rule rows and back: what can be loaded of them, and how long their names may be."""
    rows = sinks.rule_nodes(part_rules(spark, sf_dir), "rules")
    odd = rows.limit(0).union(spark.createDataFrame([], rows.schema))
    more = rows.where("uuid LIKE '%5'").withColumn("attributes", F.lit("{}")).unionByName(odd)
    found = readers.decode_rules(rows.unionByName(more))
    return found.groupBy("state", F.octet_length("name").alias("bytes")).agg(F.count("*").alias("n"))


@query
def rule_facts(spark, sf_dir):
    """The facts that rules' conditions state about entities."""
    return sinks.condition_facts(part_rules(spark, sf_dir)).select("edge_id", "src_id", "pred_raw", "dst_id")


@query
def backed_up_edges(spark, sf_dir):
    """Edges that the generalization drops, with ids of their batch and the marker of what dropped them."""
    _, relations = K.generalized(spark, sf_dir)
    every = kg.demo_graph(spark, sf_dir, ("supplier_nation",)).edges
    gone = G.dropped_edges(every, relations).select(F.col("edge_id").alias("id"), "src_id", F.array("pred").alias("sources"))
    return sinks.dropped_backup(gone, "places", "batch-1").select("id", "src_id", F.array_join("sources", ",").alias("sources"))


@query
def snapshot_versions(spark, sf_dir):
    """Two versions, one that fails its validation, and the way back: what each reader sees."""
    folder, n = folder_of(spark), read(spark, sf_dir, "nation").select("n_nationkey")
    seen = lambda when: sinks.read_snapshot(spark, folder).agg(F.lit(when).alias("moment"), F.count("*").alias("n"))
    sinks.publish_snapshot(n, folder)
    first = seen("first")
    sinks.publish_snapshot(n.where("n_nationkey < 7"), folder, lambda d: d.count() == 7)
    second = seen("second")
    try:
        sinks.publish_snapshot(n.limit(0), folder, lambda d: d.count() > 0)
    except ValueError:
        third = seen("rejected")
    sinks.rollback_snapshot(spark, folder)
    return first.union(second).union(third).union(seen("back"))


# sources


@query
def golden_files(spark, sf_dir):
    """Golden claims of a JSON file with the verdict under several spellings."""
    spelled = lambda name, k: F.when(F.col("n_nationkey") % 4 == k, F.concat(F.lit("v"), F.col("n_nationkey") % 3)).alias(name)
    claim = F.struct(F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("n_regionkey").cast("string").alias("object"))
    case = F.struct(claim.alias("claim"), spelled("wantVerdictClass", 0), spelled("want_verdict_class", 1), spelled("verdict", 2), spelled("want", 3))
    folder = folder_of(spark)
    read(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("value")).coalesce(1).write.text(folder)
    return readers.read_golden(spark, folder).select("subject", "predicate", "object", "wanted")


@query
def scope_files(spark, sf_dir):
    """Names of a scope file, by lines and commas, with comments and repeats."""
    folder = folder_of(spark)
    lines = read(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" , nation "), F.col("c_nationkey"), F.lit("# not this,"), "c_name").alias("value"))
    lines.write.text(folder)
    return readers.read_scope(spark, folder)


@query
def rules_of_extractions(spark, sf_dir):
    """Meta relations of extraction results that are made of nations."""
    rule = F.struct(F.concat(F.lit("in "), "n_name").alias("antecedent"), F.concat(F.lit("in region "), "n_regionkey").alias("consequent"), F.lit("default").alias("rule_type"), F.lit(0.7).alias("confidence"))
    results = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc"), F.to_json(F.struct(F.array(rule).alias("rules"))).alias("json"))
    return readers.extracted_rules(results).select("id", "head", F.get_json_object("body", "$.antecedent").alias("antecedent"), "frequency", "confidence")


@query
def resolved_entities(spark, sf_dir):
    """Suppliers whose names agree whatever the case are one node; edges between aliases of one node go."""
    s = read(spark, sf_dir, "supplier")
    key = F.concat(F.lit("supplier:"), F.col("s_suppkey"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Place "), "s_nationkey")).otherwise(F.concat(F.lit(" PLACE "), "s_nationkey"))
    found = G.resolved_entities(s.select(key.alias("id"), name.alias("name")))
    edges = s.select(key.alias("src_id"), F.concat(F.lit("supplier:"), F.floor(F.col("s_suppkey") / 2)).alias("dst_id"))
    return G.on_nodes(edges, found).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


# proofs as data


@query
def proof_documents(spark, sf_dir):
    """Proofs to JSON and back."""
    g = kg.demo_graph(spark, sf_dir, ("customer_nation", "nation_region"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), F.concat(F.lit("customer:"), "c_custkey").alias("source"))
    found = E.proof_json(E.derive(asked, g, kg.demo_registry(), E.Config(max_hops=2, directed=True)))
    back = E.proofs_of_json(found.select("req_id", "proof"))
    return back.select("req_id", "hops", "predicate", r6(F.col("conf"), "conf"), F.array_join(F.transform("steps", lambda x: F.concat_ws(">", x["source"], x["target"])), " ").alias("steps"))


@query
def shortest_proofs(spark, sf_dir):
    """The shortest ways from each region, against the edges too, with their nodes."""
    g = kg.demo_graph(spark, sf_dir, ("supplier_nation", "nation_region"))
    starts = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("req_id"), F.concat(F.lit("region:"), "r_regionkey").alias("start"))
    return P.shortest_paths(starts, g.edges, 2).select("req_id", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("ids", ",").alias("ids"))


@query
def native_claims(spark, sf_dir):
    """Claims in the shortest-path mode, by the name of its backend."""
    c = read(spark, sf_dir, "customer")
    claims = c.select(F.col("c_custkey").cast("string").alias("claim_id"), F.concat(F.lit("customer:"), "c_custkey").alias("subject"), F.lit("located_in").alias("predicate"), F.concat(F.lit("nation:"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(F.col("c_custkey") % 25)).alias("object"))
    got = E.answer(claims, kg.demo_graph(spark, sf_dir, ("customer_nation",)), kg.demo_registry(), "native", E.Config(max_hops=1))
    return got.select("claim_id", "verdict", r6(F.col("confidence"), "confidence"))


@query
def conditional_contexts(spark, sf_dir):
    """Conditions of paths, and which of them contradict each other."""
    c = read(spark, sf_dir, "customer")
    word = F.concat(F.lit("c"), F.col("c_custkey") % 3)
    against = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("not "), word)).otherwise(F.lit("b"))
    got = E.joined_contexts(c.select("c_custkey", F.array(F.array(word), F.array(against, word)).alias("contexts"), F.lit(0.5).alias("conf")))
    return got.select("c_custkey", F.array_join("conditions", ",").alias("conditions"), "conf")


@query
def supported_diagnoses(spark, sf_dir):
    """Types that parts found at a supplier speak for, directly or by a class."""
    g = kg.demo_graph(spark, sf_dir, TYPE_PARTS)
    edges = g.edges.withColumn("pred", F.when(F.col("edge_id").startswith("e:pt:"), "symptom_of").otherwise(F.col("pred")))
    findings = read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("case"), F.concat(F.lit("part:"), "p_partkey").alias("finding"))
    return E.supports_diagnosis(findings, kg.Graph(edges), "symptom_of", E.Config(max_hops=2)).withColumnRenamed("case", "patient")


TYPE_PARTS = ("part_type", "type_any")


# mining services


@query
def communities(spark, sf_dir):
    """Two rounds of label propagation over nations and regions."""
    return M.communities(kg.demo_graph(spark, sf_dir, ("nation_region",)).edges, 2)


@query
def plausible_claims(spark, sf_dir):
    """Claims about parts that are no tautologies and whose ends are plausible names."""
    p = read(spark, sf_dir, "part")
    claims = p.select(F.col("p_name").alias("subject"), F.lit("treats").alias("predicate"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" due to a "), "p_brand")).otherwise(F.col("p_brand")).alias("object"), "p_partkey")
    return C.plausible_claims(claims, R.medical()).select("p_partkey", "object")


def questions(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    key = F.concat(F.lit("supplier:"), "s_suppkey")
    missing = s.select(key.alias("seed"), F.lit("near").alias("predicate"), F.concat(F.lit("region:"), F.col("s_suppkey") % 5).alias("far"), (F.col("s_suppkey") / 10).alias("gain"))
    bridges = s.select(F.upper(key).alias("seed"), F.lit("NEAR").alias("claim"), F.concat(F.lit("region:"), F.col("s_suppkey") % 5).alias("partner"), F.lit(0.5).alias("gain"))
    return C.thoughts(missing, bridges, s.select(key.alias("subject"), F.lit("supplies").alias("predicate"), F.lit("part:1").alias("object")))


@query
def proposed_questions(spark, sf_dir):
    return questions(spark, sf_dir).select("subject", "predicate", "object", "rationale", r6(F.col("gain"), "gain"))


@query
def question_store(spark, sf_dir):
    """The newest distinct questions that fit in a store of seven."""
    at = F.when(F.col("rationale") == "two hops apart without a link", 0).otherwise(100) + F.substring_index("subject", ":", -1).cast("int")
    found = C.bounded_store(questions(spark, sf_dir).withColumn("moment", at), "moment", 7)
    return found.select("subject", "predicate", "object", r6(F.col("gain"), "gain"), "moment")


@query
def exported_questions(spark, sf_dir):
    """Questions with hashes in place of names, and what came of them."""
    found = C.exported(questions(spark, sf_dir).withColumn("outcome", C.outcome(F.when(F.col("gain") > 0.6, "entailed").otherwise("contradicted"), F.col("predicate") == "supplies")))
    return found.select("predicate", "subject_hash", "object_hash", "outcome")


@query
def rates_and_counts(spark, sf_dir):
    """Counts by kind, and the share of cache hits."""
    ev = read(spark, sf_dir, "events").withColumn("cache_status", F.when(F.col("event_id") % 4 == 0, "hit").when(F.col("event_id") % 4 == 1, "singleflight").when(F.col("event_id") % 4 == 2, "miss"))
    ratio = T.cache_ratio(ev).select(F.lit("ratio").alias("value"), F.col("lookups").alias("n"), r6(F.col("ratio"), "ratio"))
    return T.counters(ev, "event_type").select("value", "n", F.lit(0.0).alias("ratio")).unionByName(ratio)


@query
def changed_statistics(spark, sf_dir):
    """What the generalization's statistics gain when supported parents are asked for."""
    scope, edges = K.scope_and_edges(spark, sf_dir)
    count = lambda e: e.groupBy(F.concat(F.lit("level:"), "depth").alias("measure")).agg(F.count("*").alias("n"))
    return G.statistic_changes(count(edges.where("depth = 1")), count(edges)).select("measure", "n", "change")


@query
def topic_rule_sets(spark, sf_dir):
    """Rules of a topic: shared ones and its own."""
    shared, own = K.compiled(), {"places": [U.Rule("near", ("?x", "near", "?r", False), [("?x", "based_in", "?r", False)])]}
    rows = [{"topic": t, "rule_id": r.id, "n": len(r.conditions)} for t in ("places", "other") for r in U.topic_rules(shared, own, t)]
    return R.inline(spark, rows, "topic string, rule_id string, n int")


@query
def registry_layers(spark, sf_dir):
    """A registry of JSON: types, warnings, errors and fingerprints, whatever the order of what it declares."""
    kinds = [{"name": "Drug", "supertypes": ["Thing"]}, {"name": "Thing", "supertypes": ["Missing"]}]
    preds = [{"canonical": "cures", "sub_property_of": ["treats2"], "domain": ["Drug"], "range": ["Nowhere"]}, {"canonical": "treats2", "inverse_of": "treated2_by"}, {"canonical": "treated2_by", "inverse_of": "treats2"}]
    one = R.load_registry(json.dumps({"types": kinds, "predicates": preds, "aliases": {"heals": "cures"}}))
    other = R.load_registry(json.dumps({"types": kinds[::-1], "predicates": preds[::-1], "aliases": {"heals": "cures"}}))

    def fails(data):
        try:
            R.load_registry(json.dumps(data))
        except ValueError:
            return True
        return False

    rows = [
        ("is_a", one.is_a("Drug", "Thing") and not one.is_a("Thing", "Drug")),
        ("canonical", one.canonical(" HEALS ") == "cures"),
        ("accepted", one.accepted("treats2") == ["cures", "treated2_by", "treats2"]),
        ("types", one.check_types("cures", ["Drug"], [])[0] and not one.check_types("cures", ["Thing"], [])[0]),
        ("warnings", len(one.warnings) == 2),
        ("fingerprint", one.fingerprint() == other.fingerprint() != R.general().fingerprint()),
        ("unknown pack", fails({"extends": "nothing"})),
        ("unknown alias", fails({"aliases": {"a": "nothing"}})),
        ("unknown super", fails({"predicates": [{"canonical": "p", "sub_property_of": ["nothing"]}]})),
    ]
    return R.inline(spark, [{"what": w, "ok": ok} for w, ok in rows], "what string, ok boolean")


@query
def more_quantities(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    m = F.create_map(F.lit("mg_per_kg"), F.when(F.col("p_size") % 5 > 0, size), F.lit("weight_kg"), F.col("p_retailprice"))
    return p.select("p_partkey", r6(S.BINARY["pow"](size, F.lit(0.5)), "pow"), r6(S.UNARY["sqrt"](size), "sqrt"), r6(S.formula("dose_by_weight", m), "dose"), S.grounded(F.col("p_name"), F.when(F.col("p_size") > 9, "x").otherwise(" ")).alias("grounded"))


QUESTIONS = """q AS (SELECT 'supplier:' || s_suppkey AS subject, 'near' AS predicate, 'region:' || s_suppkey % 5 AS object, 'two hops apart without a link' AS rationale, s_suppkey / 10.0 AS gain FROM supplier
 UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'NEAR', 'region:' || s_suppkey % 5, 'many common neighbours', 0.5 FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'supplies', 'part:1', 'asked for without an answer', 0.85 FROM supplier)"""

ORACLES = {
    "emitted_entities": GENERALIZED + """SELECT id, upper(id) AS name, max(kind) AS labels, 'gen' AS group_id, '{"kind":"' || max(kind) || '","depth":' || max(depth) || ',"support":' || max(support) || '}' AS attributes FROM nodes WHERE kind <> 'scope' GROUP BY id""",
    "emitted_relations": GENERALIZED + """SELECT DISTINCT id, source_id, target_id, predicate AS name, upper(source_id) || ' ' || predicate || ' ' || target_id AS fact, support, 'gen' AS group_id, '{"lifted":' || lifted || ',"sources":["' || predicate || '"],"support":' || support || '}' AS attributes FROM rel""",
    "stored_rules": "WITH r AS (SELECT p_partkey, least(100, 90 + strlen(p_partkey || ' of a long name')) AS bytes FROM part) SELECT CASE WHEN p_partkey % 7 = 0 THEN 'skipped_invalid' ELSE 'loaded' END AS state, bytes, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'skipped_no_structured', bytes, count(*) FROM r WHERE p_partkey % 10 = 5 GROUP BY ALL",
    "rule_facts": "SELECT 'rel:r' || p_partkey || ':1' AS edge_id, 'ent:' || sha1(lower('brand ' || p_brand)) AS src_id, 'made_by' AS pred_raw, 'ent:' || sha1('maker') AS dst_id FROM part",
    "backed_up_edges": "SELECT 'gg-' || substr(sha1('batch-1' || chr(0) || 'e:sn:' || s_suppkey), 1, 20) AS id, 'supplier:' || s_suppkey AS src_id, 'located_in,dropped_by:build-generalization:places' AS sources FROM supplier",
    "snapshot_versions": "SELECT * FROM (VALUES ('first', 25), ('second', 7), ('rejected', 7), ('back', 25)) v(moment, n)",
    "golden_files": "SELECT n_name AS subject, 'part_of' AS predicate, n_regionkey::VARCHAR AS object, 'v' || n_nationkey % 3 AS wanted FROM nation",
    "scope_files": "SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT 'nation ' || c_nationkey FROM customer",
    "rules_of_extractions": "SELECT 'rule:' || n_nationkey || ':0' AS id, 'in region ' || n_regionkey AS head, 'in ' || n_name AS antecedent, 1 AS frequency, 0.7::DOUBLE AS confidence FROM nation",
    "resolved_entities": "WITH n AS (SELECT s_suppkey AS k, min('supplier:' || s_suppkey) OVER (PARTITION BY s_nationkey) AS node FROM supplier) SELECT a.node AS src_id, coalesce(b.node, 'supplier:' || a.k // 2) AS dst_id, count(*) AS n FROM n a LEFT JOIN n b ON b.k = a.k // 2 WHERE a.node <> coalesce(b.node, 'supplier:' || a.k // 2) GROUP BY ALL",
    "proof_documents": f"WITH {graph('customer_nation', 'nation_region')} SELECT c_custkey AS req_id, 1 AS hops, 'located_in' AS predicate, 1.0::DOUBLE AS conf, a.src_id || '>' || a.dst_id AS steps FROM customer JOIN e a ON a.src_id = 'customer:' || c_custkey UNION ALL SELECT c_custkey, 2, 'located_in', round(a.confidence * b.confidence * 0.9, 6), a.src_id || '>' || a.dst_id || ' ' || b.src_id || '>' || b.dst_id FROM customer JOIN e a ON a.src_id = 'customer:' || c_custkey JOIN e b ON b.src_id = a.dst_id",
    "shortest_proofs": "SELECT n_regionkey AS req_id, 1 AS hops, 'region:' || n_regionkey || '>nation:' || n_nationkey AS nodes, 'e:nr:' || n_nationkey AS ids FROM nation UNION ALL SELECT n_regionkey, 2, 'region:' || n_regionkey || '>nation:' || n_nationkey || '>supplier:' || s_suppkey, 'e:nr:' || n_nationkey || ',e:sn:' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "native_claims": "SELECT c_custkey::VARCHAR AS claim_id, CASE WHEN ok THEN 'entailed' ELSE 'unsupported' END AS verdict, CASE WHEN ok THEN 0.8::DOUBLE ELSE 0 END AS confidence FROM (SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 25 = c_nationkey AS ok FROM customer)",
    "conditional_contexts": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey % 3 || ',not c' || c_custkey % 3 ELSE 'b,c' || c_custkey % 3 END AS conditions, CASE WHEN c_custkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.5 END AS conf FROM customer",
    "supported_diagnoses": "SELECT DISTINCT p_partkey % 10 AS patient, 'type:' || p_type AS disease, 'direct' AS support FROM part UNION SELECT p_partkey % 10, 'type:ANY', 'by_subclass' FROM part",
    "communities": """WITH e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation),
 l1 AS (SELECT a AS node, b AS label FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = 1)
 SELECT a AS node, label FROM (SELECT a, label, count(*) AS n FROM e JOIN l1 ON l1.node = e.b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1""",
    "plausible_claims": "SELECT p_partkey, p_brand AS object FROM part WHERE p_partkey % 3 = 2 AND lower(trim(p_name)) <> lower(p_brand)",
    "proposed_questions": f"WITH {QUESTIONS} SELECT subject, predicate, object, rationale, round(gain, 6)::DOUBLE AS gain FROM q",
    "question_store": f"""WITH {QUESTIONS}, t AS (SELECT *, CASE WHEN rationale LIKE 'two%' THEN 0 ELSE 100 END + split_part(subject, ':', 2)::INT AS moment FROM q),
 f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lower(subject), lower(predicate), lower(object) ORDER BY moment) = 1)
 SELECT subject, predicate, object, round(least(1, gain), 6)::DOUBLE AS gain, moment FROM f ORDER BY moment DESC, subject, predicate, object LIMIT 7""",
    "exported_questions": f"WITH {QUESTIONS} SELECT predicate, sha256(subject) AS subject_hash, sha256(object) AS object_hash, CASE WHEN predicate = 'supplies' THEN 'known' WHEN gain > 0.6 THEN 'confirmed' ELSE 'conflict' END AS outcome FROM q",
    "rates_and_counts": "SELECT event_type AS value, count(*) AS n, 0.0::DOUBLE AS ratio FROM events GROUP BY 1 UNION ALL SELECT 'ratio', count(*) FILTER (WHERE event_id % 4 < 3), round(count(*) FILTER (WHERE event_id % 4 = 0) / count(*) FILTER (WHERE event_id % 4 < 3), 6) FROM events",
    "changed_statistics": GENERALIZED + "SELECT 'level:' || depth AS measure, count(*) FILTER (WHERE depth = 1) AS n, count(*) FILTER (WHERE depth = 1) - count(*) AS change FROM tax GROUP BY depth",
    "topic_rule_sets": "SELECT * FROM (VALUES ('places', 'based', 3), ('places', 'served', 2), ('places', 'near', 1), ('other', 'based', 3), ('other', 'served', 2)) v(topic, rule_id, n)",
    "registry_layers": "SELECT unnest(['is_a', 'canonical', 'accepted', 'types', 'warnings', 'fingerprint', 'unknown pack', 'unknown alias', 'unknown super']) AS what, true AS ok",
    "more_quantities": "SELECT p_partkey, round(sqrt(p_size::DOUBLE), 6) AS pow, round(sqrt(p_size::DOUBLE), 6) AS sqrt, CASE WHEN p_size % 5 > 0 THEN round(p_size::DOUBLE * p_retailprice, 6) END AS dose, trim(p_name) <> '' AND p_size > 9 AS grounded FROM part",
}
