"""What the queries mean, restated in SQL over the source tables."""

from __future__ import annotations

from inferweave.functions.registry import general, medical
from inferweave.sources.kg import DEMO

#: Canonical names of the demo graph's surface forms.
CANON = "CASE pred_raw WHEN 'located in' THEN 'located_in' WHEN 'part of' THEN 'part_of' WHEN 'is a' THEN 'is_a' WHEN 'subtype of' THEN 'is_a' WHEN 'instance of' THEN 'instance_of' ELSE pred_raw END"


def graph(*parts: str) -> str:
    """A common table expression e of the demo graph's edges."""
    body = " UNION ALL ".join(DEMO[p] for p in parts or DEMO)
    first = DEMO["customer_nation"] + " WHERE false UNION ALL "
    return f"raw AS ({first}{body}), e AS (SELECT *, {CANON} AS pred FROM raw)"


PLACES = ("customer_nation", "supplier_nation", "nation_region")
TYPES = ("part_type", "type_any", "part_brand", "brand_maker")
SUPPLY = ("supplier_part", "supplier_recall")


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


def entity(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


FOLD = "CASE WHEN a.pred = 'located_in' AND b.pred = 'part_of' THEN 'located_in' WHEN a.pred = 'instance_of' AND b.pred = 'is_a' THEN 'instance_of' WHEN a.pred = 'supplies' AND b.pred = 'is_a' THEN 'supplies' WHEN a.pred = b.pred AND a.pred IN ('is_a', 'part_of', 'located_in') THEN a.pred END"

#: A taxonomy whose first nine nations form a ring, all that reaches what, and what reaches each other.
RING = """WITH RECURSIVE e AS (SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS d FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || (n_nationkey + 1) % 9 FROM nation WHERE n_nationkey < 9
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_nationkey >= 9 OR n_nationkey = 3),
reach(s, d) AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM reach r JOIN e ON e.s = r.d),
both_ways AS (SELECT a.s, a.d FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s)
"""

GENERALIZED = f"""WITH {graph("customer_nation", "nation_region", "customer_segment")},
tax AS (SELECT src_id AS child, dst_id AS parent, pred, CASE WHEN pred = 'located_in' THEN 1 ELSE 2 END AS depth FROM e
        WHERE pred = 'located_in' OR pred = 'part_of' AND src_id IN (SELECT dst_id FROM e WHERE pred = 'located_in')),
kids AS (SELECT parent, count(DISTINCT child) AS children, max(depth) AS depth FROM tax GROUP BY parent),
seed AS (SELECT parent FROM kids WHERE children >= 2),
kept AS (SELECT * FROM kids WHERE parent IN (SELECT parent FROM seed) OR parent IN (SELECT child FROM tax JOIN seed USING (parent))),
facts AS (SELECT src_id AS child, pred, dst_id AS target, confidence, edge_id FROM e WHERE pred = 'prefers'),
b1 AS (SELECT parent, f.pred, target, count(DISTINCT child) AS support, avg(confidence) * count(DISTINCT child) / max(children) AS confidence, count(DISTINCT edge_id) AS n_sources, list(edge_id) AS ids
       FROM facts f JOIN tax USING (child) JOIN kept USING (parent) GROUP BY ALL),
b2 AS (SELECT t.parent, b1.pred, target, count(DISTINCT b1.parent) AS support, avg(b1.confidence) * count(DISTINCT b1.parent) / max(k.children) AS confidence, sum(n_sources) AS n_sources
       FROM b1 JOIN tax t ON t.child = b1.parent JOIN kept k ON k.parent = t.parent GROUP BY ALL),
lift AS (SELECT parent, pred, target, support, 1 AS level, confidence, n_sources FROM b1 WHERE support >= 2
         UNION ALL SELECT parent, pred, target, support, 2, confidence, n_sources FROM b2 WHERE support >= 2),
nodes AS (SELECT src_id AS id, 'scope' AS kind, 0 AS depth, 1::BIGINT AS support FROM e WHERE pred = 'located_in'
          UNION ALL SELECT parent, 'concept', depth, children FROM kept
          UNION ALL SELECT DISTINCT target, 'endpoint', 0, 0 FROM facts),
rel AS (SELECT 'gg-' || substr(sha1(child || chr(0) || pred || chr(0) || parent), 1, 20) AS id, child AS source_id, pred AS predicate, parent AS target_id, 1::BIGINT AS support, false AS lifted FROM tax WHERE parent IN (SELECT parent FROM kept)
        UNION ALL SELECT 'gg-' || substr(sha1(child || chr(0) || pred || chr(0) || target), 1, 20), child, pred, target, 1, false FROM facts
        UNION ALL SELECT 'gg-' || substr(sha1(parent || chr(0) || pred || chr(0) || target || chr(0) || 'lifted'), 1, 20), parent, pred, target, support, true FROM lift)
"""

RULES = f"""WITH {graph("customer_nation", "nation_region", "customer_segment")},
f AS (SELECT {entity("src_id")} AS s, pred AS p, {entity("dst_id")} AS o, confidence AS c FROM e),
based AS (SELECT a.s AS x, a.o AS n, b.o AS r, a.c * b.c * d.c AS conf FROM f a JOIN f b ON a.o = b.s AND b.p = 'part_of' JOIN f d ON d.s = a.s AND d.p = 'prefers' AND d.o = 'segment building' WHERE a.p = 'located_in'),
vetoed AS (SELECT * FROM based WHERE x NOT IN (SELECT s FROM f WHERE p = 'located_in' AND o = 'nation 3')),
d1 AS (SELECT x AS s, 'based_in' AS p, r AS o, 0.9::DOUBLE * conf * pow(0.9::DOUBLE, 4) AS conf, 4 AS steps, 'based' AS rule_id FROM vetoed),
d2 AS (SELECT s, 'served_by' AS p, 'hub 1' AS o, 0.8::DOUBLE * conf * pow(0.9::DOUBLE, 5) AS conf, 5 AS steps, 'served' AS rule_id FROM d1 WHERE o = 'region 1' AND s NOT IN (SELECT s FROM f WHERE p = 'prefers' AND o = 'segment machinery'))
"""

EVENTS = "q AS (SELECT event_id, ts, user_id, 'user:' || user_id AS claim, CASE event_type WHEN 'error' THEN 'contradicted' WHEN 'click' THEN 'unsupported' ELSE 'entailed' END AS verdict, event_type, value AS latency FROM events)"
LOCATED = "located AS (SELECT 'c' || c_custkey AS claim_id, c_custkey, n_regionkey = c_custkey % 5 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SUPPLY_CLAIMS = "claims AS (SELECT DISTINCT 's:' || l_suppkey || ':' || l_partkey AS claim_id, 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS o FROM lineitem)"

_general, _medical = general(), medical()
# the facts of the packs, from which SQL derives what the registry derives
DIRECT_SUPERS = values([(p, q) for p, (_, supers, _) in _medical.predicates.items() for q in [p, *supers]])
INVERSES = values([(p, i) for p, (i, _, _) in _medical.predicates.items() if i])
GENERAL_PREDS = values([(p, "T" if "T" in c else "") for p, (_, _, c) in _general.predicates.items()])
GENERAL_RULES = values(_general.compositions)
CLOSURE = f"sup(pred, super) AS (SELECT * FROM {DIRECT_SUPERS} v UNION SELECT s.pred, d.col1 FROM sup s JOIN {DIRECT_SUPERS} d ON d.col0 = s.super)"

ORACLES: dict[str, str] = {
    "derive_two_hop": f"WITH {graph(*PLACES, *TYPES, 'supplier_part')}, p AS (SELECT {FOLD} AS predicate, round(a.confidence * b.confidence * 0.9::DOUBLE, 6) AS c FROM e a JOIN e b ON a.dst_id = b.src_id WHERE a.src_id <> b.dst_id) SELECT predicate, count(*) AS n, round(sum(c), 3) AS total FROM p WHERE predicate IS NOT NULL GROUP BY predicate",
    "derive_bounded_paths": f"""WITH RECURSIVE {graph("supplier_nation", "nation_region")}, u AS (SELECT src_id, dst_id, pred, confidence FROM e UNION ALL SELECT dst_id, src_id, pred, confidence FROM e),
 p AS (SELECT s_suppkey AS req_id, ['supplier:' || s_suppkey, u.dst_id] AS nodes, [u.pred] AS preds, u.confidence AS conf, 1 AS hops FROM supplier JOIN u ON u.src_id = 'supplier:' || s_suppkey
  UNION ALL SELECT req_id, list_append(nodes, u.dst_id), list_append(preds, u.pred), conf * u.confidence * 0.9::DOUBLE, hops + 1 FROM p JOIN u ON u.src_id = nodes[-1] WHERE hops < 3 AND NOT list_contains(nodes, u.dst_id)),
 f AS (SELECT *, CASE WHEN hops = 1 THEN preds[1] WHEN len(list_distinct(preds)) = 1 THEN preds[1]
   WHEN preds[1] = 'located_in' AND len(list_filter(preds[2:], lambda x: x <> 'part_of')) = 0 THEN 'located_in' ELSE '' END AS predicate FROM p)
 SELECT req_id, hops, predicate, count(*) AS n, round(sum(round(conf, 6)), 4) AS total FROM f GROUP BY ALL""",
    "shortest_path_bfs": """WITH d AS (SELECT 'region:' || r_regionkey AS start, 0 AS hops, 1 AS n FROM region
 UNION ALL SELECT 'region:' || n_regionkey, 1, count(*) FROM nation GROUP BY n_regionkey
 UNION ALL SELECT 'region:' || n_regionkey, 2, count(*) FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY n_regionkey) SELECT start, hops, n::BIGINT AS n FROM d""",
    "transitive_closure_is_a": f"WITH RECURSIVE {graph(*TYPES)}, i AS (SELECT DISTINCT src_id, dst_id FROM e WHERE pred = 'is_a'), c AS (SELECT src_id, dst_id, 1 AS hops FROM i UNION SELECT c.src_id, i.dst_id, hops + 1 FROM c JOIN i ON c.dst_id = i.src_id WHERE hops < 4) SELECT src_id, dst_id, min(hops) AS hops FROM c GROUP BY ALL",
    "entails_claims": f"""WITH {graph(*SUPPLY)}, {SUPPLY_CLAIMS}, {LOCATED},
 s AS (SELECT claim_id, max(CASE WHEN pred = 'recalls' THEN 1 END) AS bad, max(CASE WHEN pred = 'supplies' AND status = '' THEN confidence END) AS conf FROM claims c LEFT JOIN e ON e.src_id = c.s AND e.dst_id = c.o GROUP BY claim_id)
 SELECT claim_id, CASE WHEN ok THEN 'entailed' ELSE 'unsupported' END AS verdict, CASE WHEN ok THEN 0.855::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN ok THEN 'located_in' ELSE '' END AS proof_predicate FROM located
 UNION ALL SELECT claim_id, CASE WHEN bad = 1 THEN 'contradicted' WHEN conf IS NOT NULL THEN 'entailed' ELSE 'unsupported' END, round(CASE WHEN bad = 1 THEN 1.0::DOUBLE ELSE coalesce(conf, 0) END, 6), CASE WHEN bad IS NULL AND conf IS NOT NULL THEN 'supplies' ELSE '' END FROM s""",
    "constrained_claims": "SELECT 'unsupported' AS verdict, count(*) AS n FROM customer",
    "contradicts_class": "SELECT 'p' || p_partkey AS claim_id, lower('type:' || p_type) AS class, 1 AS hops FROM part WHERE p_type IN ('PROMO', 'STANDARD')",
    "contradicts_predicate": f"WITH {graph(*SUPPLY)}, {SUPPLY_CLAIMS} SELECT claim_id, 'recalls' AS witness_predicate, min(dst_id) AS witness_object FROM claims JOIN e ON src_id = s AND pred = 'recalls' AND (dst_id = o OR starts_with(dst_id, o || ' ')) GROUP BY claim_id",
    "topk_proofs": f"""WITH {graph("supplier_part", "part_type")}, p AS (SELECT split_part(a.src_id, ':', 2)::BIGINT AS req_id, round(a.confidence * b.confidence * 0.9::DOUBLE, 6) AS conf, a.confidence * b.confidence * 0.9::DOUBLE AS x, [a.edge_id, b.edge_id] AS ids
 FROM e a JOIN e b ON a.dst_id = b.src_id WHERE a.pred = 'supplies' AND a.status = '' AND b.dst_id = 'type:PROMO')
 SELECT req_id, (row_number() OVER (PARTITION BY req_id ORDER BY round(x, 9) DESC, ids))::INT AS rank, 2 AS hops, 'supplies' AS predicate, conf, array_to_string(ids, ',') AS ids FROM p QUALIFY rank <= 3""",
    "canonicalize_predicates": f"WITH {graph()} SELECT pred_raw, pred, count(*) AS n FROM e GROUP BY ALL",
    "effective_predicate": f"""WITH g AS (SELECT col0 AS p, col1 AS t FROM {GENERAL_PREDS} v), r AS (SELECT col0 AS a, col1 AS b, col2 AS c FROM {GENERAL_RULES} v)
 SELECT x.p AS a, y.p AS b, coalesce(r.c, x.p) AS predicate FROM g x CROSS JOIN g y LEFT JOIN r ON r.a = x.p AND r.b = y.p WHERE r.c IS NOT NULL OR (x.p = y.p AND x.t = 'T')""",
    "subproperty_closure": f"WITH RECURSIVE {CLOSURE} SELECT pred, super FROM sup",
    "accepted_predicates": f"WITH RECURSIVE {CLOSURE}, t AS (SELECT DISTINCT pred FROM sup), w AS (SELECT pred AS goal, pred AS target FROM t UNION SELECT col0, col1 FROM {INVERSES} v) SELECT goal AS pred, count(DISTINCT sup.pred) AS n FROM w JOIN sup ON sup.super = w.target GROUP BY goal",
    "domain_range_check": "SELECT 'located_in' AS pred, true AS ok, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'supplies', true, count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
    "quarantine_status": f"WITH {graph('supplier_part')} SELECT src_id, count(*) AS n FROM e WHERE status = '' GROUP BY src_id",
    "label_filter": "SELECT 'located_in' AS pred, count(*) AS n FROM customer UNION ALL SELECT 'part_of', count(*) FROM nation",
    "plausible_entities": "SELECT doc_id, name FROM (SELECT doc_id, split_part(text, '.', 1) AS name FROM documents) WHERE trim(name, ' ') <> '' AND strlen(trim(name, ' ')) <= 72 AND NOT regexp_matches(lower(trim(name, ' ')), ' on a patient| started on | especially |-induced | due to a | in the setting of | secondary to | as a result of ')",
    "tautology_filter": """WITH c AS (SELECT string_split(text, ' ') AS w, turn, conv_id FROM conversations), d AS (SELECT w[1] AS s, CASE WHEN turn % 2 = 0 THEN 'inhibits' ELSE 'treats' END AS p, CASE WHEN conv_id % 3 = 0 THEN upper(w[1]) ELSE w[2] END AS o FROM c)
 SELECT p, count(*) AS n FROM d WHERE o IS NOT NULL AND NOT (lower(trim(s)) = lower(trim(o)) AND p <> 'inhibits') GROUP BY p""",
    "base_name_match": "SELECT c_custkey, 'Segment ' || c_mktsegment AS base, c_mktsegment = 'BUILDING' AS ok FROM customer",
    "normalize_entities": f"SELECT p_partkey, {entity('p_name || chr(32) || chr(40) || p_brand || chr(41) || chr(45) || p_type')} AS entity FROM part",
    "claim_hash": "SELECT c_custkey, sha256(c_name) AS subject_hash, sha256(lower(c_name) || chr(0) || 'prefers' || chr(0) || lower(c_mktsegment)) AS claim_hash FROM customer",
    "degree_out": f"WITH {graph(*SUPPLY)} SELECT src_id AS name, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, name LIMIT 20",
    "degree_in": f"WITH {graph(*SUPPLY)} SELECT dst_id AS name, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, name LIMIT 20 OFFSET 5",
    "shared_neighbours_head": "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), x AS (SELECT a.s AS seed, b.s AS partner, count(*) AS shared FROM e a JOIN e b ON a.p = b.p AND a.s <> b.s GROUP BY ALL) SELECT 'supplier:' || seed AS seed, count(*) AS partners, sum(shared)::BIGINT AS shared, max(shared) AS most FROM x GROUP BY seed",
    "shared_neighbours_tail": "WITH e AS (SELECT DISTINCT l_suppkey AS s, p_type AS t FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT a.t AS seed, b.t AS partner, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.t <> b.t GROUP BY ALL) SELECT 'type:' || seed AS seed, count(*) AS partners, sum(shared)::BIGINT AS shared FROM x GROUP BY seed",
    "bridge_candidates": """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), x AS (SELECT 'supplier:' || a.s AS seed, 'supplier:' || b.s AS partner, count(*) AS shared FROM e a JOIN e b ON a.p = b.p AND a.s <> b.s GROUP BY ALL)
 SELECT seed, 'supplies' AS pred, partner, shared, 'shares_generalization_with:head:supplies' AS claim, round(least(1.0::DOUBLE, 0.4::DOUBLE + (shared - 2)::DOUBLE / (2 * shared)), 6) AS gain FROM x WHERE shared >= 5 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY shared DESC, partner) = 1""",
    "missing_links": f"""WITH {graph(*PLACES, *TYPES)}, own AS (SELECT src_id AS seed, min(pred) AS predicate, count(DISTINCT dst_id) AS degree FROM e GROUP BY 1),
 far AS (SELECT DISTINCT a.src_id AS seed, b.dst_id AS far FROM e a JOIN e b ON a.dst_id = b.src_id WHERE a.src_id <> b.dst_id)
 SELECT seed, predicate, far, round(least(1.0::DOUBLE, 0.3::DOUBLE + 0.05::DOUBLE * least(degree, 10)), 6) AS gain FROM far JOIN own USING (seed) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src_id = seed AND lower(e.dst_id) = lower(far))""",
    "structural_holes": f"WITH {graph(*PLACES, *TYPES)}, far AS (SELECT DISTINCT a.src_id AS seed, b.dst_id AS far FROM e a JOIN e b ON a.dst_id = b.src_id WHERE a.src_id <> b.dst_id) SELECT far, count(*) AS n FROM far WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src_id = seed AND e.dst_id = far) GROUP BY far",
    "predicate_inventory": f"""WITH {graph()}, d AS (SELECT pred AS canonical, pred IN ('located_in', 'part_of', 'is_a', 'instance_of', 'supplies', 'recalls') AS declared, upper(split_part(src_id, ':', 1)) AS h, upper(split_part(dst_id, ':', 1)) AS t FROM e)
 SELECT canonical, declared, 'all' AS side, '' AS label, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT canonical, declared, 'head', h, count(*) FROM d GROUP BY ALL UNION ALL SELECT canonical, declared, 'tail', t, count(*) FROM d GROUP BY ALL""",
    "undeclared_predicates": f"WITH {graph()} SELECT count(DISTINCT CASE WHEN pred IN ('placed_by', 'prefers') THEN pred END) AS undeclared, count(DISTINCT pred) AS predicates FROM e",
    "nearest_neighbour": """WITH p AS (SELECT a.vec_id AS id, b.vec_id AS c, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda z: z * z))) * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda z: z * z)))), 6) AS s
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT id, c AS nearest, s AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, c) = 1""",
    "truth_energy": "SELECT DISTINCT 'type:' || p_type AS node, 0.9::DOUBLE AS energy FROM part UNION ALL SELECT 'type:ANY', 0.72::DOUBLE UNION ALL SELECT DISTINCT 'brand:' || p_brand, 1.0::DOUBLE FROM part UNION ALL SELECT DISTINCT 'mfgr:' || (split_part(p_brand, '#', 2)::INT % 5), 1.0::DOUBLE FROM part",
    "conflict_resolution": """WITH c AS (SELECT l_suppkey, l_partkey, l_orderkey || ':' || l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'observation' WHEN 'A' THEN 'axiom' ELSE 'induced' END AS status, 1 - l_discount AS confidence, month(l_shipdate) AS says FROM lineitem),
 c2 AS (SELECT *, CASE WHEN status = 'axiom' THEN says END AS ax FROM c)
 SELECT l_suppkey, l_partkey, id, status, coalesce(min(ax) OVER (PARTITION BY l_suppkey, l_partkey) <> max(ax) OVER (PARTITION BY l_suppkey, l_partkey), false) AS review FROM c2
 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CASE status WHEN 'axiom' THEN 0 WHEN 'observation' THEN 1 ELSE 2 END, confidence DESC, id) = 1""",
    "topic_routing": r"""WITH t AS (SELECT topic, unnest(string_split(w, ' ')) AS t FROM (VALUES ('english', 'the and of that with is'), ('french', 'le la les des que est'), ('german', 'der die und das ist ein'), ('spanish', 'el los las que una es')) v(topic, w)),
 d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS t FROM documents),
 s AS (SELECT doc_id, topic, count(*) AS overlap FROM d JOIN t USING (t) GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, topic) = 1)
 SELECT doc_id AS id, coalesce(topic, 'english') AS topic, coalesce(overlap, 0) AS overlap FROM documents LEFT JOIN b USING (doc_id)""",
    "taxonomy_levels": GENERALIZED + "SELECT parent, depth, count(*) AS n FROM tax GROUP BY ALL",
    "select_parents": GENERALIZED + "SELECT parent, children, depth FROM kids WHERE children >= 40 OR parent IN (SELECT child FROM tax JOIN kids k USING (parent) WHERE k.children >= 40)",
    "lift_relations": GENERALIZED + "SELECT parent, pred, target, support, level, round(confidence, 6) AS confidence, n_sources::BIGINT AS n_sources FROM lift",
    "generalization_nodes": GENERALIZED + "SELECT id, kind, depth, support FROM nodes",
    "generalization_stats": GENERALIZED
    + "SELECT 'nodes:' || kind AS measure, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'level:' || depth, count(*) FROM kept GROUP BY depth UNION ALL SELECT CASE WHEN lifted THEN 'relations:lifted' ELSE 'relations:direct' END, count(*) FROM rel GROUP BY lifted",
    "stable_relation_ids": GENERALIZED + "SELECT id, source_id, predicate, target_id, support, lifted FROM rel WHERE lifted OR predicate <> 'prefers'",
    "dropped_edges": f"WITH {graph('supplier_nation', 'nation_region')} SELECT src_id, pred, dst_id FROM e WHERE pred = 'located_in' OR src_id NOT IN (SELECT 'nation:' || c_nationkey FROM customer)",
    "explained_edges": GENERALIZED
    + """, big AS (SELECT parent, pred, target FROM b1 WHERE support >= 12 UNION SELECT t.parent, b1.pred, target FROM b1 JOIN tax t ON t.child = b1.parent GROUP BY ALL HAVING count(DISTINCT b1.parent) >= 12)
 SELECT f.target, count(*) AS n FROM facts f WHERE EXISTS (SELECT 1 FROM tax t JOIN big b ON b.parent = t.parent AND b.pred = f.pred AND b.target = f.target WHERE t.child = f.child) GROUP BY f.target""",
    "scope_coverage": "SELECT count(*) AS covered, count(*) AS total, 1.0::DOUBLE AS share FROM customer",
    "rank_fusion": f"WITH {graph(*SUPPLY)}, d AS (SELECT src_id AS id, pred, row_number() OVER (PARTITION BY pred ORDER BY count(*) DESC, src_id) AS r FROM e GROUP BY src_id, pred) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM d GROUP BY id",
    "rule_bindings": RULES + "SELECT x, n, r, round(conf, 6) AS conf FROM vetoed",
    "rule_backward": RULES + "SELECT s, p, o, round(conf, 6) AS conf, steps, rule_id FROM d1 UNION ALL SELECT s, p, o, round(conf, 6), steps, rule_id FROM d2",
    "rule_forward_fire": RULES.replace("confidence AS c FROM e)", "confidence AS c FROM e UNION SELECT 'customer 1', 'prefers', 'segment building', 1.0)") + "SELECT rule_id, s, p, o, round(conf, 6) AS conf FROM d1 QUALIFY row_number() OVER (ORDER BY conf DESC, s DESC, o DESC) = 1",
    "rule_exception_veto": RULES + "SELECT (SELECT count(*) FROM based) AS without, (SELECT count(*) FROM vetoed) AS with_exception",
    "assumed_facts_union": RULES.replace("confidence AS c FROM e)", "confidence AS c FROM e UNION SELECT 'customer 1', 'prefers', 'segment building', 1.0)") + "SELECT p, count(*) AS n, round(sum(c), 6) AS total FROM f GROUP BY p",
    "formula_eval": "SELECT p_partkey, round(CASE WHEN p_size % 10 <> 0 THEN p_size / ((p_retailprice / 1000) * (p_retailprice / 1000)) END, 6) AS bmi, round((120.0::DOUBLE + 2 * p_size) / 3, 6) AS map, round(p_retailprice + 0.016::DOUBLE * 50, 6) AS corrected_na, NULL::DOUBLE AS anion_gap FROM part",
    "arithmetic_ops": """WITH c AS (SELECT c_custkey, c_acctbal AS a, (c_custkey % 4)::DOUBLE AS b FROM customer)
 SELECT c_custkey, round(a + b, 6) AS add, round(a - b, 6) AS sub, round(a * b, 6) + 0 AS mul, round(CASE WHEN b <> 0 THEN a / b END, 6) AS div, least(a, b) AS min, greatest(a, b) AS max, -a AS u_neg, abs(a) AS u_abs, round(a) AS u_round, floor(a) AS u_floor, ceil(a) AS u_ceil, round(CASE WHEN a > 0 THEN ln(a) END, 6) AS u_ln,
  a < b AS c_lt, a <= b AS c_le, abs(a - b) <= 1e-9 AS c_eq, abs(a - b) > 1e-9 AS c_ne, a >= b AS c_ge, a > b AS c_gt FROM c""",
    "classify_ranges": "SELECT CASE WHEN s_acctbal < 0 THEN 'low' WHEN s_acctbal > 5000 THEN 'high' ELSE 'normal' END AS kind, count(*) AS n FROM supplier GROUP BY 1",
    "finding_labels": "SELECT lower(c_mktsegment) || ' ' || CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal > 5000 THEN 'high' ELSE 'normal' END AS label, count(*) AS n FROM customer GROUP BY 1",
    "hot_keys": "SELECT user_id AS key, count(*) AS hits FROM events GROUP BY 1 ORDER BY hits DESC, key LIMIT 10",
    "unresolved_claims": f"WITH {EVENTS} SELECT claim, count(*) AS hits, arg_min(verdict, ts) AS verdict FROM q WHERE verdict IN ('unsupported', 'contradicted') GROUP BY claim ORDER BY hits DESC, claim LIMIT 10",
    "latency_p95": f"WITH {EVENTS} SELECT event_type, quantile_disc(latency, 0.95) AS latency, count(*) AS n FROM q GROUP BY event_type",
    "streamed_rates": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1",
    "rate_decay": """WITH d AS (SELECT date_trunc('day', ts) AS bucket, list({'q': 0.1::DOUBLE, 't': epoch_us(ts) / 1e6} ORDER BY ts) AS l FROM events GROUP BY 1)
 SELECT bucket, round(list_reduce(l, lambda a, b: {'q': a.q * exp((a.t - b.t) / 10.0) + b.q, 't': b.t}).q, 6) AS ewma FROM d""",
    "strong_components": RING + "SELECT DISTINCT s AS node, least(s, min(d) OVER (PARTITION BY s)) AS scc FROM both_ways",
    "cyclic_levels": RING + """, kept AS (SELECT s, d FROM e WHERE NOT EXISTS (SELECT 1 FROM both_ways b WHERE b.s = e.s AND b.d = e.d)),
 -- the highest way to a cycle's members counts for all of them
 lv(node, level) AS (SELECT DISTINCT s, 0 FROM e WHERE s LIKE 'customer:%' UNION SELECT coalesce(b.d, k.d), level + 1 FROM lv JOIN kept k ON k.s = lv.node LEFT JOIN both_ways b ON b.s = k.d WHERE level < 6),
 top AS (SELECT node, max(level) AS level FROM lv GROUP BY node)
 SELECT k.d AS parent, t.level::INT AS depth, count(*) AS n FROM kept k JOIN top t ON t.node = k.d GROUP BY ALL""",
    "anchored_proofs": f"WITH {graph('supplier_nation', 'nation_region')} SELECT s_suppkey AS req_id, b.dst_id AS node, 2 AS hops, round(a.confidence * b.confidence * 0.9, 6) AS conf FROM supplier JOIN e a ON a.src_id = 'supplier:' || s_suppkey JOIN e b ON b.src_id = a.dst_id WHERE b.dst_id = 'region:1'",
    "sql_functions": f"""WITH {graph('nation_region', 'supplier_nation')} SELECT 'derive' AS what, dst_id AS x, pred AS y, 1::BIGINT AS n FROM e WHERE src_id = 'nation:7'
 UNION ALL SELECT 'entails', r, CASE WHEN EXISTS (SELECT 1 FROM e WHERE src_id = 'nation:7' AND pred = 'part_of' AND dst_id = r) THEN 'entailed' ELSE 'unsupported' END, 1 FROM (VALUES ('region:3'), ('region:1')) v(r)
 UNION ALL SELECT 'contradicts', '', '', 0""",
    "qps_windows": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 6) AS qps FROM events GROUP BY 1",
    "session_gaps": """WITH m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m), c AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "golden_validation": f"WITH {LOCATED}, g AS (SELECT CASE WHEN claim_id LIKE '%0' THEN 'entailed' ELSE 'non_entailed' END AS wanted, ok AS got FROM located) SELECT wanted, (wanted = 'entailed') = got AS ok, count(*) AS n FROM g GROUP BY ALL",
    "scope_scoring": f"WITH {EVENTS} SELECT 'scope:' || user_id % 10 AS scope, count(*) + 2 * count(CASE WHEN latency > 100 THEN 1 END) + count(CASE WHEN verdict = 'unsupported' THEN 1 END) AS score FROM q GROUP BY 1",
    "epistemic_upsert": "WITH l AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, l_returnflag FROM lineitem), a AS (SELECT id FROM l WHERE l_returnflag = 'R') SELECT status, count(*) AS n FROM (SELECT 'axiom' AS status FROM a UNION ALL SELECT 'observation' FROM l WHERE id NOT IN (SELECT id FROM a)) GROUP BY status",
    "extract_triples": "WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations) SELECT 'triple:' || conv_id || '/' || turn || ':0' AS id, w[1] AS subject, 'mentions' AS predicate, w[2] AS object, 'observation' AS status, CASE WHEN conv_id % 2 = 0 THEN 'always' ELSE '' END AS conditions FROM c",
}
