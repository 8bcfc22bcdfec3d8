import math

import pytest
from pyspark.sql import functions as F

from inferweave.functions import scalars as S
from inferweave.functions.registry import general, inline, medical
from inferweave.operators import generalization as G
from inferweave.operators import mining as M
from inferweave.operators import paths as P
from inferweave.operators import reasoning as E
from inferweave.operators import rules as U
from inferweave.sources.kg import Graph
from inferweave.sources import readers, sinks

EDGE = "edge_id string, src_id string, pred_raw string, dst_id string, confidence double, status string"


def graph(spark, rows, registry):
    table = inline(spark, [{"edge_id": f"e{i + 1}", "src_id": s, "pred_raw": p, "dst_id": o, "confidence": (x or [1.0])[0], "status": (x or [1.0, ""])[1] if len(x) > 1 else ""} for i, (s, p, o, *x) in enumerate(rows)], EDGE)
    return Graph(table).canonicalized(registry)


def verdict(spark, rows, claim, registry=None, **config):
    registry = registry or medical()
    claims = inline(spark, [{"claim_id": "c", "subject": claim[0], "predicate": claim[1], "object": claim[2]}], "claim_id string, subject string, predicate string, object string")
    return E.entails(claims, graph(spark, rows, registry), registry, E.Config(**config)).first()


@pytest.mark.parametrize(
    "rows,claim,wanted,effective",
    [
        ([("aspirin", "treats", "headache")], ("aspirin", "treats", "headache"), "entailed", "treats"),
        ([("fever", "symptom_of", "disease")], ("fever", "associated_with", "disease"), "entailed", "symptom_of"),
        ([("fever", "associated_with", "disease")], ("fever", "symptom_of", "disease"), "unsupported", None),
        ([("aspirin", "causes", "headache")], ("aspirin", "treats", "headache"), "unsupported", None),
        ([("a", "symptom_of", "b"), ("b", "causes", "condition")], ("a", "associated_with", "condition"), "unsupported", None),
        ([("influenza", "is_a", "x"), ("x", "has_symptom", "fever")], ("influenza", "has_symptom", "fever"), "entailed", "has_symptom"),
        ([("measles", "is_a", "x"), ("x", "has_phenotype", "rash")], ("measles", "has_symptom", "rash"), "entailed", "has_phenotype"),
        ([("a", "is_a", "b"), ("b", "is_a", "c"), ("c", "is_a", "disease")], ("a", "is_a", "disease"), "entailed", "is_a"),
        ([("fever", "is a symptom of", "flu")], ("fever", "associated with", "flu"), "entailed", "symptom_of"),
        ([("aspirin", "treated_by", "headache")], ("aspirin", "treats", "headache"), "entailed", "treated_by"),
        ([("drug", "contraindicated_for", "illness"), ("drug", "treats", "illness")], ("drug", "treats", "illness"), "contradicted", None),
    ],
)
def test_entails(spark, rows, claim, wanted, effective):
    got = verdict(spark, rows, claim)
    assert got.verdict == wanted and (got.best.predicate if got.best else None) == effective


def test_unconfirmed_edges(spark):
    rows = [("a", "treats", "b", 1.0, "Speculative")]
    assert verdict(spark, rows, ("a", "treats", "b")).verdict == "unsupported"
    assert verdict(spark, rows, ("a", "treats", "b"), exclude_deduced=False).verdict == "entailed"


def test_class_contradiction(spark):
    claims = inline(spark, [{"claim_id": "c", "subject": "thing", "predicate": "treats", "object": "Bad_Object"}], "claim_id string, subject string, predicate string, object string")
    pairs = inline(spark, [{"class_a": "bad_object", "class_b": "bad_class"}], "class_a string, class_b string")
    g = graph(spark, [("thing", "is_a", "bad_class")], medical())
    assert E.contradicts_class(claims, g, medical(), pairs).first()["class"] == "bad_class"


def test_derive_without_predicate_and_order(spark):
    g = graph(spark, [("a", "symptom_of", "b", 0.5), ("b", "causes", "c", 0.8), ("a", "treats", "c", 0.1)], medical())
    asked = inline(spark, [{"req_id": "1", "source": "a", "target": "c"}], "req_id string, source string, target string")
    got = E.derive(asked, g, medical(), E.Config(directed=True)).orderBy("rank").collect()
    assert [(r.predicate, round(r.conf, 6), r.rule_class) for r in got] == [("", 0.36, "composition"), ("treats", 0.1, "edge")]


def test_paths_do_not_repeat_nodes(spark):
    e = graph(spark, [("a", "is_a", "b"), ("b", "is_a", "a"), ("b", "is_a", "c")], general()).edges
    got = P.simple_paths(inline(spark, [{"req_id": "1", "start": "a"}], "req_id string, start string"), e, 4, directed=True)
    assert sorted(tuple(r.nodes) for r in got.collect()) == [("a", "b"), ("a", "b", "c")]
    assert {(r.node, r.scc) for r in P.strong_components(e).collect()} == {("a", "a"), ("b", "a")}


def builder(spark, tax, facts, **config):
    config = G.BuildConfig(**config)
    edges = inline(spark, [{"src_id": c, "dst_id": p, "pred": "is_a", "confidence": 1.0} for c, p in tax], "src_id string, dst_id string, pred string, confidence double")
    parents = {p for _, p in tax}
    scope = inline(spark, [{"id": c} for c in sorted({c for c, _ in tax} - parents)], "id string")
    up = G.levelled(scope, G.taxonomy_edges(scope, edges, config), config)
    kept = G.selected_parents(up, config)
    f = inline(spark, [{"child": s, "pred": p, "target": o, "confidence": 1.0, "source": f"f{i}"} for i, (s, p, o) in enumerate(facts)], "child string, pred string, target string, confidence double, source string")
    return scope, up, kept, f, G.lifted_relations(f, up, kept, config)


def test_parent_support(spark):
    _, up, kept, _, _ = builder(spark, [("A", "P"), ("B", "P"), ("C", "Q"), ("P", "Root")], [], max_level=1, min_parent_support=2)
    assert [r.parent for r in kept.collect()] == ["P"] and {r.parent for r in up.collect()} == {"P", "Q"}


def test_lift(spark):
    _, _, _, _, lifted = builder(spark, [("A", "P"), ("B", "P"), ("C", "P"), ("D", "Q")], [("A", "R", "Y"), ("B", "R", "Y"), ("C", "R", "Z")], min_support=2, min_parent_support=1)
    assert [(r.parent, r.target, r.support, round(r.confidence, 3)) for r in lifted.collect()] == [("P", "Y", 2, 0.667)]


def test_lift_through_levels(spark):
    _, _, kept, _, lifted = builder(spark, [("A", "P"), ("B", "Q"), ("P", "Root"), ("Q", "Root")], [("A", "R", "Y"), ("B", "R", "Y")], min_support=2, min_parent_support=2)
    assert {r.parent for r in kept.collect()} == {"P", "Q", "Root"}
    assert [(r.parent, r.support, r.level, r.confidence) for r in lifted.collect()] == [("Root", 2, 2, 1.0)]


def test_cycle_is_dropped(spark):
    edges = inline(spark, [{"src_id": a, "dst_id": b, "pred": "is_a", "confidence": 1.0} for a, b in (("A", "P"), ("P", "Q"), ("Q", "P"))], "src_id string, dst_id string, pred string, confidence double")
    scope = inline(spark, [{"id": "A"}], "id string")
    assert [(r.child, r.parent) for r in G.levelled(scope, G.taxonomy_edges(scope, edges)).collect()] == [("A", "P")]


def test_kept_and_dropped_partition(spark):
    scope, up, kept, f, lifted = builder(spark, [("A", "P"), ("B", "P")], [("A", "R", "Y"), ("A", "S", "Z"), ("B", "T", "Y")])
    every = f.select(F.col("child").alias("src_id"), "pred", F.col("target").alias("dst_id"))
    held = inline(spark, [{"source_id": "a", "predicate": "r", "target_id": "y"}, {"source_id": "B", "predicate": "T", "target_id": "Y"}], "source_id string, predicate string, target_id string")
    assert [tuple(r) for r in G.dropped_edges(every, held).collect()] == [("A", "S", "Z")]
    nodes, relations = G.assemble(scope, up, kept, f, lifted)
    assert {r.kind for r in nodes.collect()} == {"scope", "concept", "endpoint"} and relations.count() == 5


def facts(spark, rows):
    return U.rule_session_facts(spark, [(*r, 1.0) if len(r) == 3 else r for r in rows])


def test_three_way_rule(spark):
    rule = U.Rule("r", ("?x", "supports", "?y", False), [("?x", "has", "?m", False), ("?m", "causes", "?n", False), ("?n", "part_of", "?y", False)], [], 0.9)
    base = facts(spark, [("a", "has", "m", 0.9), ("m", "causes", "n", 0.8), ("n", "part_of", "y", 0.7)])
    assert U.evaluation_order(rule) is None  # nothing is bound
    bound = U.Rule("r", ("a", "supports", "?y", False), [("a", "has", "?m", False), *rule.conditions[1:]], [], 0.9)
    got = U.saturate([bound], base, general()).first()
    assert (got.s, got.o, got.steps) == ("a", "y", 4) and math.isclose(got.conf, 0.9 * 0.9 * 0.8 * 0.7 * 0.9**4)


def test_veto_and_chain(spark):
    rule = U.Rule("r", ("?x", "p", "goal", False), [("?x", "qualifies", "yes", False)], [("?x", "blocked", "yes", False)])
    assert U.saturate([rule], facts(spark, [("a", "qualifies", "yes"), ("a", "blocked", "yes")]), general()).count() == 0
    assert U.saturate([rule], facts(spark, [("a", "qualifies", "yes"), ("a", "blocked", "yes", 0.5)]), general()).count() == 1
    chain = [U.Rule("1", ("?x", "q", "t", False), [("?x", "base", "t", False)]), U.Rule("2", ("?x", "p", "t", False), [("?x", "q", "t", False)])]
    assert {r.p for r in U.saturate(chain, facts(spark, [("a", "base", "t")]), general()).collect()} == {"q", "p"}
    loop = [U.Rule("1", ("?x", "q", "t", False), [("?x", "p", "t", False)]), U.Rule("2", ("?x", "p", "t", False), [("?x", "q", "t", False)])]
    assert U.saturate(loop, facts(spark, [("a", "base", "t")]), general()).count() == 0


def test_forward_firing(spark):
    rules = [U.Rule("asthma", ("patient", "recommend", "inhaler", False), [("asthma", "present_in", "patient", False)], [("copd", "present_in", "patient", False)]), U.Rule("other", ("patient", "recommend", "rest", False), [("flu", "present_in", "patient", False)])]
    none = facts(spark, [("x", "y", "z")])
    fired = lambda *a: [r.rule_id for r in U.fire_rules(rules, none, general(), list(a)).collect()]
    assert fired(("Asthma", "present_in", "patient")) == ["asthma"]
    assert fired(("asthma", "present_in", "patient"), ("COPD", "present_in", "patient")) == []


def test_rule_states(spark):
    ok = '{"id":"r","confidence":1.0,"conditions":[{"subject":{"var":"x"},"predicate":"p","object":{"entity":"o"}}],"consequent":{"subject":{"var":"x"},"predicate":"q","object":{"entity":"o"}}}'
    import json

    rows = [{"uuid": "1", "attributes": "{}"}, {"uuid": "2", "attributes": json.dumps({"structured_rule": "{bad"})}, {"uuid": "3", "attributes": json.dumps({"structured_rule": ok})}, {"uuid": "4", "attributes": json.dumps({"structured_rule": ok.replace('"q","object":{"entity":"o"}', '"q","object":{"var":"z"}')})}]
    got = readers.decode_rules(inline(spark, rows, "uuid string, attributes string"))
    assert [r.state for r in got.orderBy("uuid").collect()] == ["skipped_no_structured", "skipped_invalid", "loaded", "skipped_invalid"]
    assert U.compile_rules([U.parse_rule(ok)], general())[1] == 0


def test_names(spark):
    rows = inline(spark, [{"x": x} for x in ("Pulmonary Embolism (PE)", "second-trimester pregnant woman", "  Acute  PE!  ", "asthma 3 12", "7")], "x string")
    assert [r[0] for r in rows.select(S.normalize_entity(F.col("x"))).collect()][:3] == ["pulmonary embolism", "second trimester pregnant woman", "acute pe"]
    assert [r[0] for r in rows.select(S.base_name(F.col("x"))).collect()][3:] == ["asthma", "7"]
    assert not rows.select(S.plausible_name(F.lit("rash due to a drug"))).first()[0]


def test_quantities(spark):
    one = spark.range(1)
    m = F.create_map(F.lit("weight_kg"), F.lit(80.0), F.lit("height_m"), F.lit(2.0))
    assert one.select(S.formula("BMI", m), S.formula("anion_gap", m)).first()[:] == (20.0, None)
    assert one.select(S.UNARY["round"](F.lit(-2.5)), S.UNARY["ln"](F.lit(0.0)), S.BINARY["div"](F.lit(1.0), F.lit(0.0))).first()[:] == (-3.0, None, None)
    assert one.select(S.classify(F.lit(5.0), F.lit(5.0), F.lit(6.0)), S.finding_label(F.lit(" Sodium "), F.lit("low"))).first()[:] == ("normal", "sodium low")
    v = lambda *x: F.array(*map(F.lit, x))
    assert one.select(S.cosine(v(1.0, 0.0), v(2.0, 0.0)), S.cosine(v(0.0), v(1.0)), S.cosine(v(1.0), v(1.0, 2.0))).first()[:] == (1.0, float("-inf"), float("-inf"))


def test_mining(spark):
    rows = [(f"s{i}", "supplies", f"p{j}") for i in (1, 2) for j in range(6)] + [("p1", "is_a", "t")]
    e = graph(spark, rows, general()).edges
    best = M.bridge_candidates(e).collect()
    assert {(r.seed, r.partner, r.shared) for r in best} == {("s1", "s2", 6), ("s2", "s1", 6)} and math.isclose(best[0].gain, 0.4 + 4 / 12)
    assert {(r.seed, r.far) for r in M.missing_links(e).collect()} == {("s1", "t"), ("s2", "t")}
    assert {r.label for r in M.communities(e).collect()} and M.truth_energy(e, inline(spark, [{"node": "p1"}], "node string")).where("node = 't'").first().energy == 1.0


def test_snapshot(spark, tmp_path):
    folder = str(tmp_path / "graph")
    sinks.publish_snapshot(spark.range(3), folder)
    sinks.publish_snapshot(spark.range(5), folder, lambda d: d.count() == 5)
    with pytest.raises(ValueError):
        sinks.publish_snapshot(spark.range(7), folder, lambda d: False)
    assert sinks.read_snapshot(spark, folder).count() == 5
    sinks.rollback_snapshot(spark, folder)
    assert sinks.read_snapshot(spark, folder).count() == 3
    assert sinks.upsert(spark.range(3), spark.range(2, 5), "id").count() == 5


def test_extraction(spark):
    text = '{"triples":[{"subject":"a","predicate":"p","object":"b","condition":"if x","temporal":"","confidence":0.5}],"rules":[{"antecedent":"x","consequent":"y","confidence":0.7}]}'
    rows = inline(spark, [{"doc": "d", "json": text}], "doc string, json string")
    edge, rule = readers.extracted_edges(rows).first(), readers.extracted_rules(rows).first()
    assert (edge.status, edge.conditions, rule.head, rule.frequency) == ("observation", ["if x"], "y", 1)


def test_native_mode(spark):
    g = graph(spark, [("a", "is_a", "b"), ("b", "is_a", "c"), ("a", "treats", "c")], medical())
    claims = inline(spark, [{"claim_id": "1", "subject": "a", "predicate": "is_a", "object": "c"}, {"claim_id": "2", "subject": "a", "predicate": "causes", "object": "c"}], "claim_id string, subject string, predicate string, object string")
    got = {r.claim_id: (r.verdict, round(r.confidence, 6)) for r in E.answer(claims, g, medical(), "native").collect()}
    assert got == {"1": ("entailed", round(0.8**2 * 0.9, 6)), "2": ("unsupported", 0.0)}
    with pytest.raises(ValueError):
        E.answer(claims, g, medical(), "other")


def test_questions(spark):
    from inferweave.operators import cognition as C

    missing = inline(spark, [{"seed": "a", "predicate": "treats", "far": "b", "gain": 1.7}, {"seed": "A", "predicate": "Treats", "far": "b ", "gain": 0.5}, {"seed": "x", "predicate": "treats", "far": "X", "gain": 0.5}], "seed string, predicate string, far string, gain double")
    none = inline(spark, [], "seed string, claim string, partner string, gain double")
    asked = C.thoughts(missing, none, inline(spark, [], "subject string, predicate string, object string")).withColumn("at", F.monotonically_increasing_id())
    kept = C.bounded_store(C.plausible_claims(asked, medical()), "at").collect()
    assert [(r.subject, r.gain) for r in kept] == [("a", 1.0)]
    assert "subject" not in C.exported(asked).columns
    assert sorted(C.pick_order({"a": 1, "b": 0, "c": 2}, 3)) == ["a", "b", "c"] and C.pick_order({"a": 1, "b": 5}, 3) == C.pick_order({"b": 5, "a": 1}, 3)


def test_engine(spark):
    from inferweave.plans.engine import Engine, Generation

    engine = Engine(spark, medical())
    rows = [("flu", "is_a", "infection"), ("infection", "has_symptom", "fever")]
    rule = U.Rule("r", ("?x", "treats", "fever", False), [("?x", "related_to", "pill", False)], [], 0.8)
    with pytest.raises(ValueError):
        engine.entails([("a", "b", "c")])
    golden = inline(spark, [{"subject": "flu", "predicate": "has_symptom", "object": "fever", "wanted": "entailed"}, {"subject": "flu", "predicate": "treats", "object": "fever", "wanted": "not-entailed"}], "subject string, predicate string, object string, wanted string")
    engine.swap(Generation("1", graph(spark, rows, medical()), [rule]), golden)
    with pytest.raises(ValueError):
        engine.swap(Generation("2", graph(spark, rows[:1], medical())), golden)
    assert engine.health()["generation"] == "1"
    ask = [("flu", "has_symptom", "fever"), ("tea", "treats", "fever")]
    assert [r.verdict for r in engine.entails(ask).orderBy("claim_id").collect()] == ["entailed", "unsupported"]
    helped = engine.entails(ask, [("tea", "related_to", "pill")]).orderBy("claim_id").collect()
    assert (helped[1].verdict, helped[1].by) == ("entailed", "rule:r") and math.isclose(helped[1].confidence, 0.8 * 0.9**2)
    engine.entails(ask)
    assert engine.cache.hits == 1
    assert [r.rule_id for r in engine.fire_rules([("tea", "related_to", "pill")]).collect()] == ["r"]
    engine.swap(Generation("3", graph(spark, rows[:1], medical())))
    engine.rollback()
    assert engine.health()["generation"] == "1"


def test_emission(spark):
    rel = inline(spark, [{"id": "1", "source_id": "a", "source_name": "A", "predicate": "p", "target_id": "b", "target_name": "B", "sources": ["x"], "confidence": 0.5, "support": 2, "lifted": True}], "id string, source_id string, source_name string, predicate string, target_id string, target_name string, sources array<string>, confidence double, support long, lifted boolean")
    assert sinks.emit_relations(rel, "g").first().fact == "A p B"
    nodes = inline(spark, [{"id": "1", "name": "n", "kind": "scope", "depth": 0, "support": 1}, {"id": "2", "name": "m", "kind": "scope", "depth": 0, "support": 1}], "id string, name string, kind string, depth int, support long")
    assert [r.id for r in sinks.emit_nodes(nodes, nodes.where("id = '1'"), "g").collect()] == ["2"]
    backup = sinks.dropped_backup(inline(spark, [{"id": "e", "sources": ["x"]}], "id string, sources array<string>"), "s", "batch").first()
    assert backup.sources == ["x", "dropped_by:build-generalization:s"] and backup.id.startswith("gg-")


def test_files(spark, tmp_path):
    (tmp_path / "golden.json").write_text('{"cases":[{"claim":{"subject":"a","predicate":"p","object":"b"},"want_verdict_class":"entailed"},{"claim":{"subject":"a","predicate":"p","object":"c"},"verdict":"negative"}]}')
    assert [r.wanted for r in readers.read_golden(spark, f"file://{tmp_path}/golden.json").collect()] == ["entailed", "negative"]
    (tmp_path / "scope.txt").write_text("a, b # note\n# none\nb\nc\n")
    assert sorted(r.name for r in readers.read_scope(spark, f"file://{tmp_path}/scope.txt").collect()) == ["a", "b", "c"]
    (tmp_path / "rules.jsonl").write_text('{"id":"r","confidence":0.5,"conditions":[{"subject":{"entity":"x"},"predicate":"p","object":{"entity":"y"}}],"consequent":{"subject":{"entity":"x"},"predicate":"q","object":{"entity":"y"}}}\n')
    found = readers.read_rules_jsonl(spark, f"file://{tmp_path}/rules.jsonl")
    assert found.first().confidence == 0.5 and sinks.condition_facts(found).first().edge_id == "rel:r:0"
    assert readers.decode_rules(sinks.rule_nodes(found, "g")).first().state == "loaded"
    topics = tmp_path / "topics"
    topics.mkdir()
    (topics / "Heart.g_g.db").write_text("")
    assert list(readers.discover_topics(str(topics))) == ["heart"]
    (topics / "heart.graph").write_text("")
    with pytest.raises(ValueError):
        readers.discover_topics(str(topics))


def test_streams(spark, tmp_path):
    from inferweave.streaming import telemetry as T

    rows = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts, id % 3 AS k FROM range(500)")
    rows.write.parquet(f"file://{tmp_path}/in")
    src = lambda: T.event_stream(spark, f"file://{tmp_path}/in", rows.schema)
    got = T.run_to_end(T.rate_stream(src(), "ts", "1 hour", "0 seconds"), f"file://{tmp_path}/rates", f"file://{tmp_path}/c1")
    assert [r.n for r in got.orderBy("window_start").collect()] == [60] * 8  # the last hour is still open
    got = T.run_to_end(T.distinct_questions(src(), ["k"], late="100 days"), f"file://{tmp_path}/q", f"file://{tmp_path}/c2")
    assert got.count() == 3
    seen = []
    T.on_batches(src(), lambda batch, n: seen.append(batch.count()), f"file://{tmp_path}/c3")
    assert sum(seen) == 500


def test_contexts_and_diagnoses(spark):
    paths = inline(spark, [{"id": 1, "contexts": [["a"], ["b", "a"]], "conf": 0.5}, {"id": 2, "contexts": [["a"], ["not a"]], "conf": 0.5}], "id int, contexts array<array<string>>, conf double")
    assert [(r.conditions, r.conf) for r in E.joined_contexts(paths).orderBy("id").collect()] == [(["a", "b"], 0.5), (["a", "not a"], 0.0)]
    g = graph(spark, [("rash", "symptom_of", "measles"), ("measles", "is_a", "infection")], medical())
    got = E.supports_diagnosis(inline(spark, [{"case": "1", "finding": "rash"}], "case string, finding string"), g, "symptom_of")
    assert {(r.disease, r.support) for r in got.collect()} == {("measles", "direct"), ("infection", "by_subclass")}


def test_decayed_rate_over_batches(spark, tmp_path):
    from inferweave.streaming import telemetry as T

    rows = spark.sql("SELECT 'k' AS k, timestamp_seconds(id * 5) AS ts FROM range(4)")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = T.ewma_stream(T.event_stream(spark, f"file://{tmp_path}/in", rows.schema), "k")
    got = T.run_to_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").first()
    rate = 0.0
    for i in range(4):
        rate = (rate * math.exp(-0.5) if i else 0.0) + 0.1
    assert got.at == 15 and math.isclose(got.ewma, rate, abs_tol=1e-8)


def test_lowering_and_changes(spark):
    scope, up, kept, f, lifted = builder(spark, [("A", "P"), ("B", "P"), ("C", "P")], [("A", "R", "Y"), ("B", "R", "Y")])
    assert {r.child for r in G.lowered(lifted, up).collect()} == {"A", "B", "C"} and G.explained_edges(f, up, lifted).count() == 2
    assert G.coverage(scope, up).first().share == 1.0
    stats = G.statistics(*G.assemble(scope, up, kept, f, lifted))
    assert {r.change for r in G.statistic_changes(stats, stats).collect()} == {0}
    assert M.sample_entities(scope, 2, 1).count() == 2


def test_cycles_of_any_length(spark):
    import random

    r = random.Random(3)
    ring = [(f"c{i:02}", f"c{(i + 1) % 9:02}") for i in range(9)]
    edges = ring + [("c03", "x"), ("x", "y"), ("y", "x"), ("top", "c05"), ("y", "end"), ("self", "self"), ("top", "self")]
    edges += [(f"r{r.randint(0, 14):02}", f"r{r.randint(0, 14):02}") for _ in range(18)]
    reach = {a: {b for x, b in edges if x == a} for a in {n for e in edges for n in e}}
    while any(len(reach[a] | set().union(*(reach[b] for b in reach[a]), set())) > len(reach[a]) for a in reach):
        reach = {a: reach[a] | set().union(*(reach[b] for b in reach[a]), set()) for a in reach}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
    got = P.strong_components(spark.createDataFrame(edges, "src_id string, dst_id string")).collect()
    assert {x.node: x.scc for x in got} == want and len(got) == len(want)


def test_hubs_are_spread_without_loss(spark, monkeypatch):
    from inferweave.operators import mining as M

    rows = [("hub" if i % 3 else f"k{i % 5}", i) for i in range(60)]
    left, right = spark.createDataFrame(rows, "k string, a int"), spark.createDataFrame([(k, -i) for k, i in rows[:20]], "k string, b int")
    want = sorted((k, a, -i) for k, a in rows for k2, i in rows[:20] if k == k2)
    for hub in (1024, 4):
        monkeypatch.setattr(M, "HUB", hub)
        assert sorted(map(tuple, M.hub_join(left, right, ["k"]).select("k", "a", "b").collect())) == want


def test_ranks_over_ranges(spark):
    from pyspark.sql import functions as F

    from inferweave.operators import mining as M

    rows = [(f"n{i}", i * 7 % 11) for i in range(40)]
    got = {x.name: x["rank"] for x in M.ranks(spark.createDataFrame(rows, "name string, n int"), F.desc("n"), F.col("name")).collect()}
    assert got == {n: i + 1 for i, (n, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}


def test_nearest_of_odd_vectors(spark):
    from inferweave.operators import mining as M

    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.1])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {x.id: (x.nearest, x.similarity) for x in M.nearest(v.where("id IN (1, 2, 3)"), v).collect()}
    assert got[1] == (2, 0.998752) and got[2] == (5, 1.0) and got[3] == (1, float("-inf"))


def test_table_functions(spark):
    from inferweave.functions.registry import general
    from inferweave.operators.reasoning import Config
    from inferweave.plans.engine import Engine, Generation
    from inferweave.sources.kg import Graph

    edges = spark.createDataFrame([("e1", "aspirin", "is_a", "is_a", "drug's", 1.0)], "edge_id string, src_id string, pred_raw string, pred string, dst_id string, confidence double")
    engine = Engine(spark, general(), Config(max_hops=2))
    engine.swap(Generation("g", Graph(edges)))
    rows = engine.sql("SELECT a.verdict, b.node FROM reason_entails(' Aspirin', 'is a', 'DRUG''s') a, REASON_DERIVE('aspirin', NULL, NULL) b").collect()
    assert [tuple(r) for r in rows] == [("entailed", "drug's")]
    assert engine.sql("SELECT 1 FROM REASON_CONTRADICTS('aspirin', 'is_a', 'x')").count() == 0
    with pytest.raises(ValueError):
        engine.sql("SELECT * FROM REASON_ENTAILS('only one')")


def test_names_are_cut_at_bytes(spark):
    from pyspark.sql import functions as F

    from inferweave.sources.sinks import cut_bytes

    df = spark.createDataFrame([("é" * 60,), ("a" + "é" * 60,), ("ab",), ("",), (None,)], "t string")
    assert [x[0] for x in df.select(cut_bytes(F.col("t"), 100)).collect()] == ["é" * 50, "a" + "é" * 49, "ab", "", None]
