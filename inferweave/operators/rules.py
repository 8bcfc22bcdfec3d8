"""Conditional rules: compiled on the driver to joins over a table of facts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.functions.lineage import cut
from inferweave.functions.registry import Registry, inline
from inferweave.functions.scalars import clamp01, normalize_entity

VETO = 0.6
FACT = ["s", "p", "o", "conf", "steps"]


@dataclass
class Rule:
    """Conditions, consequent and exceptions are (subject, predicate, object, negated); terms that begin with ? are variables."""

    id: str
    consequent: tuple
    conditions: list[tuple]
    exceptions: list[tuple] = field(default_factory=list)
    confidence: float = 1.0


def parse_rule(text: str) -> Rule:
    data = json.loads(text)
    term = lambda t: "?" + t["var"].lstrip("?") if t.get("var") else t.get("entity", "")
    pattern = lambda p: (term(p["subject"]), p.get("predicate_canonical") or p["predicate"], term(p["object"]), bool(p.get("negated")))
    return Rule(data["id"], pattern(data["consequent"]), [pattern(p) for p in data.get("conditions", [])], [pattern(p) for p in data.get("exceptions", [])], data.get("confidence", 1.0))


def is_var(t: str) -> bool:
    return t.startswith("?")


def compile_rules(rules: list[Rule], registry: Registry) -> tuple[list[Rule], int]:
    """Valid rules with canonical predicates, and how many were skipped: no id, no condition, confidence out of bounds, or an unbound consequent."""
    out, skipped = [], 0
    canon = lambda p: (p[0], registry.canonical(p[1]), p[2], bool(p[3]) if len(p) > 3 else False)
    for r in rules:
        bound = {t for c in r.conditions for t in (c[0], c[2]) if is_var(t)}
        if not r.id or not r.conditions or not 0 <= r.confidence <= 1 or any(is_var(t) and t not in bound for t in (r.consequent[0], r.consequent[2])):
            skipped += 1
            continue
        out.append(Rule(r.id, canon(r.consequent), [canon(c) for c in r.conditions], [canon(e) for e in r.exceptions], r.confidence))
    return out, skipped


def topic_rules(shared: list[Rule], own: dict[str, list[Rule]], topic: str) -> list[Rule]:
    """The rules of a topic: the shared ones and then its own; none replaces another."""
    return [*shared, *own.get(topic, [])]


def evaluation_order(rule: Rule, bound: frozenset[str] = frozenset()) -> list[tuple] | None:
    """The conditions as a plan of joins; None if one can never be evaluated.

    Conditions that hold come first, the most selective ones (by constants) before the others, each only when it is
    connected with what stands before it, by a constant or a variable, so that no join is a product. Then come the
    negated ones, as anti-joins, whose variables must all be bound by then. bound: variables that are bound beforehand,
    as a claim binds those of the consequent.
    """
    variables = lambda c: {t for t in (c[0], c[2]) if is_var(t)}
    known, plan = set(bound), []
    waiting = sorted((c for c in rule.conditions if not c[3]), key=lambda c: len(variables(c)))
    while waiting:
        connected = next((c for c in waiting if len(variables(c)) < 2 or variables(c) & known), None)
        if connected is None:
            return None
        waiting.remove(connected)
        plan.append(connected)
        known |= variables(connected)
    negated = [c for c in rule.conditions if c[3]]
    return plan + negated if all(variables(c) <= known for c in negated) else None


def facts_of(edges: DataFrame, origin: str = "graph") -> DataFrame:
    """Facts s, p, o (entity keys), conf and steps of edges (src_id, pred, dst_id, confidence)."""
    return edges.select(entity_key("src_id").alias("s"), F.col("pred").alias("p"), entity_key("dst_id").alias("o"), F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(1.0).alias("conf"), F.lit(1).alias("steps")).groupBy("s", "p", "o").agg(F.max("conf").alias("conf"), F.min("steps").alias("steps"))


def entity_key(c: str):
    return normalize_entity(F.col(c))


def assume(facts: DataFrame, assumed: list[tuple[str, str, str]]) -> DataFrame:
    """facts with assumed ones of confidence 1, which come first."""
    if not assumed:
        return facts
    rows = inline(facts.sparkSession, [{"a": a, "p": p, "b": b} for a, p, b in assumed], "a string, p string, b string")
    rows = rows.select(entity_key("a").alias("s"), "p", entity_key("b").alias("o"), F.lit(1.0).alias("conf"), F.lit(1).alias("steps")).dropDuplicates(["s", "p", "o"])
    return rows.unionByName(facts.select(*FACT).join(rows.select("s", "p", "o"), ["s", "p", "o"], "left_anti"))


def constant(text: str):
    return normalize_entity(F.lit(text))


def match(facts: DataFrame, pattern: tuple, registry: Registry) -> DataFrame:
    """Facts of a pattern: a column per variable, c and n (confidence and steps). Predicates that imply the pattern's count."""
    s, p, o, _ = pattern
    out = facts.where(F.col("p").isin(*registry.entailing(p)))
    for side, t in (("s", s), ("o", o)):
        if not is_var(t):
            out = out.where(F.col(side) == constant(t))
    if is_var(s) and s == o:
        out = out.where("s = o")
    names = {t: side for side, t in (("s", s), ("o", o)) if is_var(t)}
    return out.groupBy(*[F.col(side).alias(t) for t, side in names.items()]).agg(F.max("conf").alias("c"), F.min("steps").alias("n")).where("c IS NOT NULL")  # without variables there is a row even for no facts


def rule_bindings(rule: Rule, facts: DataFrame, registry: Registry, bound: frozenset[str] = frozenset()) -> DataFrame | None:
    """A row per binding of the rule's variables: the variables, conf and steps of the conditions; None if the rule can't be evaluated."""
    order = evaluation_order(rule, bound)
    if order is None:
        return None
    state = None
    for pattern in order:
        found = match(facts, pattern, registry)
        names = [c for c in found.columns if c not in ("c", "n")]
        if state is None:
            if pattern[3]:
                return None
            state = found.withColumnsRenamed({"c": "conf", "n": "steps"})
        elif pattern[3]:
            state = state.join(found.select(*names), names, "left_anti") if names else state.join(found.limit(1).select(F.lit(1).alias("_held")), F.lit(True), "left_anti")
        else:
            shared = [c for c in names if c in state.columns]  # not empty: the order takes no condition with two free ends
            state = (state.join(found, shared) if shared else state.crossJoin(found.limit(1))).withColumn("conf", F.col("conf") * F.col("c")).withColumn("steps", F.col("steps") + F.col("n")).drop("c", "n")
    for pattern in rule.exceptions:
        if any(is_var(t) and t not in state.columns for t in (pattern[0], pattern[2])):
            continue  # an exception that can't be grounded is ignored
        found = match(facts, pattern, registry).where(F.col("c") >= VETO)
        names = [c for c in found.columns if c not in ("c", "n")]
        how = "left_semi" if pattern[3] else "left_anti"
        state = state.join(found.select(*names), names, how) if names else state.join(found.limit(1).select(F.lit(1).alias("_held")), F.lit(True), how)
    return state


def fire(rule: Rule, facts: DataFrame, registry: Registry, decay: float = 0.9, bound: frozenset[str] = frozenset()) -> DataFrame | None:
    """Derived facts of a rule: s, p, o, conf, steps, rule_id; the best of each."""
    found = rule_bindings(rule, facts, registry, bound)
    if found is None:
        return None
    term = lambda t: F.col(f"`{t}`") if is_var(t) else constant(t)
    s, p, o, _ = rule.consequent
    conf = clamp01(F.lit(rule.confidence) * F.col("conf") * F.pow(F.lit(decay), F.col("steps") + 1))
    rows = found.select(term(s).alias("s"), F.lit(p).alias("p"), term(o).alias("o"), conf.alias("conf"), (F.col("steps") + 1).cast("int").alias("steps"))
    return rows.groupBy("s", "p", "o").agg(F.max("conf").alias("conf"), F.min_by("steps", F.struct(-F.col("conf"), "steps")).alias("steps")).withColumn("rule_id", F.lit(rule.id))


def saturate(rules: list[Rule], facts: DataFrame, registry: Registry, depth: int = 3, decay: float = 0.9) -> DataFrame:
    """Everything that the rules derive within depth rounds (s, p, o, conf, steps, rule_id); facts that the graph has stay out."""
    base, derived = facts.select(*FACT), None
    for _ in range(depth):
        now = base if derived is None else base.unionByName(derived.select(*FACT))
        new = [f for r in rules if not r.consequent[3] and (f := fire(r, now, registry, decay, frozenset())) is not None]
        if not new:
            break
        found = new[0]
        for f in new[1:]:
            found = found.unionByName(f)
        found = found.join(base.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        found = found.groupBy("s", "p", "o").agg(F.max(F.struct("conf", -F.col("steps"), "rule_id")).alias("b")).select("s", "p", "o", F.col("b.conf").alias("conf"), (-F.col("b.col2")).alias("steps"), F.col("b.rule_id").alias("rule_id"))
        derived = cut(found)
    return derived if derived is not None else facts.select(*FACT, F.lit("").alias("rule_id")).where("false")


def fire_rules(rules: list[Rule], facts: DataFrame, registry: Registry, assumed: list[tuple[str, str, str]], max_rules: int = 500, decay: float = 0.9) -> DataFrame:
    """rule_id, s, p, o, conf: the best firing of each rule that an assumed fact touches (all rules if nothing is assumed)."""
    def plain(t: str) -> str:
        import re

        return " ".join(re.sub("[^a-z0-9]+", " ", re.sub(r"\([^)]*\)", " ", t.lower())).split())

    touched = {plain(t) for a, _, b in assumed for t in (a, b)}
    chosen = [r for r in rules if not r.consequent[3] and (not touched or any(plain(t) in touched for c in r.conditions for t in (c[0], c[2]) if not is_var(t)))]
    all_facts = assume(facts, assumed)
    out = None
    for r in chosen[:max_rules]:
        found = fire(r, all_facts, registry, decay)
        if found is not None:
            best = found.groupBy("rule_id").agg(F.max_by(F.struct("s", "p", "o", "conf"), F.struct("conf", "s", "o")).alias("b")).select("rule_id", "b.*")
            out = best if out is None else out.unionByName(best)
    return out if out is not None else facts.select(F.lit("").alias("rule_id"), "s", "p", "o", "conf").where("false")


def rule_session_facts(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Facts from (subject, predicate, object, confidence) tuples."""
    table = inline(spark, [{"src_id": s, "pred": p, "dst_id": o, "confidence": c} for s, p, o, c in rows], "src_id string, pred string, dst_id string, confidence double")
    return facts_of(table)
