"""The engine that a user calls: one graph generation with its registry, rules and caches; swapping, validation and rollback."""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.functions.registry import Registry, general, inline
from inferweave.functions.scalars import verdict_matches
from inferweave.operators import mining, reasoning, rules
from inferweave.sources.kg import Graph

#: A call of a table function, and an argument of it: a literal or NULL.
CALL = re.compile(r"\bREASON_(ENTAILS|DERIVE|CONTRADICTS)\s*\(((?:[^()']|'(?:[^']|'')*')*)\)", re.I)
ARGUMENT = re.compile(r"'((?:[^']|'')*)'|\b(NULL)\b", re.I)
CLAIM = "claim_id string, subject string, predicate string, object string"


@dataclass
class Generation:
    """A graph as it was at one time."""

    id: str
    graph: Graph
    rules: list[rules.Rule] = field(default_factory=list)


class ResultCache:
    """Results of at most so many requests, the least recently used out first; keyed by all that a result depends on."""

    def __init__(self, entries: int = 64):
        self.entries, self.kept, self.hits, self.misses = entries, OrderedDict(), 0, 0

    @staticmethod
    def key(method: str, *parts) -> str:
        return hashlib.sha256(json.dumps([method, *parts], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.misses += 1
        out = self.kept[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)[1].unpersist()
        return out

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


class Engine:
    def __init__(self, spark: SparkSession, registry: Registry | None = None, config: reasoning.Config | None = None):
        self.spark, self.registry, self.config = spark, registry or general(), config or reasoning.Config()
        self.current: Generation | None = None
        self.previous: Generation | None = None
        self.cache = ResultCache()

    # generations

    def swap(self, candidate: Generation, golden: DataFrame | None = None) -> None:
        """Takes a generation over if it has edges and answers the golden claims (subject, predicate, object, wanted) as wanted; else it is an error and the old one stays."""
        if candidate.graph.edges.isEmpty():
            raise ValueError("the candidate has no edges")
        if golden is not None and (bad := self.golden_failures(candidate, golden).limit(5).collect()):
            raise ValueError(f"golden claims fail: {[tuple(r) for r in bad]}")
        self.previous, self.current = self.current, candidate
        self.cache.clear()

    def rollback(self) -> None:
        if self.previous is None:
            raise ValueError("there is nothing to go back to")
        self.current, self.previous = self.previous, None
        self.cache.clear()

    def golden_failures(self, candidate: Generation, golden: DataFrame) -> DataFrame:
        claims = golden.withColumn("claim_id", F.sha1(F.concat_ws("\0", "subject", "predicate", "object").cast("binary")))
        got = self._entails(claims, candidate, [])
        return got.where(~verdict_matches(F.col("wanted"), F.col("verdict"))).select("subject", "predicate", "object", "wanted", "verdict")

    # requests

    def claims(self, rows: list[tuple[str, str, str]]) -> DataFrame:
        return inline(self.spark, [{"claim_id": str(i), "subject": s, "predicate": p, "object": o} for i, (s, p, o) in enumerate(rows)], CLAIM)

    def entails(self, claims: DataFrame | list, assumed: list[tuple[str, str, str]] | None = None) -> DataFrame:
        """Verdicts; where the graph supports a claim in no way, rules and assumed facts may."""
        if isinstance(claims, list):
            key = ResultCache.key("entails", self._live().id, self.registry.fingerprint(), asdict(self.config), claims, assumed)
            return self.cache.get(key, lambda: self._entails(self.claims(claims), self._live(), assumed or []))
        return self._entails(claims, self._live(), assumed or [])

    def derive(self, requests: DataFrame) -> DataFrame:
        return reasoning.derive(requests, self._live().graph, self.registry, self.config)

    def contradicts(self, claims: DataFrame | list) -> DataFrame:
        claims = self.claims(claims) if isinstance(claims, list) else claims
        return reasoning.contradicts_predicate(claims, self._live().graph, self.registry, self.config)

    def fire_rules(self, assumed: list[tuple[str, str, str]], max_rules: int = 500) -> DataFrame:
        live = self._live()
        compiled, _ = rules.compile_rules(live.rules, self.registry)
        return rules.fire_rules(compiled, rules.facts_of(live.graph.quarantined(self.config.exclude_deduced).edges), self.registry, assumed, max_rules, self.config.decay)

    def sql(self, text: str) -> DataFrame:
        """SQL in which REASON_ENTAILS(subject, predicate, object), REASON_CONTRADICTS (the same) and REASON_DERIVE(source[, predicate[, target]]) are tables.

        Arguments are string literals or NULL. A call is planned like any table: what is asked around it is optimized with it.
        """
        found: dict[str, DataFrame] = {}

        def planned(call: re.Match) -> str:
            args = [None if null else literal.replace("''", "'") for literal, null in ARGUMENT.findall(call[2])]
            kind, name = call[1].upper(), f"_reason{len(found)}"
            if kind == "DERIVE":
                if not 1 <= len(args) <= 3 or args[0] is None:
                    raise ValueError("REASON_DERIVE takes a source and, if wanted, a predicate and a target")
                source, predicate, target = [*args, None, None][:3]
                row = {"req_id": "0", "source": source} | ({"predicate": predicate} if predicate else {}) | ({"target": target} if target else {})
                asked = inline(self.spark, [row], ", ".join(f"{c} string" for c in row))
                found[name] = self.derive(asked).drop("req_id")
            else:
                if len(args) != 3 or None in args:
                    raise ValueError(f"REASON_{kind} takes a subject, a predicate and an object")
                found[name] = (self.entails if kind == "ENTAILS" else self.contradicts)([tuple(args)])
            return f"{{{name}}}"

        return self.spark.sql(CALL.sub(planned, text), **found)

    def inventory(self, limit: int | None = None) -> DataFrame:
        live = self._live()
        return mining.predicate_inventory(live.graph.edges, live.graph.entities, self.registry, limit)

    def health(self) -> dict:
        lookups = self.cache.hits + self.cache.misses
        return {"generation": self.current.id if self.current else None, "previous": self.previous.id if self.previous else None, "fingerprint": self.registry.fingerprint(), "cache": {"hits": self.cache.hits, "misses": self.cache.misses, "ratio": self.cache.hits / lookups if lookups else None}}

    def _live(self) -> Generation:
        if self.current is None:
            raise ValueError("no graph has been taken over")
        return self.current

    def _entails(self, claims: DataFrame, generation: Generation, assumed: list) -> DataFrame:
        base = reasoning.entails(claims, generation.graph, self.registry, self.config)
        compiled, _ = rules.compile_rules(generation.rules, self.registry)
        if not compiled and not assumed:
            return base
        facts = rules.assume(rules.facts_of(generation.graph.quarantined(self.config.exclude_deduced).edges), assumed)
        held = facts.select("s", "p", "o", "conf", F.lit("assumed").alias("by"))
        if compiled:
            derived = rules.saturate(compiled, facts, self.registry, decay=self.config.decay)
            held = held.unionByName(derived.select("s", "p", "o", "conf", F.concat(F.lit("rule:"), "rule_id").alias("by")))
        wider = held.join(F.broadcast(self.registry.closure_table(self.spark)).withColumnRenamed("pred", "p"), "p", "left").select("s", F.coalesce("super", "p").alias("p"), "o", "conf", "by")
        best = wider.groupBy("s", "p", "o").agg(F.max(F.struct("conf", "by")).alias("b"))
        asked = base.withColumn("s", rules.entity_key("subject")).withColumn("p", self.registry.canonical_column(F.col("predicate"))).withColumn("o", rules.entity_key("object"))
        out = asked.join(best, ["s", "p", "o"], "left")
        helped = (F.col("verdict") == "unsupported") & F.col("b").isNotNull()
        return out.select(*claims.columns, F.when(helped, "entailed").otherwise(F.col("verdict")).alias("verdict"), F.when(helped, F.col("b.conf")).otherwise(F.col("confidence")).alias("confidence"), "best", F.when(helped, F.col("b.by")).alias("by"))
