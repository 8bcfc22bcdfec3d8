"""The predicate algebra: small metadata on the driver, handed to plans as literal maps and inline tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.functions import vocabulary as V


@dataclass
class Registry:
    """Predicates (name -> inverse, super-properties, characteristics), compositions, aliases, disjoint pairs, domains, ranges, types."""

    predicates: dict[str, tuple[str | None, list[str], str]] = field(default_factory=dict)
    compositions: list[tuple[str, str, str]] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    disjoint: list[tuple[str, str]] = field(default_factory=list)
    domains: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, list[str]] = field(default_factory=dict)
    types: dict[str, list[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    # lookups

    def canonical(self, raw: str) -> str:
        return self._surface().get(raw.strip().lower(), raw.strip())

    def _surface(self) -> dict[str, str]:
        return {p.lower(): p for p in self.predicates} | {a.lower(): c for a, c in self.aliases.items()}

    def has(self, predicate: str, characteristic: str) -> bool:
        return characteristic in self.predicates.get(predicate, (None, [], ""))[2]

    def inverse(self, predicate: str) -> str | None:
        return self.predicates.get(predicate, (None, [], ""))[0]

    def supers(self, predicate: str) -> list[str]:
        """The predicate and what it implies, nearest first; cycles end."""
        out, todo = [], [predicate]
        while todo:
            p = todo.pop(0)
            if p not in out:
                out.append(p)
                todo += [self.canonical(q) for q in self.predicates.get(p, (None, [], ""))[1]]
        return out

    def entailing(self, predicate: str) -> list[str]:
        """Predicates that imply this one, itself included, sorted."""
        return sorted({p for p in [*self.predicates, predicate] if predicate in self.supers(p)})

    def accepted(self, predicate: str) -> list[str]:
        """What entails the predicate in either direction: its own family and that of its inverse."""
        inverse = self.inverse(predicate)
        return sorted({*self.entailing(predicate), *(self.entailing(inverse) if inverse and inverse != predicate else [])})

    def transitive(self) -> list[str]:
        return sorted(p for p in self.predicates if self.has(p, "T"))

    def reflexive(self) -> list[str]:
        """Reflexive predicates and those that inherit it."""
        return sorted(p for p in self.predicates if any(self.has(q, "R") for q in self.supers(p)))

    def conflicting(self, predicate: str) -> list[str]:
        return sorted({b for a, b in self.disjoint if a == predicate} | {a for a, b in self.disjoint if b == predicate})

    def compose(self, first: str, second: str) -> str | None:
        return next((self.canonical(r) for a, b, r in self.compositions if self.canonical(a) == first and self.canonical(b) == second), None)

    def inheritable(self, taxonomy: str = "is_a") -> list[str]:
        return sorted({b for a, b, r in self.compositions if a == taxonomy and b == r})

    def is_a(self, kind: str, target: str) -> bool:
        """Whether a declared type is the target or below it."""
        seen, todo = set(), [kind]
        while todo:
            t = todo.pop()
            if t in seen or t not in self.types or target not in self.types:
                continue
            if t == target:
                return True
            seen.add(t)
            todo += self.types[t]
        return False

    def check_types(self, predicate: str, head: list[str], tail: list[str]) -> tuple[bool, str]:
        for side, declared, found in (("domain", self.domains, head), ("range", self.ranges, tail)):
            wanted = declared.get(predicate, [])
            if wanted and found and not any(f == w or self.is_a(f, w) for f in found for w in wanted):
                return False, f"{side} of {predicate}"
        return True, ""

    def effective(self, predicates: list[str]) -> str | None:
        """What a path's predicates amount to (the driver-side statement of effective_predicate)."""
        steps = [self.canonical(p) for p in predicates]
        if not steps or not all(steps):
            return None
        if len(steps) == 1:
            return steps[0]
        folded: str | None = steps[0]
        for p in steps[1:]:
            folded = self.compose(folded, p) if folded else None
        if folded:
            return folded
        common = [q for q in self.supers(steps[0]) if self.has(q, "T")]
        return next((q for q in common if all(q in self.supers(p) for p in steps[1:])), None)

    def fingerprint(self) -> str:
        """Equal for equal content, in whatever order it was declared."""
        lines = [f"p {p} {i or ''} {','.join(sorted(s))} {''.join(sorted(c))} {self.domains.get(p, [])} {self.ranges.get(p, [])}" for p, (i, s, c) in self.predicates.items()]
        lines += [f"r {a} {b} {c}" for a, b, c in self.compositions] + [f"c {a} {b}" for a, b in self.aliases.items()] + [f"d {' '.join(sorted(x))}" for x in self.disjoint]
        return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()

    # layering

    def extended(self, predicates=None, compositions=(), aliases=None, disjoint=(), domains=None, ranges=None, types=None, override: bool = True) -> Registry:
        """This registry with another layer on top; without override, predicates that are declared already are an error."""
        if not override and (twice := set(predicates or {}) & set(self.predicates)):
            raise ValueError(f"predicates declared twice: {sorted(twice)}")
        out = Registry(self.predicates | (predicates or {}), [*self.compositions, *map(tuple, compositions)], self.aliases | (aliases or {}), [*self.disjoint, *map(tuple, disjoint)], self.domains | (domains or {}), self.ranges | (ranges or {}), self.types | (types or {}))
        for p, (inverse, supers, _) in out.predicates.items():
            for q in [*supers, *([inverse] if inverse else [])]:
                if out.canonical(q) not in out.predicates:
                    raise ValueError(f"{p} refers to {q}, which isn't declared")
        for name, target in out.aliases.items():
            if target not in out.predicates:
                raise ValueError(f"the alias {name} refers to {target}, which isn't declared")
        known = set(out.types)
        for where, declared in (("domain", out.domains), ("range", out.ranges)):
            out.warnings += [f"{where} of {p}: unknown type {t}" for p, ts in declared.items() for t in ts if known and t not in known]
        out.warnings += [f"type {t}: unknown supertype {s}" for t, ss in out.types.items() for s in ss if s not in known]
        return out

    # plans

    def canonical_column(self, raw: Column) -> Column:
        """Canonical names by a literal map; unknown names stay as they are, trimmed."""
        return F.coalesce(F.element_at(literal_map(self._surface()), F.lower(F.trim(raw))), F.trim(raw))

    def effective_column(self, predicates: Column) -> Column:
        """The effective predicate of an array of canonical predicates, null if there is none: built-in higher-order functions only."""
        rules = literal_map({f"{self.canonical(a)}|{self.canonical(b)}": self.canonical(c) for a, b, c in reversed(self.compositions)})
        folded = F.aggregate(F.slice(predicates, 2, F.greatest(F.size(predicates) - 1, F.lit(0))), F.element_at(predicates, 1), lambda a, x: F.element_at(rules, F.concat(a, F.lit("|"), x)))
        transitive = {p: [q for q in self.supers(p) if self.has(q, "T")] for p in self.predicates}
        none = F.array().cast("array<string>")
        of = literal_map({p: F.array(*map(F.lit, qs)) if qs else none for p, qs in transitive.items()})
        lists = F.transform(predicates, lambda p: F.coalesce(F.element_at(of, p), none))
        common = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.element_at(lists, 1), lambda a, x: F.array_intersect(a, x))
        blank = F.exists(predicates, lambda p: F.trim(p) == "")
        return F.when((F.size(predicates) < 1) | blank, F.lit(None).cast("string")).when(F.size(predicates) == 1, F.get(predicates, 0)).otherwise(F.coalesce(folded, F.get(common, 0)))

    def closure_table(self, spark: SparkSession) -> DataFrame:
        """pred, super for every pair of the sub-property closure, itself included."""
        pairs = [{"pred": p, "super": q} for p in sorted(self.predicates) for q in self.supers(p)]
        return inline(spark, pairs, "pred string, super string")

    def disjoint_table(self, spark: SparkSession) -> DataFrame:
        """pred, conflict, both ways."""
        return inline(spark, [{"pred": a, "conflict": b} for x in self.disjoint for a, b in (x, x[::-1])], "pred string, conflict string")


def literal_map(entries: dict) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for pair in entries.items() for x in pair]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table as a literal of the plan."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def general() -> Registry:
    return Registry().extended(V.GENERAL, V.GENERAL_COMPOSITIONS, V.GENERAL_ALIASES)


def medical() -> Registry:
    return general().extended(V.MEDICAL, V.MEDICAL_COMPOSITIONS, V.MEDICAL_ALIASES, V.MEDICAL_DISJOINT, override=False)


PACKS = {"general": general, "medical": medical}


def load_registry(text: str) -> Registry:
    """A registry from JSON: extends (pack names), types, aliases, predicates, compositions, disjoint."""
    data = json.loads(text)
    extends = data.get("extends") or ["general"]
    base = general()
    for name in [extends] if isinstance(extends, str) else extends:
        if name not in PACKS:
            raise ValueError(f"unknown pack {name}")
        base = medical() if name == "medical" else base
    letters = {"transitive": "T", "symmetric": "S", "reflexive": "R", "asymmetric": "A", "irreflexive": "I", "functional": "F", "inverse_functional": "N"}
    chars = lambda p: "".join(letters[c.lower().replace("-", "_")] for c in p.get("characteristics", []))
    found = data.get("predicates", [])
    return base.extended(
        {p["canonical"]: (p.get("inverse_of"), p.get("sub_property_of", []), chars(p)) for p in found},
        [(c["first"], c["second"], c["result"]) for c in data.get("compositions", [])],
        data.get("aliases", {}),
        [(d["a"], d["b"]) for d in data.get("disjoint", [])],
        {p["canonical"]: p["domain"] for p in found if p.get("domain")},
        {p["canonical"]: p["range"] for p in found if p.get("range")},
        {t["name"]: t.get("supertypes", []) for t in data.get("types", [])},
    )
