"""Questions and unconfirmed facts that mining proposes, and which of them to look at next."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferweave.functions.registry import Registry
from inferweave.functions.scalars import clamp01, claim_key, hash_entity, plausible_name, tautology

CAPACITY = 256
#: Gains of questions without one of their own, by what came out (fixed values).
FALLBACK_GAINS = {"random": 0.35, "unsupported": 0.85, "contradicted": 0.9}


def thoughts(missing: DataFrame, bridges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Claims worth a question (subject, predicate, object, rationale, gain) from missing links, bridges and unresolved claims.

    missing: seed, predicate, far, gain. bridges: seed, claim, partner, gain. unresolved: subject, predicate, object.
    """
    a = missing.select(F.col("seed").alias("subject"), "predicate", F.col("far").alias("object"), F.lit("two hops apart without a link").alias("rationale"), "gain")
    b = bridges.select(F.col("seed").alias("subject"), F.col("claim").alias("predicate"), F.col("partner").alias("object"), F.lit("many common neighbours").alias("rationale"), "gain")
    c = unresolved.select("subject", "predicate", "object", F.lit("asked for without an answer").alias("rationale"), F.lit(FALLBACK_GAINS["unsupported"]).alias("gain"))
    return a.unionByName(b).unionByName(c)


def plausible_claims(claims: DataFrame, registry: Registry) -> DataFrame:
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    return claims.where(~tautology(s, p, o, registry.reflexive()) & plausible_name(s) & plausible_name(o))


def bounded_store(rows: DataFrame, at: str, capacity: int = CAPACITY) -> DataFrame:
    """The newest rows (by at) of distinct claims, whatever their case; gain or confidence is brought into 0 to 1.

    A store of that capacity is the feature here: older rows fall out.
    """
    key = claim_key(F.col("subject"), F.col("predicate"), F.col("object"))
    first = rows.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(at))).where("_r = 1").drop("_r", "_key")
    for c in ("gain", "confidence"):
        if c in first.columns:
            first = first.withColumn(c, clamp01(F.coalesce(c, F.lit(0.0))))
    return first.orderBy(F.desc(at), "subject", "predicate", "object").limit(capacity)


def exported(claims: DataFrame, labels: bool = False) -> DataFrame:
    """Claims with hashes of their ends; the names themselves only if asked for."""
    out = claims.withColumn("subject_hash", hash_entity(F.col("subject"))).withColumn("object_hash", hash_entity(F.col("object")))
    return out if labels else out.drop("subject", "object")


def outcome(verdict, known):
    """What looking at a claim led to."""
    return F.when(known, "known").when(verdict == "contradicted", "conflict").when(verdict == "entailed", "confirmed").otherwise("question")


def pick_order(weights: dict[str, float], seed: int, floor: float = 0.05) -> list[str]:
    """Sources in a weighted random order; each has at least the floor's chance. The seed decides."""
    r, left, out = random.Random(seed), {k: max(floor, w) for k, w in sorted(weights.items())}, []
    while left:
        x = r.random() * sum(left.values())
        for name, w in left.items():
            x -= w
            if x <= 0:
                break
        out.append(name)
        del left[name]
    return out
