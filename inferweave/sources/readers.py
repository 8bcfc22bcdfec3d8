"""Readers of rules, registries, golden claims, scopes and extracted text."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = "struct<entity:string,var:string>"
PATTERN = f"struct<subject:{TERM},predicate:string,predicate_canonical:string,object:{TERM},negated:boolean>"
RULE = f"struct<schema_version:string,id:string,rule_type:string,confidence:double,conditions:array<{PATTERN}>,consequent:{PATTERN},exceptions:array<{PATTERN}>>"
EXTRACTION = "struct<triples:array<struct<subject:string,predicate:string,object:string,condition:string,temporal:string,location:string,confidence:double>>,rules:array<struct<antecedent:string,consequent:string,exception:string,rule_type:string,confidence:double>>>"


def read_rules_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A rule per line; a malformed line is an error."""
    schema = spark.range(0).select(F.from_json(F.lit("{}"), RULE).alias("r")).select("r.*").schema
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.limit(limit) if limit else rows


def decode_rules(nodes: DataFrame) -> DataFrame:
    """rule and state of rule nodes (uuid, attributes): attributes is JSON with a JSON string structured_rule.

    state: loaded, skipped_no_structured or skipped_invalid (unreadable, or unsafe: no id, no condition, or a variable
    of the consequent that no condition has).
    """
    held = F.get_json_object("attributes", "$.structured_rule")
    rule = F.from_json(held, RULE)
    bound = lambda r: F.flatten(F.transform(r["conditions"], lambda c: F.filter(F.array(c["subject"]["var"], c["object"]["var"]), lambda v: v.isNotNull())))
    wanted = lambda r: F.filter(F.array(r["consequent"]["subject"]["var"], r["consequent"]["object"]["var"]), lambda v: v.isNotNull())
    out = nodes.where("attributes IS NOT NULL").withColumn("rule", rule)
    valid = (F.length(F.trim(F.coalesce("rule.id", F.lit("")))) > 0) & (F.size(F.coalesce("rule.conditions", F.array().cast(f"array<{PATTERN}>"))) > 0) & F.coalesce("rule.confidence", F.lit(1.0)).between(0, 1) & (F.size(F.array_except(wanted(F.col("rule")), bound(F.col("rule")))) == 0)
    state = F.when(held.isNull() | (F.trim(held) == ""), "skipped_no_structured").when(F.coalesce(valid, F.lit(False)), "loaded").otherwise("skipped_invalid")
    return out.withColumn("state", state)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object, wanted of a JSON file: an array, or an object with cases; the verdict under any of four spellings."""
    claim = "struct<subject:string,predicate:string,object:string>"
    case = f"struct<claim:{claim},wantVerdictClass:string,want_verdict_class:string,verdict:string,want:string>"
    text = spark.read.text(path, wholetext=True)
    cases = F.coalesce(F.from_json(F.get_json_object("value", "$.cases"), f"array<{case}>"), F.from_json("value", f"array<{case}>"))
    return text.select(F.explode(cases).alias("c")).select("c.claim.*", F.coalesce("c.wantVerdictClass", "c.want_verdict_class", "c.verdict", "c.want").alias("wanted"))


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a text file: separated by commas or lines, # begins a comment."""
    part = F.explode(F.split(F.regexp_replace("value", "#.*", ""), ",")).alias("name")
    return spark.read.text(path).select(part).select(F.trim("name").alias("name")).where("name != ''").distinct()


def read_scope_descriptors(folder: str, defaults: dict | None = None) -> dict[str, dict]:
    """Scope name -> settings, from the JSON files of a folder; hidden files are left out."""
    out = {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json") and not name.startswith("."):
            with open(os.path.join(folder, name)) as f:
                data = (defaults or {}) | json.load(f)
            out[data.get("scope") or name[: -len(".json")]] = data
    return out


def discover_topics(folder: str, extensions: tuple[str, ...] = (".db", ".graph", ".parquet", "")) -> dict[str, str]:
    """Alias -> path of the graphs in a folder; two paths for one alias are an error."""
    out: dict[str, str] = {}
    for name in sorted(os.listdir(folder)):
        stem, ext = os.path.splitext(name)
        if name.startswith(".") or ext not in extensions:
            continue
        alias = stem.removesuffix(".g_g").removesuffix("_g").lower()
        if alias in out:
            raise ValueError(f"the topic {alias} is ambiguous: {out[alias]} and {name}")
        out[alias] = os.path.join(folder, name)
    return out


def extracted_edges(results: DataFrame) -> DataFrame:
    """Edges of extraction results (doc, json): status observation, conditions from condition, temporal and location."""
    t = results.select("doc", F.posexplode(F.from_json("json", EXTRACTION)["triples"]).alias("i", "t"))
    conditions = F.filter(F.array("t.condition", "t.temporal", "t.location"), lambda c: F.coalesce(c, F.lit("")) != "")
    return t.select(F.concat_ws(":", F.lit("triple"), "doc", "i").alias("id"), "t.subject", "t.predicate", "t.object", "t.confidence", F.lit("observation").alias("status"), conditions.alias("conditions"))


def extracted_rules(results: DataFrame) -> DataFrame:
    """Meta relations of extraction results: head and body of each rule, with frequency 1."""
    r = results.select("doc", F.posexplode(F.from_json("json", EXTRACTION)["rules"]).alias("i", "r"))
    return r.select(F.concat_ws(":", F.lit("rule"), "doc", "i").alias("id"), F.col("r.consequent").alias("head"), F.to_json(F.struct("r.antecedent", "r.consequent", "r.exception", "r.rule_type")).alias("body"), F.lit(1).alias("frequency"), "r.confidence")
