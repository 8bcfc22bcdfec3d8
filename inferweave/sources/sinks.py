"""Writers: graph emission, rule nodes, snapshots with validation and rollback, upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.functions.scalars import stable_relation_id


def emit_nodes(new: DataFrame, old: DataFrame | None, group_id: str) -> DataFrame:
    """Entity rows for nodes (id, name, kind, depth, support) that old lacks."""
    rows = new.select("id", "name", F.array("kind").alias("labels"), F.lit(group_id).alias("group_id"), F.to_json(F.struct("kind", "depth", "support")).alias("attributes")).dropDuplicates(["id"])
    return rows if old is None else rows.join(old.select("id"), "id", "left_anti")


def emit_relations(relations: DataFrame, group_id: str) -> DataFrame:
    """Edge rows for relations (id, source_id, source_name, predicate, target_id, target_name, sources, confidence, support, lifted)."""
    fact = F.concat_ws(" ", "source_name", "predicate", "target_name")
    return relations.select("id", "source_id", "target_id", F.col("predicate").alias("name"), fact.alias("fact"), "confidence", "support", F.lit(group_id).alias("group_id"), F.to_json(F.struct("lifted", "sources", "support")).alias("attributes"))


def rule_nodes(rules: DataFrame, group_id: str) -> DataFrame:
    """Rule rows for rules (id, ..., and name if there is one): the rule stands as a JSON string in the JSON attributes; names (ids where there are none) are cut at 100 bytes."""
    whole = F.to_json(F.struct(*rules.columns))
    name = F.coalesce(F.col("name"), F.col("id")) if "name" in rules.columns else F.col("id")
    return rules.select(F.col("id").alias("uuid"), cut_bytes(name, 100).alias("name"), F.lit(group_id).alias("group_id"), F.to_json(F.struct(whole.alias("structured_rule"))).alias("attributes"))


def cut_bytes(text: Column, n: int) -> Column:
    """The longest beginning of a text that takes at most n bytes of UTF-8: no character is cut."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(n))), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= n)
    return F.substring(text, F.lit(1), F.array_max(fits))


def in_order(nodes: DataFrame) -> DataFrame:
    """Rows for a sink in an order that reruns repeat: taxonomies by depth, child, parent and predicate, all else by id."""
    return nodes.orderBy(*(["depth", "child", "parent", "pred"] if {"child", "parent"} <= set(nodes.columns) else ["id"]))


def entity_uuid(name):
    return F.concat(F.lit("ent:"), F.sha1(F.lower(F.trim(name)).cast("binary")))


def condition_facts(rules: DataFrame) -> DataFrame:
    """Edges of the conditions (not the exceptions) of rules whose ends are entities."""
    c = rules.select(F.col("id").alias("rule_id"), "confidence", F.posexplode("conditions").alias("i", "c")).where("c.subject.entity IS NOT NULL AND c.object.entity IS NOT NULL AND NOT coalesce(c.negated, false)")
    return c.select(F.concat_ws(":", F.lit("rel"), "rule_id", "i").alias("edge_id"), entity_uuid(F.col("c.subject.entity")).alias("src_id"), F.col("c.predicate").alias("pred_raw"), entity_uuid(F.col("c.object.entity")).alias("dst_id"), F.lit(1.0).alias("confidence")).dropDuplicates(["edge_id"])


def dropped_backup(dropped: DataFrame, scope: str, batch: str) -> DataFrame:
    """Dropped edges with ids of their own per batch and the marker of what dropped them."""
    marker = F.lit(f"dropped_by:build-generalization:{scope}")
    return dropped.withColumn("sources", F.array_union("sources", F.array(marker))).withColumn("id", stable_relation_id(F.lit(batch), "id"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def _files(spark: SparkSession, folder: str):
    """Hadoop's file context of a folder, a maker of paths in it and the option to overwrite: whatever shared store the cluster has."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([folder.rstrip("/"), *parts]))
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    return path().getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path().getFileSystem(conf).makeQualified(path()).toUri(), conf), path, overwrite


def _point(spark: SparkSession, folder: str, name: str, version: str) -> None:
    """Lets the pointer file name hold a version: written beside it and renamed over it."""
    fs, context, path, overwrite = _files(spark, folder)
    new = f"{name}.{uuid.uuid4().hex}"
    out = fs.create(path(new), True)
    out.write(bytearray(version.encode()))
    out.close()
    context.rename(fs.makeQualified(path(new)), fs.makeQualified(path(name)), overwrite)


def _pointed(spark: SparkSession, folder: str, name: str) -> str | None:
    fs, _, path, _ = _files(spark, folder)
    if not fs.exists(path(name)):
        return None
    stream = fs.open(path(name))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_snapshot(df: DataFrame, folder: str, validate: Callable[[DataFrame], bool] | None = None) -> str:
    """Writes a new version, validates it and lets the pointer file `current` name it; a version that fails is removed and the pointer stays.

    folder is a path of any file system that Spark reaches; on a cluster it must be one that all executors share.
    """
    spark = df.sparkSession
    fs, _, path, _ = _files(spark, folder)
    version = f"v-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path(version).toString())
        if validate and not validate(spark.read.parquet(path(version).toString())):
            raise ValueError("the new snapshot isn't valid")
    except BaseException:
        fs.delete(path(version), True)
        raise
    if before := _pointed(spark, folder, "current"):
        _point(spark, folder, "previous", before)
    _point(spark, folder, "current", version)
    return path(version).toString()


def rollback_snapshot(spark: SparkSession, folder: str) -> str:
    """Lets `current` name the version before."""
    before = _pointed(spark, folder, "previous")
    if before is None:
        raise ValueError("there is no version to go back to")
    _point(spark, folder, "current", before)
    return _files(spark, folder)[2](before).toString()


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    version = _pointed(spark, folder, "current")
    if version is None:
        raise ValueError(f"{folder} holds no snapshot")
    return spark.read.parquet(_files(spark, folder)[2](version).toString())
