"""Graphs as two tables: entities (id, name, kind, labels, group_id) and edges, one row per logical edge.

edges: edge_id, src_id, pred_raw, pred (canonical), dst_id, confidence, status.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.functions.registry import Registry, general

QUARANTINED = ("deduced", "speculative")
QUARANTINED_LABELS = ("GENE", "PROTEIN")


@dataclass
class Graph:
    edges: DataFrame
    entities: DataFrame | None = None

    def quarantined(self, status: bool = True, labels: tuple[str, ...] = ()) -> Graph:
        """Without edges of unconfirmed status and edges that touch an entity with one of the labels; columns that are absent switch a filter off."""
        edges = self.edges
        if status and "status" in edges.columns:
            edges = edges.where(~F.lower(F.coalesce("status", F.lit(""))).isin(*QUARANTINED))
        if labels and self.entities is not None and "labels" in self.entities.columns:
            bad = self.entities.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))).select("id")
            edges = edges.join(bad.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(bad.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
        return Graph(edges.select(*self.edges.columns), self.entities)

    def canonicalized(self, registry: Registry) -> Graph:
        return Graph(self.edges.withColumn("pred", registry.canonical_column(F.col("pred_raw"))), self.entities)

    def restricted(self, *predicates: str) -> Graph:
        return Graph(self.edges.where(F.col("pred").isin(*predicates)), self.entities)


def read_graph(spark: SparkSession, folder: str) -> Graph:
    """A graph from Parquet tables entities and edges."""
    return Graph(spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/entities"))


def predicates_of(graph: Graph) -> DataFrame:
    return graph.edges.select("pred_raw").distinct()


#: Edges of the demo graph by table: name of the part -> SQL over the source tables.
DEMO = {
    "customer_nation": "SELECT concat('e:cn:', c_custkey) AS edge_id, concat('customer:', c_custkey) AS src_id, 'located in' AS pred_raw, concat('nation:', c_nationkey) AS dst_id, CAST(1.0 AS DOUBLE) AS confidence, '' AS status FROM customer",
    "supplier_nation": "SELECT concat('e:sn:', s_suppkey), concat('supplier:', s_suppkey), 'located_in', concat('nation:', s_nationkey), CAST(1.0 AS DOUBLE), '' FROM supplier",
    "nation_region": "SELECT concat('e:nr:', n_nationkey), concat('nation:', n_nationkey), 'part of', concat('region:', n_regionkey), CAST(0.95 AS DOUBLE), '' FROM nation",
    "part_type": "SELECT concat('e:pt:', p_partkey), concat('part:', p_partkey), 'is a', concat('type:', p_type), CAST(0.9 AS DOUBLE), '' FROM part",
    "type_any": "SELECT DISTINCT concat('e:ta:', p_type), concat('type:', p_type), 'subtype of', 'type:ANY', CAST(0.8 AS DOUBLE), '' FROM part",
    "part_brand": "SELECT concat('e:pb:', p_partkey), concat('part:', p_partkey), 'instance of', concat('brand:', p_brand), CAST(1.0 AS DOUBLE), '' FROM part",
    "brand_maker": "SELECT DISTINCT concat('e:bm:', p_brand), concat('brand:', p_brand), 'is_a', concat('mfgr:', CAST(split_part(p_brand, '#', 2) AS INT) % 5), CAST(1.0 AS DOUBLE), '' FROM part",
    "supplier_part": "SELECT concat('e:sp:', l_suppkey, ':', l_partkey), concat('supplier:', l_suppkey), 'supplies', concat('part:', l_partkey), round(1 - avg(l_discount), 6), CASE WHEN sum(l_quantity) < 10 THEN 'speculative' ELSE '' END FROM lineitem GROUP BY l_suppkey, l_partkey",
    "supplier_recall": "SELECT concat('e:sr:', l_suppkey, ':', l_partkey), concat('supplier:', l_suppkey), 'recalls', concat('part:', l_partkey), round(CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / count(*), 6), '' FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0",
    "order_customer": "SELECT concat('e:oc:', o_orderkey), concat('order:', o_orderkey), 'placed_by', concat('customer:', o_custkey), CAST(1.0 AS DOUBLE), '' FROM orders",
    "customer_segment": "SELECT concat('e:cs:', c_custkey), concat('customer:', c_custkey), 'prefers', concat('segment:', c_mktsegment), CAST(1.0 AS DOUBLE), '' FROM customer",
}
DEMO_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TAXONOMIC = ("located_in", "part_of", "is_a", "instance_of")


def demo_registry() -> Registry:
    """The general pack with the demo graph's own composition, disjoint pair and types."""
    return general().extended(
        {"supplies": (None, [], ""), "recalls": (None, [], "")},
        [("supplies", "is_a", "supplies")],
        disjoint=[("supplies", "recalls")],
        domains={"supplies": ["Agent"], "located_in": ["Thing"]},
        ranges={"supplies": ["Good"], "located_in": ["Place"]},
        types={"Thing": [], "Agent": ["Thing"], "SUPPLIER": ["Agent"], "CUSTOMER": ["Agent"], "Good": ["Thing"], "PART": ["Good"], "Place": ["Thing"], "NATION": ["Place"], "REGION": ["Place"]},
    )


def demo_sql(parts: tuple[str, ...] | None = None) -> str:
    return " UNION ALL ".join(DEMO[p] for p in parts or DEMO)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the source tables; those that it names are read."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DEMO_TABLES if re.search(rf"\bFROM {t}\b", sql)}
    return spark.sql(re.sub(r"\bFROM (\w+)", r"FROM {\1}", sql), **named)


def demo_graph(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] | None = None) -> Graph:
    """The demo graph, or the named parts of it; each part scans only its own table's columns."""
    edges = run_sql(spark, sf_dir, demo_sql(parts)).toDF("edge_id", "src_id", "pred_raw", "dst_id", "confidence", "status")
    kind = lambda c: F.substring_index(c, ":", 1)
    entities = edges.select(F.col("src_id").alias("id")).union(edges.select("dst_id")).distinct()
    entities = entities.select("id", F.substring_index("id", ":", -1).alias("name"), kind("id").alias("kind"), F.array(F.upper(kind("id"))).alias("labels"), F.lit("demo").alias("group_id"))
    return Graph(edges, entities).canonicalized(demo_registry())
