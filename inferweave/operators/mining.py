"""Background mining of a graph: degrees, shared neighbours, missing links, inventories, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferweave.functions.lineage import cut
from inferweave.functions.registry import Registry
from inferweave.functions.scalars import factorization_gain, neighbourhood_gain, norm_key, plausible_name


#: Query vectors of a block.
BLOCK = 256
#: Rows of a hub that one task joins with the hub's other side.
HUB = 1024


def hub_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right on keys. The left rows of a key of more than HUB rows are dealt out in parts, each of which meets

    all right rows of the key: what a hub has to be joined with is spread over tasks, and no row is lost.
    """
    hubs = left.groupBy(*keys).agg(F.ceil(F.count("*") / HUB).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hubs, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    b = right.join(hubs, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"]).drop("_part")


def ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 1 in the order, which must be total: rows are dealt out by ranges of it, and only the ranges' sizes come together."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn("rank", (F.col("_start") + place).cast("bigint")).drop("_range", "_start")


def degrees(edges: DataFrame, side: str = "out") -> DataFrame:
    """name, degree."""
    return edges.groupBy(F.col("src_id" if side == "out" else "dst_id").alias("name")).agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, side: str, k: int, skip: int = 0) -> DataFrame:
    return degrees(edges, side).orderBy(F.desc("degree"), "name").offset(skip).limit(k)


def shared_neighbours(edges: DataFrame, role: str = "head") -> DataFrame:
    """seed, pred, partner, shared: distinct middles that two nodes point to (head) or are pointed to from (tail) by one predicate.

    Each pair is counted once and then told both ways; a middle of many nodes is spread over tasks.
    """
    near, far = ("src_id", "dst_id") if role == "head" else ("dst_id", "src_id")
    e = edges.select(F.col(near).alias("end"), "pred", F.col(far).alias("middle")).distinct()
    pairs = hub_join(e.withColumnRenamed("end", "low"), e.withColumnRenamed("end", "high"), ["pred", "middle"]).where("low < high")
    counted = pairs.groupBy("low", "pred", "high").agg(F.count("*").alias("shared"))
    way = lambda a, b: F.struct(F.col(a).alias("seed"), F.col(b).alias("partner"))
    return counted.select(F.explode(F.array(way("low", "high"), way("high", "low"))).alias("w"), "pred", "shared").select("w.seed", "pred", "w.partner", "shared")


def bridge_candidates(edges: DataFrame, role: str = "head", floor: int = 5) -> DataFrame:
    """The densest partner of each seed, with the claim that would factor their common neighbours out."""
    found = shared_neighbours(edges, role).where((F.col("shared") >= floor) & plausible_name(F.col("seed")) & plausible_name(F.col("partner")))
    order = Window.partitionBy("seed").orderBy(F.desc("shared"), "pred", "partner")
    best = found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return best.withColumn("claim", F.concat(F.lit(f"shares_generalization_with:{role}:"), F.lower("pred"))).withColumn("gain", factorization_gain(F.col("shared")))


def two_hop(edges: DataFrame) -> DataFrame:
    """seed, far: distinct nodes two directed hops away; a middle node of many edges is spread over tasks."""
    pairs = edges.select("src_id", "dst_id").distinct()
    a, b = pairs.select(F.col("src_id").alias("seed"), F.col("dst_id").alias("mid")), pairs.select(F.col("src_id").alias("mid"), F.col("dst_id").alias("far"))
    return hub_join(a, b, ["mid"]).where("seed != far").select("seed", "far").distinct()


def missing_links(edges: DataFrame) -> DataFrame:
    """seed, predicate, far, gain: two-hop ends that aren't direct neighbours; the predicate is the first of the seed's own."""
    direct = edges.select(F.col("src_id").alias("seed"), norm_key(F.col("dst_id")).alias("_key")).distinct()
    own = edges.groupBy(F.col("src_id").alias("seed")).agg(F.min(F.lower("pred")).alias("predicate"), F.countDistinct("dst_id").alias("degree"))
    far = two_hop(edges).withColumn("_key", norm_key(F.col("far"))).join(direct, ["seed", "_key"], "left_anti").drop("_key")
    return far.join(own, "seed").select("seed", "predicate", "far", neighbourhood_gain(F.col("degree")).alias("gain"))


def structural_holes(edges: DataFrame) -> DataFrame:
    """seed, far of A to B to C without A to C."""
    return two_hop(edges).join(edges.select(F.col("src_id").alias("seed"), F.col("dst_id").alias("far")).distinct(), ["seed", "far"], "left_anti")


def predicate_inventory(edges: DataFrame, entities: DataFrame, registry: Registry, limit: int | None = None) -> DataFrame:
    """canonical, declared, side, label, n in long form; side `all` counts edges. limit takes the first edges by id."""
    if limit is not None:
        edges = edges.orderBy("edge_id").limit(limit)
    e = edges.select("edge_id", "src_id", "dst_id", registry.canonical_column(F.col("pred_raw")).alias("canonical"))
    declared = F.lower("canonical").isin(*[p.lower() for p in registry.predicates])
    labels = entities.select("id", F.array_distinct(F.transform("labels", lambda x: F.upper(F.trim(x)))).alias("labels"))
    out = e.groupBy("canonical").agg(F.count("*").alias("n")).select("canonical", declared.alias("declared"), F.lit("all").alias("side"), F.lit("").alias("label"), "n")
    for side, end in (("head", "src_id"), ("tail", "dst_id")):
        # counted by node first: what meets the labels is a row per node and predicate, however many edges a hub has
        ends = e.groupBy("canonical", F.col(end).alias("id")).agg(F.count("*").alias("edges"))
        typed = ends.join(labels, "id").select("canonical", F.explode("labels").alias("label"), "edges")
        out = out.unionByName(typed.groupBy("canonical", "label").agg(F.sum("edges").alias("n")).select("canonical", declared.alias("declared"), F.lit(side).alias("side"), "label", "n"))
    return out


def nearest(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, nearest, similarity: the most similar of the candidates (id, vector) to each query other than itself.

    A stated query set against all candidates, exactly: both are brought to length 1 once, the queries are put together in
    blocks of BLOCK, and a candidate meets a block at a time; of each block and task only the best per query goes on.
    Vectors of no length or of another width than a query's are similar to nothing (minus infinity).
    """
    double = F.transform("vector", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(F.col("unit"), F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda df: df.select("id", double.alias("unit")).select("id", F.when(length > 0, F.transform("unit", lambda x: x / length)).otherwise(F.array().cast("array<double>")).alias("unit"))
    blocks = unit(queries).groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))).alias("block")).agg(F.collect_list(F.struct(F.col("id").alias("q"), F.col("unit").alias("x"))).alias("held"))
    pairs = unit(candidates).withColumnsRenamed({"id": "c", "unit": "y"}).join(cut(blocks))
    fits = (F.size("x") > 0) & (F.size("x") == F.size("y"))
    score = F.when(fits, F.round(F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)).otherwise(F.lit(float("-inf")))
    scored = pairs.select("c", "y", F.inline("held")).where("q != c").select("q", "c", score.alias("s"))
    best = scored.groupBy("q").agg(F.max(F.struct("s", -F.col("c"))).alias("b"))
    return best.select(F.col("q").alias("id"), (-F.col("b.col2")).alias("nearest"), F.col("b.s").alias("similarity"))


def truth_energy(edges: DataFrame, axioms: DataFrame, rounds: int = 4) -> DataFrame:
    """node, energy: the best product of confidences along a path from an axiom (energy 1), within so many rounds."""
    energy = axioms.select("node", F.lit(1.0).alias("energy"))
    e = edges.select("src_id", "dst_id", F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(1.0).alias("c"))
    for _ in range(rounds):
        step = e.join(energy, e["src_id"] == energy["node"]).select(F.col("dst_id").alias("node"), (F.col("energy") * F.col("c")).alias("energy"))
        energy = cut(energy.unionByName(step).groupBy("node").agg(F.max("energy").alias("energy")))
    return energy


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label by synchronous label propagation: the most frequent label of the neighbours, ties to the least."""
    e = cut(edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).union(edges.select("dst_id", "src_id")).distinct())
    labels = e.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = e.join(labels, e["b"] == labels["node"]).groupBy("a", "label").agg(F.count("*").alias("n"))
        order = Window.partitionBy("a").orderBy(F.desc("n"), "label")
        labels = cut(votes.withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("a").alias("node"), "label"))
    return labels


def fused_ranks(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """id, score: reciprocal-rank fusion of tables (id, rank)."""
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def resolved_conflicts(claims: DataFrame, key: list[str], says: str) -> DataFrame:
    """The claim that wins of each key by status (axiom, observation, induced, deduced), confidence and id.

    review marks keys whose axioms disagree in the column says. One aggregation, which combines before the shuffle: a
    key with very many claims is no hot task.
    """
    rank = F.struct(status_rank(F.col("status")).alias("s"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id"))
    axiom = F.when(F.col("status") == "axiom", F.col(says))
    rest = [c for c in claims.columns if c not in key]
    out = claims.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("won"), F.coalesce(F.min(axiom) != F.max(axiom), F.lit(False)).alias("review"))
    return out.select(*key, "won.*", "review")


def status_rank(status: Column) -> Column:
    return F.when(status == "axiom", 0).when(status == "observation", 1).when(status == "induced", 2).otherwise(3)


def route_topics(texts: DataFrame, topics: DataFrame, default: str | None = None) -> DataFrame:
    """id, topic, overlap: the topic (topic, tokens) that shares most distinct tokens with a text (id, tokens); ties and no overlap go by name."""
    words = texts.select("id", F.explode(F.array_distinct("tokens")).alias("t"))
    of = topics.select("topic", F.explode(F.array_distinct("tokens")).alias("t"))
    score = words.join(of, "t").groupBy("id", "topic").agg(F.count("*").alias("overlap"))
    best = score.groupBy("id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "topic")).alias("b"))
    fallback = F.lit(default) if default else F.lit(topics.agg(F.min("topic")).first()[0])
    return texts.select("id").join(best, "id", "left").select("id", F.coalesce("b.topic", fallback).alias("topic"), F.coalesce(-F.col("b.o"), F.lit(0)).alias("overlap"))


def sample_entities(entities: DataFrame, n: int, seed: int) -> DataFrame:
    """n entities in an order that the seed decides (a sample is the feature)."""
    return entities.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def embedding_width(entities: DataFrame, column: str = "name_embedding") -> int | None:
    """The length of the first embedding that isn't empty."""
    row = entities.where(F.size(column) > 0).select(F.size(column)).first()
    return row[0] if row else None
