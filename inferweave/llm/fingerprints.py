"""Document fingerprints from closed syncmers, in DataFrame operations only.

A k-mer of code points is an anchor if the least hash of its inner s-mers stands at its first or its last s-mer. Whether
it is depends on the k-mer alone, so equal passages have equal anchors wherever they stand, with at most k - s code
points between two. A fingerprint is the sequence of the anchors' distinct hashes in text order. Texts shorter than
SHORT, in which few k-mers would stand, have all their SMALL-mers as anchors, or the whole text if it is shorter still;
empty texts have none.

Because anchors are free of context, those of a text put together from pieces are those of the pieces and of the few
code points around each seam; the fingerprints of edited texts here are made that way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inferweave.llm.common import table

#: Code points of an s-mer, s-mers of a k-mer (a power of two), code points of a k-mer.
S, W = 5, 32
K = S + W - 1
SHORT, SMALL = 4 * K, 8
#: Documents that are neighbours by id are brought together in buckets of about so many.
BUCKET, MAX_BOUNDS = 2000, 1024
ANCHORS = "array<struct<p:int,x:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_least(h: Column) -> Column:
    """At each place the least of W values, by doubling: the least of 2, 4, 8 and so on."""
    out, width = h, 1
    while width < W:
        out = let(out, shifted_least(width))
        width *= 2
    return out


def shifted_least(n: int) -> Callable[[Column], Column]:
    """The least of each value and the one n places after it."""

    def body(a: Column) -> Column:
        rest = F.greatest(F.size(a) - n, F.lit(0))
        return F.zip_with(F.slice(a, 1, rest), F.slice(a, n + 1, rest), lambda x, y: F.least(x, y))

    return body


def syncmers(text: Column) -> Column:
    """Places and 32-bit hashes of the closed syncmers of a text of K code points or more, in order."""
    smers = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1))
    hashes = F.transform(smers, lambda x: F.xxhash64(x))

    def select(h: Column) -> Column:
        edges = F.zip_with(F.slice(h, 1, F.size(h) - W + 1), F.slice(h, W, F.size(h) - W + 1), lambda a, b: F.least(a, b))
        chosen = F.zip_with(edges, window_least(h), lambda e, m: e == m)
        places = F.filter(F.transform(chosen, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
        # s-mers that cover the k-mer
        cover = [*range(0, W - 1, S), W - 1]
        return F.transform(places, lambda i: F.struct(i.cast("int").alias("p"), F.hash(*[F.get(h, i + j) for j in cover]).alias("x")))

    return let(hashes, select)


def short_anchors(text: Column) -> Column:
    """Of a short text: all its SMALL-mers, or the whole."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{SMALL}}}))."), F.lit(1)), lambda x, i: F.struct(i.cast("int").alias("p"), F.hash(F.lit("short"), x).alias("x")))
    whole = F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("p"), F.hash(F.lit("whole"), text).alias("x")))).otherwise(F.array().cast(ANCHORS))
    return F.when(F.length(text) >= SMALL, parts).otherwise(whole)


def anchors(text: Column) -> Column:
    """Places and hashes of a text's anchors. text must not be null."""
    return F.when(F.length(text) >= SHORT, syncmers(text)).otherwise(short_anchors(text)).cast(ANCHORS)


def values(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda a: a["x"]))


def fingerprint(vals: Column) -> Column:
    """Eight hex digits per distinct hash, in text order."""
    return F.array_join(F.transform(vals, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(4294967295)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of distinct hashes; of two empty ones 1."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every > 0, common / every).otherwise(F.lit(1.0))


def neighbour_buckets(docs: DataFrame) -> Column:
    """A bucket number for dk that grows with it, with about BUCKET rows each: quantiles, split evenly inside where there are many rows."""
    total = docs.count()
    bounds = max(1, min(MAX_BOUNDS, total // BUCKET))
    inner = max(1, total // bounds // BUCKET)
    found = docs.agg(F.percentile_approx("dk", [i / bounds for i in range(bounds + 1)], 10_000)).first()[0] or [0]
    edges = sorted(set(found))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b < F.col("dk")))
    if inner == 1:
        return at.cast("bigint")
    low, high = F.array(F.lit(edges[0]), *map(F.lit, edges)), F.array(*map(F.lit, edges), F.lit(edges[-1]))
    lo, hi = F.element_at(low, at + 1), F.element_at(high, at + 1)
    part = F.when(hi > lo, F.least(F.lit(inner - 1), F.floor((F.col("dk").cast("double") - lo) / (hi.cast("double") - lo) * inner))).otherwise(F.lit(0))
    return (at * inner + F.greatest(part, F.lit(0))).cast("bigint")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors of docs (doc_id, text) with next_text and next_anchors: of the next document by descending doc_id, after the last the first.

    One shuffle of the texts, by bucket; the first document of each bucket also goes to the end of the bucket above.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("dk"))
    keyed = keyed.withColumn("bucket", neighbour_buckets(keyed.select("dk")))
    tops = keyed.groupBy("bucket").agg(F.max("dk").alias("dk"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order))
    moved = keyed.drop("bucket").join(tops.select("dk", above.alias("bucket")), "dk").withColumn("extra", F.lit(1))
    rows = keyed.withColumn("extra", F.lit(0)).unionByName(moved)
    place = ["extra", F.desc("dk"), "text", "doc_id"]
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *place).withColumn("anchors", anchors(F.col("text")))
    ahead = Window.partitionBy("bucket").orderBy(*place)
    rows = rows.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_anchors", F.lead("anchors").over(ahead))
    return rows.where("extra = 0").select("doc_id", "text", "anchors", "next_text", "next_anchors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, whose last third is the beginning of the next document.

    Null texts are empty. Rows that share a doc_id stand in order of their texts; rows without doc_id come last. A lone
    document is its own next one. An empty table gives an empty table.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("head", F.expr(f"substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))")).withColumn("tail", F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", F.concat("head", "tail")).withColumn("n_head", F.length("head")).withColumn("n_tail", F.length("tail"))
    seam = F.concat(F.right("head", F.lit(K - 1)), F.left("tail", F.lit(K - 1)))
    crossing = F.when(F.length(seam) >= K, syncmers(seam)).otherwise(F.array().cast(ANCHORS))
    inside = lambda found, n: F.filter(found, lambda a: a["p"] + K <= n)
    # a short next document has anchors of the other kind
    n_next = F.length("next_text")
    of_next = F.when(n_next >= SHORT, F.col("next_anchors")).when(n_next >= K, syncmers(F.col("next_text"))).otherwise(F.array().cast(ANCHORS))
    joined = F.concat(inside(F.col("anchors"), F.col("n_head")), crossing, inside(of_next, F.col("n_tail")))
    rows = rows.withColumn("v", values(F.col("anchors"))).withColumn("v_next", values(F.col("next_anchors")))
    rows = rows.withColumn("v_edited", values(F.when(F.length("edited") >= SHORT, joined).otherwise(short_anchors(F.col("edited")))))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("v")).alias("fingerprint"),
        fingerprint(F.col("v_edited")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("v_edited")).alias("near_edited"),
        likeness(F.col("v"), F.col("v_next")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
