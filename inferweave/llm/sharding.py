"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, in the classical parallel form: rows lie in blocks, the number of rows
that each block sends to each shard is drawn from the multivariate hypergeometric law (the law those numbers have under
a uniform permutation of all rows), each block is permuted locally and cut at those numbers, the rows are exchanged,
and each shard is permuted again.

Only the block counts (at most MAX_BLOCKS numbers) reach the driver. Rows are never dealt out by a column that could
be skewed: blocks and sub-blocks come from a hash of id and text.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inferweave.llm.common import crc32_text, inline_table, materialize, table

MAX_BLOCKS = 8192
ROWS_A_BLOCK = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad are good: inversion outward from the mode, at any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up, moved = up + 1, True
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down, moved = down - 1, True
            u -= p_down
            if u <= 0:
                return down
        if not moved or p_up + p_down < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of block i that go to shard j. Row sums are the counts, column sums the shard sizes, which differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in counts:
        row, rest, open_ = [], n, sum(left)
        for j in range(shards):
            open_ -= left[j]
            row.append(hypergeometric(rng, left[j], open_, rest))
            rest -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, key_cols: list[str], shards: int = 16, seed: int = 17) -> DataFrame:
    """Adds shard (int) and slot (long, from 0 without gaps in each shard) to rows.

    key_cols identify a row; rows that agree in them are interchangeable. Nulls are keys like any other. An empty
    table stays empty. rows is read twice and should be narrow or materialized. Columns of rows with names that are
    used here (shard, slot, and those that begin with an underscore) are dropped. Reruns agree.
    """
    spark = rows.sparkSession
    rows = rows.select(*[c for c in rows.columns if c not in ("shard", "slot") and not c.startswith("_")])
    keys = [F.col(c) for c in key_cols]
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    total = rows.count()
    blocks = max(1, min(MAX_BLOCKS, -(-total // ROWS_A_BLOCK)))
    bits = max(0, min(12, (max(1, total // (shards * ROWS_A_BLOCK))).bit_length()))
    blocked = hashed.withColumn("_block", F.pmod("_h", F.lit(blocks)).cast("int"))
    counts = dict(blocked.groupBy("_block").count().collect())  # at most MAX_BLOCKS rows
    order = sorted(counts)
    cuts = []
    for block, row in zip(order, communication_matrix([counts[b] for b in order], shards, seed), strict=True):
        ends, end = [], 0
        for n in row:
            ends.append(end := end + n)
        cuts.append({"_block": block, "_cuts": ends})
    plan = inline_table(spark, json.dumps(cuts), "_block: int, _cuts: array<bigint>")

    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    dealt = (
        blocked.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(plan), "_block")  # at most MAX_BLOCKS rows
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int"))
        .withColumn("_h", F.xxhash64(F.lit(seed + 2), *keys))
        .withColumn("_sub", F.shiftrightunsigned("_h", 64 - bits).cast("int") if bits else F.lit(0))
        .drop("_block", "_rank", "_cuts")
    )
    dealt = materialize(dealt, "dealt")
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_sub").agg(F.count("*").alias("_n")).select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_sub").orderBy("_h", *keys)
    return (
        dealt.join(F.broadcast(starts), ["shard", "_sub"])  # at most shards x 2^12 rows
        .withColumn("slot", (F.col("_start") + F.row_number().over(again) - 1).cast("bigint"))
        .drop("_h", "_sub", "_start")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law `rows`. Null text: size 1 and the CRC of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), crc32_text(text).alias("text_crc32"))
    out = shuffle_into_shards(materialize(narrow, "sizes"), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
