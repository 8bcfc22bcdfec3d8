"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and a cap, those of least relative entropy to one copy of each document that meet a
token constraint per group are exponential tilts min(cap, exp(lambda_group * size)): where a group needs more tokens its
longer documents are repeated first, where it needs fewer they are left out first, and rates depend on the document. The
multipliers solve a convex dual, here by Newton steps on its logarithm that are kept within the bracket found so far:
the gradient and the (diagonal) Hessian of all groups come from one distributed aggregation over the histogram of
sizes, and the multipliers are a table too. The rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inferweave.llm.common import WORD, lehmer, materialize, table

#: A group's documents are rounded in cells of about so many.
CELL = 512
#: Rates are whole multiples of one in so many, so that sums of them are exact.
UNIT = 1_000_000
#: Documents of a group whose rounding is changed, one after the other, to bring its tokens nearer to the target.
FLIPS = 3


def token_targets(groups: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """groups (grp, no_grp, tokens) with target: share x all tokens by weight, none above cap x its tokens.

    Weights repeat over the groups in code point order, null last. Resharing what exceeds the caps ends at one level:
    min(cap x tokens, level x weight). groups has one row per source, so the unpartitioned windows see few rows.
    """
    order = Window.orderBy("no_grp", "grp")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = groups.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", cap * F.col("tokens")).withColumn("level_at", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy("level_at", "no_grp", "grp")
    earlier, later = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("budget", share * F.sum("tokens").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("level_at") * (1 + 1e-12), F.struct("level_at", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return leveled.select("grp", "no_grp", "tokens", "docs", F.round(target, 6).alias("target"))


def newton_multipliers(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 200, tolerance: float = 1e-13) -> DataFrame:
    """targets with lam: the sum over documents of size * min(cap, exp(lam * x)) is target for each group, x being size over the group's mean size.

    sizes: grp, no_grp, size, n (documents of that size); targets: grp, no_grp, tokens, docs, target and any others. lam
    is null where the target takes cap copies of everything. Each round is one aggregation. A step is Newton's for the
    logarithm of the sum, without what is capped; where it leaves the bracket of the steps before, the bracket is halved,
    and while one end is open a step is as long as all before at most. Groups without tokens keep lam 0.
    """
    keys = ["grp", "no_grp"]
    full = F.col("target") >= cap * F.col("tokens") * (1 - 1e-12)
    state = targets.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf"))).withColumn("open", (F.col("tokens") > 0) & ~full)
    for _ in range(rounds):
        x = F.col("size") * F.col("docs") / F.col("tokens")
        tilted = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        mass = F.col("n") * F.col("size") * F.least(F.lit(cap), tilted)
        free = F.when(tilted < cap, F.col("n") * F.col("size") * tilted * x).otherwise(F.lit(0.0))
        dual = sizes.join(state.where("open").select(*keys, "lam", "docs", "tokens"), keys).groupBy(*keys).agg(F.sum(mass).alias("g"), F.sum(free).alias("h"))
        joined = state.join(dual, keys, "left")
        gap = F.log(F.col("target")) - F.log("g")
        joined = joined.withColumn("gap", gap).withColumn("lo", F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap < 0, F.col("lam")).otherwise(F.col("hi")))
        reach = F.greatest(F.lit(1.0), F.abs("lam"))
        step = F.when(F.col("h") > 0, F.greatest(-reach, F.least(reach, F.col("gap") * F.col("g") / F.col("h")))).otherwise(F.signum("gap") * reach)
        at = F.col("lam") + step
        outside = (at <= F.col("lo")) | (at >= F.col("hi"))
        bracketed = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf"))
        moved = F.when(outside & bracketed, (F.col("lo") + F.col("hi")) / 2).otherwise(at)
        done = (F.abs("gap") <= tolerance) | (moved == F.col("lam"))
        state = joined.select(*targets.columns, F.when(F.col("open") & ~done, moved).otherwise(F.col("lam")).alias("lam"), "lo", "hi", (F.col("open") & ~F.coalesce(done, F.lit(True))).alias("open"))
        state = materialize(state, "multipliers")
        if state.where("open").isEmpty():
            break
    else:
        raise RuntimeError("the multipliers didn't settle")
    return state.select(*targets.columns, F.when(~full | (F.col("tokens") == 0), F.col("lam")).alias("lam"))


def entropy_balance(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """docs (doc_id, source, size) with source_size, target, rate, copies, taken.

    Each document gets floor(rate) copies and, for the fraction, one more by systematic selection along the sizes
    within cells of its group, the sum of the fractions carried on from cell to cell; then, FLIPS times, the one document
    of each group whose change by a copy brings the group's tokens nearest to its target is changed. A null source is a group of its own; empty
    documents take 0; an empty table gives an empty table; repeated rows are documents of their own. Reruns agree.
    """
    keys = ["grp", "no_grp"]
    base = docs.select("doc_id", "source", "size", F.coalesce("source", F.lit("")).alias("grp"), F.col("source").isNull().cast("int").alias("no_grp"), lehmer(F.col("doc_id")).alias("h"))
    base = materialize(base, "sizes")
    hist = materialize(base.groupBy(*keys, "size").agg(F.count("*").alias("n")), "histogram")
    groups = hist.groupBy(*keys).agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("n").alias("docs"))
    targets = materialize(token_targets(groups, share, cap, weights), "targets")
    solved = newton_multipliers(hist, targets, cap)
    rates = materialize(solved.withColumn("lam", F.round("lam", 9)).withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("docs") / CELL)).cast("bigint")), "rates")

    x = F.col("size") * F.col("docs") / F.col("tokens")
    units = F.when(F.col("tokens") == 0, F.lit(UNIT)).when(F.col("lam").isNull(), F.lit(int(cap * UNIT))).otherwise(F.round(UNIT * F.least(F.lit(cap), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))))
    # ids may be null or repeated: the size tells their cells apart
    celled = base.join(rates, keys).withColumn("cell", F.pmod(F.col("h") + F.col("size") * 7919, F.col("cells"))).withColumn("units", units.cast("bigint"))
    celled = celled.withColumn("whole", F.floor(F.col("units") / UNIT)).withColumn("part", F.col("units") % UNIT)
    cell_keys = [*keys, "cell"]
    earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = celled.groupBy(*cell_keys).agg(F.count("*").alias("m"), F.sum("part").alias("s")).select(*cell_keys, before("m").alias("start"), before("s").alias("part_start"))
    within = Window.partitionBy(*cell_keys).orderBy("size", "h", "doc_id")
    picked = celled.join(starts, cell_keys).withColumn("place", F.col("start") + F.row_number().over(within))
    picked = picked.withColumn("sum_to", F.col("part_start") + F.sum("part").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.floor(F.col("sum_to") / UNIT) - F.floor((F.col("sum_to") - F.col("part")) / UNIT)
    picked = picked.withColumn("extra", extra).withColumn("rate", F.col("units") / UNIT)
    rounded = materialize(picked.select("doc_id", "source", *keys, "h", "size", "tokens", "target", "rate", "whole", "extra", "place"), "rounded")

    # a change is a copy more or less of a document; state keeps the places of changed documents, negative for a copy less
    state = rounded.groupBy(*keys).agg(F.max("target").alias("t"), F.sum(F.col("size") * (F.col("whole") + F.col("extra"))).alias("got"))
    state = state.select(*keys, F.round(F.col("t") - F.col("got"), 6).alias("off"), F.array().cast("array<bigint>").alias("flips"))
    state = materialize(state, "flips")  # a row per source, whose size is known when it is joined
    held = F.col("whole") + F.col("extra")
    ways = F.array(F.when(held >= 1, F.lit(-1)), F.when(held + 1 <= cap, F.lit(1)))
    for _ in range(FLIPS):
        after = F.round(F.col("off") - F.col("way") * F.col("size"), 6)
        best = (
            rounded.where("size > 0")
            .withColumn("way", F.explode(ways))
            .join(state, keys)
            .where((F.abs(after) < F.abs("off")) & ~F.array_contains("flips", F.col("place")) & ~F.array_contains("flips", -F.col("place")))
            .groupBy(*keys)
            .agg(F.min(F.struct(F.abs(after).alias("gap"), "place", "way", after.alias("after"))).alias("best"))
        )
        flipped = F.col("best").isNotNull()
        state = materialize(
            state.join(best, keys, "left").select(*keys, F.when(flipped, F.col("best.after")).otherwise(F.col("off")).alias("off"), F.when(flipped, F.array_append("flips", F.col("best.place") * F.col("best.way"))).otherwise(F.col("flips")).alias("flips")),
            "flips",
        )
    changed = state.select(*keys, F.explode("flips").alias("flip")).select(*keys, F.abs("flip").alias("place"), F.signum("flip").cast("bigint").alias("way"))
    out = rounded.join(changed, [*keys, "place"], "left").withColumn("copies", (held + F.coalesce("way", F.lit(0))).cast("bigint"))
    return out.select("doc_id", "source", F.col("size").cast("bigint"), F.col("tokens").cast("bigint").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy balancing of all documents to 150 % of their words, sources weighing 5, 2, 1 in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return entropy_balance(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP8_ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS grp, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS no_grp,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (((coalesce(doc_id, -1) % 2147483647 + 2147483647) % 2147483647) * 48271) % 2147483647 AS h
  FROM documents),
g AS (SELECT grp, no_grp, sum(size)::DOUBLE AS tokens, count(*) AS docs FROM base GROUP BY ALL),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY no_grp, grp) - 1) % 3] AS weight, 2 * tokens AS lim FROM g),
l AS (SELECT *, lim / weight AS level_at,
  (1.5 * sum(tokens) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, no_grp, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, no_grp, grp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lv AS (SELECT coalesce(arg_min(level, level_at), 0) AS level FROM l WHERE level <= level_at * (1 + 1e-12)),
t AS (SELECT grp, no_grp, tokens, docs, round(least(lim, lv.level * weight), 6) AS target FROM l, lv),
hist AS MATERIALIZED (SELECT grp, no_grp, size, size * docs / tokens AS x, count(*) AS n FROM base JOIN t USING (grp, no_grp) WHERE tokens > 0 GROUP BY ALL),
-- bisection: halving the bracket of every group as often as its numbers have bits
bi AS (SELECT grp, no_grp, -64.0::DOUBLE * (1 + (SELECT max(docs) FROM t)) AS lo, 64.0::DOUBLE * (1 + (SELECT max(tokens) FROM t)) AS hi, 0 AS k FROM t WHERE tokens > 0 AND target < 2 * tokens * (1 - 1e-12)
  UNION ALL
  SELECT grp, no_grp, CASE WHEN g < target THEN mid ELSE lo END, CASE WHEN g < target THEN hi ELSE mid END, k + 1
  FROM (SELECT grp, no_grp, k, lo, hi, (lo + hi) / 2 AS mid, target,
               (SELECT sum(n * size * least(2.0::DOUBLE, exp(least((lo + hi) / 2 * x, 50.0)))) FROM hist WHERE hist.grp = bi.grp AND hist.no_grp = bi.no_grp) AS g
        FROM bi JOIN t USING (grp, no_grp) WHERE k < 120)),
r AS (SELECT t.*, round((lo + hi) / 2, 9) AS lam, greatest(1, ceil(docs / 512.0))::BIGINT AS cells FROM t LEFT JOIN (SELECT * FROM bi WHERE k = 120) USING (grp, no_grp)),
c AS (SELECT b.*, r.tokens, r.target, (h + size * 7919) % cells AS cell,
             CASE WHEN tokens = 0 THEN 1000000 WHEN lam IS NULL THEN 2000000 ELSE round(1000000 * least(2.0::DOUBLE, exp(least(lam * (size * docs / tokens), 50.0)))) END::BIGINT AS units FROM base b JOIN r USING (grp, no_grp)),
p AS (SELECT *, units // 1000000 AS whole, row_number() OVER w AS place, (sum(units % 1000000) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS sum_to FROM c WINDOW w AS (PARTITION BY grp, no_grp ORDER BY cell, size, h, doc_id)),
x AS (SELECT *, sum_to // 1000000 - (sum_to - units % 1000000) // 1000000 AS extra FROM p),
o AS (SELECT grp, no_grp, round(max(target) - sum(size * (whole + extra)), 6) AS gap, []::BIGINT[] AS flips FROM x GROUP BY ALL),
y AS (SELECT grp, no_grp, place, way, way * size AS d FROM x, (VALUES (-1), (1)) AS v(way) WHERE size > 0 AND whole + extra + way BETWEEN 0 AND 2),
@ROUNDS@
b AS (SELECT grp, no_grp, abs(f) AS place, sign(f) AS way FROM (SELECT grp, no_grp, unnest(flips) AS f FROM s3))
SELECT doc_id, size, tokens::BIGINT AS source_size, target, (whole + extra + coalesce(way, 0))::BIGINT AS copies, (size * (whole + extra + coalesce(way, 0)))::BIGINT AS taken
FROM x LEFT JOIN b USING (grp, no_grp, place)
"""
OP8_ORACLE = OP8_ORACLE.replace(
    "@ROUNDS@",
    "\n".join(
        f"""b{i} AS (SELECT grp, no_grp, place * way AS flip, round(gap - d, 6) AS after FROM y JOIN {was} USING (grp, no_grp) WHERE abs(round(gap - d, 6)) < abs(gap) AND NOT list_contains(flips, place) AND NOT list_contains(flips, -place)
 QUALIFY row_number() OVER (PARTITION BY grp, no_grp ORDER BY abs(round(gap - d, 6)), place, way) = 1),
s{i} AS (SELECT grp, no_grp, coalesce(after, gap) AS gap, CASE WHEN flip IS NULL THEN flips ELSE list_append(flips, flip) END AS flips FROM {was} LEFT JOIN b{i} USING (grp, no_grp)),"""
        for i, was in ((1, "o"), (2, "s1"), (3, "s2"))
    ),
)
