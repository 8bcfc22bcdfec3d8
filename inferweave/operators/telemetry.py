"""Query telemetry over event tables: hot keys, unresolved claims, latency, rates, idle gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hot_keys(events: DataFrame, key: str, n: int = 10) -> DataFrame:
    return events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "key").limit(n)


def unresolved_claims(events: DataFrame, n: int = 10) -> DataFrame:
    """claim, hits, verdict (of the first) of events (claim, verdict, ts) without support."""
    open_ = events.where(F.col("verdict").isin("unsupported", "contradicted"))
    return open_.groupBy(F.lower("claim").alias("claim")).agg(F.count("*").alias("hits"), F.min_by("verdict", "ts").alias("verdict")).orderBy(F.desc("hits"), "claim").limit(n)


def latency_quantile(events: DataFrame, by: list[str], value: str, q: float = 0.95) -> DataFrame:
    """The nearest-rank quantile."""
    return events.groupBy(*by).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("latency"), F.count("*").alias("n"))


def rate_windows(events: DataFrame, ts: str = "ts", width: str = "60 seconds", seconds: int = 60) -> DataFrame:
    """window_start, n, qps."""
    w = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "n", F.round(F.col("n") / seconds, 6).alias("qps"))


def idle_gaps(events: DataFrame, key: str, gap_seconds: int, ts: str = "ts") -> DataFrame:
    """Sessions of a key: runs of events less than gap_seconds apart."""
    order = Window.partitionBy(key).orderBy(ts)
    at = micros(ts)
    new = (at - F.lag(at).over(order) > gap_seconds * 1_000_000).cast("int")
    marked = events.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def counters(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def cache_ratio(events: DataFrame) -> DataFrame:
    """hits / (hits + misses + shared) over cache_status."""
    hit, all_ = F.count_if(F.col("cache_status") == "hit"), F.count_if(F.col("cache_status").isin("hit", "miss", "singleflight"))
    return events.agg(hit.alias("hits"), all_.alias("lookups"), F.try_divide(hit, all_).alias("ratio"))


def ewma_rate(events: DataFrame, ts: str = "ts", window_seconds: float = 10.0) -> DataFrame:
    """bucket, ewma: the decayed rate after the last event of each day, q * exp(-dt / w) + 1 / w; each day by itself.

    In closed form, the sum of exp(-(end - t) / w) / w: two aggregations, however many events a day has.
    """
    at = events.select(F.date_trunc("day", ts).alias("bucket"), (micros(ts) / 1e6).alias("t")).where("t IS NOT NULL")
    ends = at.groupBy("bucket").agg(F.max("t").alias("end"))
    w = F.lit(float(window_seconds))
    return at.join(ends, "bucket").groupBy("bucket").agg(F.round(F.sum(F.exp((F.col("t") - F.col("end")) / w) / w), 6).alias("ewma"))


def scope_scores(events: DataFrame, slow: float) -> DataFrame:
    """scope, score: weighted counts of queries, slow ones, errors and unsupported answers per scope."""
    return events.groupBy("scope").agg((F.count("*") + 2 * F.count_if(F.col("latency") > slow) + 3 * F.count_if(F.col("verdict") == "error") + F.count_if(F.col("verdict") == "unsupported")).alias("score"))
