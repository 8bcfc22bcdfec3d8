"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"

ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset (local tests), a new temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        path = getattr(sc, "_inferweave_shared", None)
        if path is None:
            path = sc._inferweave_shared = "file://" + tempfile.mkdtemp(prefix="inferweave-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there lives as long as that folder: results are lazy and read it later."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends, and lost executors re-read files instead of redoing work."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def inline_table(spark: SparkSession, json_text: str, schema: str) -> DataFrame:
    """A small driver-side table as a literal of the plan: no Python runs on executors to make it."""
    rows = F.from_json(F.lit(json_text), f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.explode(rows).alias("r")).select("r.*")


def joined(rows: DataFrame, stats: DataFrame, on: list[str], spread: list[str], how: str, heavy: int) -> DataFrame:
    """rows joined with stats (unique in on, with a number rows): entries that at least heavy rows share are broadcast, the others shuffled.

    So no task gets more than heavy rows of one key. At most count of rows / heavy entries are broadcast: callers raise
    heavy with that count to keep it bounded. how: inner or left. spread: columns that deal the rows of broadcast
    entries out where a left join shuffles them too.
    """
    values = [c for c in stats.columns if c not in (*on, "rows")]
    few = stats.where(F.col("rows") >= heavy).select(*on, F.struct(*values).alias("_heavy"))
    rows = rows.join(F.broadcast(few), on, "left")
    light = stats.where(F.col("rows") < heavy).select(F.lit(0).cast("bigint").alias("_turn"), *on, F.struct(*values).alias("_light"))
    if how == "inner":
        hot = rows.where("_heavy IS NOT NULL").select(*[c for c in rows.columns if c != "_heavy"], "_heavy.*")
        cold = rows.where("_heavy IS NULL").drop("_heavy").join(light.drop("_turn"), on)
        return hot.unionByName(cold.select(*[c for c in rows.columns if c != "_heavy"], "_light.*"))
    # rows without a light entry are dealt out: by spread, apart from the keys of light entries
    rows = rows.withColumn("_turn", F.when(F.col("_heavy").isNotNull(), F.xxhash64(*spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint")))
    rows = rows.join(light, [*on, "_turn"], "left").withColumn("_stats", F.coalesce("_heavy", "_light"))
    return rows.select(*[c for c in rows.columns if c not in ("_heavy", "_light", "_turn", "_stats")], "_stats.*")


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes (null: of none)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def lehmer(doc_id: Column) -> Column:
    """Spreads ids over 0 to 2^31-2 by one multiplication modulo a prime; SQL engines can restate it exactly. Null: as id -1."""
    prime = F.lit(2147483647)
    return F.pmod(F.pmod(F.coalesce(doc_id.cast("bigint"), F.lit(-1)), prime) * F.lit(48271), prime)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
    release_memory()


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system; idle workers share their executor's memory with later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_SLOT: dict = {}


def worker_memo(key: Hashable, make: Callable):
    """What an operator remembers in this Python worker between tasks. There is one slot: another operator's key empties it,

    so that the stages of a pipeline, which share their workers, don't add up in memory.
    """
    if key not in _SLOT:
        _SLOT.clear()
        release_memory()
        _SLOT[key] = make()
    return _SLOT[key]


def local_path(uri: str) -> tuple:
    """A pyarrow file system and the path in it for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the session was started: sends it along once per Spark context.

    Also lowers the rows of an Arrow batch from Spark's default to ARROW_ROWS: whole texts are much longer than usual cells.
    """
    import zipfile

    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, "_inferweave_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="inferweave-"), "inferweave_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder in ("", "llm"):
            for name in sorted(os.listdir(os.path.join(top, folder))):
                if name.endswith(".py"):
                    z.write(os.path.join(top, folder, name), os.path.join("inferweave", folder, name))
    sc.addPyFile(path)
    sc._inferweave_shipped = True
