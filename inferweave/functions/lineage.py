"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; only where that is unset (local tests) in a temporary one."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="inferweave-"))
    return sc._jsc.sc().getCheckpointDir().get()
