"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go; each line stays at its earliest place; one document of each group of near duplicates stays; the
rest is mixed to target weights, which repeats documents and leaves some out; what the mix holds is tokenized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.llm.common import materialize, table
from inferweave.llm.line_dedup import dedup_lines
from inferweave.llm.mixing import entropy_balance, word_count
from inferweave.llm.near_dedup import BROADCAST_IDS, near_duplicates
from inferweave.llm.sentencepiece_bpe import encode_documents, public_model
from inferweave.llm.toxicity import fit_and_score


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns own and _rest, which holds the others, whatever their names."""
    rest = [F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in own]]
    return docs.select(*own, F.struct(*rest).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c) if c in own else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of less than 0.5. The scorer is fitted on the documents at hand that have labels.

    Null and empty texts stay. An empty table gives an empty table; so in all stages.
    """
    scored = fit_and_score(packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id", "text", "_rest"])
    return unpacked(scored.where("score < 0.5"), docs, "doc_id", "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line at its earliest place only. One that had lines and has none left goes: earlier ones have all of it."""
    out = dedup_lines(packed(docs, "doc_id", "text")).where("n_lines = 0 OR n_kept > 0")
    out = unpacked(out, docs, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component. Which go is written before the texts are filtered."""
    gone = materialize(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies: 0 to 2. Rows that agree in id, source and size share their number."""
    sized = packed(docs, "doc_id", "text", "source").withColumn("_size", word_count(F.col("text")))
    mixed = entropy_balance(sized.select("doc_id", "source", F.col("_size").alias("size")))
    copies = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_n")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_n"))
    rows = sized.join(materialize(copies, "copies"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
    return unpacked(rows, docs, "doc_id", "text", "source")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each row of the mix."""
    return encode_documents(docs, public_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Toxicity, near duplicates and tokens can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
