import pytest


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, *more):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in more:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(f"extra {name}"))
        return df

    return make
