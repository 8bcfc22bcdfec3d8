import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inferweave.functions import scalars as S
from inferweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    clean = lambda x: None if x is None or x != x else round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted(repr([clean(x) for x in r]) for r in table)


def compare(df, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    names = sorted(df.columns)
    got = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert rows(map(tuple, df.select(*names).collect())) == rows(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, DATA)
    if name in catalog.oracle_sql():
        compare(df, catalog.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_case_goes_by_letter(spark, tmp_path):
    """Words whose case Spark maps to other letters, or by what stands around them, and spaces other than the blank."""
    words = ["Straße", "ß", "ΟΔΟΣ", "οδος", "οδοσ", "İz", "ŉa", "ᾳ", "ﬁn", "ſo", "Ñez", "\u00a0a", "\u3000é\u3000", "a\t", "plain", ""]
    texts = [(3 * i + k, 1, a if k == 0 else f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in words for b in words) for k in (0, 1)]
    spark.createDataFrame([*texts, (3, 1, None), (None, None, "ß SS")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = catalog.queries()["tautology_filter"](spark, str(tmp_path)).select("p", "n")
    assert rows(map(tuple, got.collect())) == rows(con.execute(f"SELECT p, n FROM ({catalog.oracle_sql()['tautology_filter']})").fetchall())
    w, text = F.split("text", " "), F.col("text")
    each = spark.read.parquet(f"{tmp_path}/conversations.parquet").select("text", S.upper_by_letter(text), S.lower_by_letter(text), S.same_entity(F.get(w, 0), F.get(w, 1)))
    wanted = con.execute("SELECT text, upper(text), lower(text), lower(trim(string_split(text, ' ')[1])) = lower(trim(string_split(text, ' ')[2])) FROM conversations").fetchall()
    assert rows(map(tuple, each.collect())) == rows(wanted)
