import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inferweave.llm import mixing as X
from inferweave.llm import sharding as H


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_targets_rounding_and_reruns(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", "c", "d", None]), int(r.lognormvariate(5, 1))) for i in range(4000)]
    first, again = X.entropy_balance(table(spark, rows)).collect(), X.entropy_balance(table(spark, rows)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == len(rows)
    total, taken, target = sum(x[2] for x in rows), collections.Counter(), {}
    for x in first:
        assert 0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
        target[x.source] = (x.target, x.source_size)
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1
    for s, (t, size) in target.items():
        assert t <= 2 * size + 1e-6 and abs(taken[s] - t) <= 0.002 * t + 1


def test_few_empty_and_none(spark):
    got = X.entropy_balance(table(spark, [(1, "a", 0), (2, None, 0), (None, "a", 10), (3, "b", 10), (3, "b", 10)])).collect()
    assert len(got) == 5 and all(x.taken <= 2 * x.size for x in got)
    assert all(x.taken == 0 for x in X.entropy_balance(table(spark, [(1, "a", 0)])).collect())
    assert X.entropy_balance(table(spark, [])).count() == 0


def test_tilted_rates_meet_the_constraint(spark):
    sizes = spark.createDataFrame([("a", 0, s, 10) for s in range(1, 50)], "grp string, no_grp int, size long, n long")
    for share in (0.3, 1.4):
        total = 10 * sum(range(1, 50))
        targets = spark.createDataFrame([("a", 0, float(total), 490, share * total)], "grp string, no_grp int, tokens double, docs long, target double")
        for cap in (50.0, 1.5):
            lam = X.newton_multipliers(sizes, targets, cap=cap).first().lam
            got = sum(10 * s * min(cap, math.exp(lam * s / 25)) for s in range(1, 50))
            assert got == pytest.approx(share * total, rel=1e-10)


def test_rates_depend_on_the_document(spark):
    """Entropy balancing by its definition: of all rates that meet the constraint, these are nearest to one copy each."""
    sizes = [5, 9, 40, 40, 300, 700]
    rows = [(i, s, n) for s, docs in (("a", sizes), ("b", sizes), ("c", sizes)) for i, n in enumerate(docs)]
    got = X.entropy_balance(table(spark, [(i + 10 * "abc".index(s), s, n) for i, s, n in rows])).collect()
    for source in "abc":
        rates = {x.size: x.rate for x in got if x.source == source}
        target = next(x.target for x in got if x.source == source)
        if target < 2 * sum(sizes):
            assert abs(sum(rates[n] * n for n in sizes) - target) < 0.01 and len(set(rates.values())) > 3
            inner = [n for n in sizes if rates[n] < 2]
            lam = math.log(rates[inner[0]]) / inner[0]
            assert all(math.log(rates[n]) / n == pytest.approx(lam, rel=1e-2) for n in inner)  # one tilt for all
    assert {x.rate for x in got if x.target >= 2 * sum(sizes) - 1e-6} <= {2.0}


def test_multipliers_at_the_edges(spark):
    sizes = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 20_000, 1), ("b", 0, 7, 3), ("c", 0, 0, 4)], "grp string, no_grp int, size long, n long")
    targets = [("a", 0, 20_005.0, 6, 20_008.0), ("b", 0, 21.0, 3, 42.0), ("c", 0, 0.0, 4, 0.0)]
    found = {r.grp: r.lam for r in X.newton_multipliers(sizes, spark.createDataFrame(targets, "grp string, no_grp int, tokens double, docs long, target double")).collect()}
    x = lambda s: s * 6 / 20_005
    assert sum(n * s * min(2, math.exp(min(50, found["a"] * x(s)))) for s, n in ((1, 5), (20_000, 1))) == pytest.approx(20_008, rel=1e-10)
    assert found["b"] is None and found["c"] == 0


def test_word_rule(spark):
    df = spark.createDataFrame([("a b c\x1cd\ve",), (None,), ("",), (" \t",)], "t string")
    assert [r[0] for r in df.select(X.word_count(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_matrix_sums_and_law():
    counts = [5, 0, 17, 3, 100, 1]
    m = H.communication_matrix(counts, 4, 1)
    assert [sum(r) for r in m] == counts and sorted(map(sum, zip(*m, strict=True))) == [31, 31, 32, 32]
    r = random.Random(3)
    draws = [H.hypergeometric(r, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.1 and 2.9 < sum((d - 6) ** 2 for d in draws) / 4000 < 3.9
    assert H.hypergeometric(r, 5, 0, 3) == 3 and H.hypergeometric(r, 0, 5, 3) == 0
    assert 0 < H.hypergeometric(r, 10**12, 10**12, 10**6) < 10**6


def test_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(H, "ROWS_A_BLOCK", 16)
    rows = spark.createDataFrame([(i if i % 50 else None, i % 7) for i in range(1000)] + [(1, 1)] * 5, "doc_id long, text_crc32 long")
    a, b = (sorted(map(tuple, H.shuffle_into_shards(rows.withColumn("slot", F.lit(1)), ["doc_id", "text_crc32"]).select("doc_id", "text_crc32", "shard", "slot").collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == 1005
    by = collections.defaultdict(list)
    for _, _, shard, slot in a:
        by[shard].append(slot)
    assert sorted(by) == list(range(16)) and {len(v) for v in by.values()} == {62, 63} and all(sorted(v) == list(range(len(v))) for v in by.values())
    order = [x[0] or 0 for x in sorted(a, key=lambda x: (x[2], x[3]))]
    up = sum(p < q for p, q in zip(order, order[1:], strict=False))
    assert 430 < up < 570  # no trace of the input's order
    assert H.shuffle_into_shards(rows.where("false"), ["doc_id", "text_crc32"]).count() == 0


def test_shard_query(spark, documents, tmp_path):
    documents([(1, "é"), (2, None), (3, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in H.op10_sharding(spark, str(tmp_path)).collect()}
    assert (got[1].size, got[1].text_crc32) == (3, zlib.crc32("é".encode())) and (got[2].size, got[2].text_crc32) == (1, 0) and got[3].law == "rows"
