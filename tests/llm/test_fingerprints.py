import hashlib
import random

from pyspark.sql import functions as F

from inferweave.llm import fingerprints as X


def edited(rows):
    rs = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**62)))
    cut = lambda t, b: t[: len(t) - len(t) // 3] + b[: len(t) // 3]
    return {rs[i][0]: cut(rs[i][1] or "", rs[(i + 1) % len(rs)][1] or "") for i in range(len(rs))}


def corpus():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefg hiäß👍\n") for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 5, 7, 8, 30, 36, 100, 143, 144, 150, 400, 2000]))) for i in range(120)]
    return rows + [(-1, None), (-2, ""), (-3, "x" * 500), (-4, "👍é" * 90), (None, "without an id")]


def test_edited_fingerprints_are_those_of_the_edited_texts(documents, monkeypatch):
    monkeypatch.setattr(X, "BUCKET", 10)
    rows = corpus()
    made = edited(rows)
    got = {r.doc_id: r for r in X.edited_fingerprints(documents(rows, "anchors", "bucket")).collect()}
    again = {r.doc_id: r for r in X.edited_fingerprints(documents(list(made.items()))).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.edited_sha256 == hashlib.sha256(made[i].encode()).hexdigest() and r.edited_fingerprint == again[i].fingerprint
        a, b = ({f[k : k + 8] for k in range(0, len(f), 8)} for f in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12


def test_syncmers_by_the_rule(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(600))
    df = spark.createDataFrame([(text,)], "t string")
    h = df.select(F.transform(F.sequence(F.lit(1), F.lit(len(text) - X.S + 1)), lambda i: F.xxhash64(F.substring(F.col("t"), i, F.lit(X.S))))).first()[0]
    wanted = [i for i in range(len(text) - X.K + 1) if min(h[i : i + X.W]) in (h[i], h[i + X.W - 1])]
    got = [a.p for a in df.select(X.anchors(F.col("t"))).first()[0]]
    assert got == wanted and max(b - a for a, b in zip(got, got[1:], strict=False)) <= X.W


def test_copies_alone_and_none(documents):
    text = "the same text in both " * 20
    got = {r.doc_id: r for r in X.edited_fingerprints(documents([(1, text), (2, text), (3, "another " * 40), (3, "third " * 40)])).collect() if r.doc_id < 3}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1
    one = X.edited_fingerprints(documents([(1, "abc")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert X.edited_fingerprints(documents([])).count() == 0


def test_native(documents):
    plan = X.edited_fingerprints(documents([(1, "a")]).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
