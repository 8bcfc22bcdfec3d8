import corpus_pipeline as C
from inferweave.llm import queries as Q
from inferweave.llm.sentencepiece_bpe import load_model, public_model


def test_registered():
    names = sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(Q.oracle_sql()) <= set(names)
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "sentencepiece"]


def test_stages(spark, documents, tmp_path):
    words = "river stone town bird tree wall moss field road hill lake cloud".split()
    line = lambda i: " ".join(words[(i * k + k // 3) % 12] + str(i) for k in range(1, 12))
    rows = []
    for i in range(120):
        rows.append((i, line(i) + (" you idiot moron" if i % 4 == 0 else ""), "s" + str(i % 3)))
    rows += [(200, line(1), "s0"), (201, line(2) + "\nand a line of its own that stays", "s1"), (202, None, None), (203, "", "s2")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(rows, "_x", "copies", "score", "rid")
    columns = docs.columns
    kept = docs
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        before = kept.count()
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        path = str(tmp_path / f"stage{k}")
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if k == 0:
            assert ids == {i for i, _, _ in rows if i >= 200 or i % 4}
        if k == 1:
            assert 200 not in ids and {202, 203} <= ids
            assert kept.where("doc_id = 201").first().text == "and a line of its own that stays"
        if k == 2:
            assert kept.count() <= before
        if k == 3:
            assert max(r["count"] for r in kept.groupBy("doc_id").count().collect()) <= 2
    tokens = C.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    model = load_model(public_model())
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len(tokens) == kept.count() and all(r.n_tokens == len(model.library.encode(texts[r.doc_id] or "")) for r in tokens)
    assert len(C.run(spark, str(tmp_path)).collect()) == len(tokens)


def test_empty(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
