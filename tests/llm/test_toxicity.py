import random

import numpy as np
import pytest

from inferweave.llm import toxicity as X

WORDS = "the river runs over stones and the town sleeps while birds sing in tall trees near old walls with moss".split()


def labelled(documents, spark, n=400, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 3)):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "moron", "pathetic"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model():
    text = " ".join(WORDS * 50 + ["idiot", "moron", "pathetic", "stupid"] * 5)
    return X.log_model(X.class_trigrams([text]))


@pytest.mark.parametrize("seen,meant", [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("id!0t", "idiot"), ("idiooooot", "idiot"), ("p4thet1c", "pathetic"), ("st*pid", "stupid"), ("i.d.i.o.t", "idiot"), ("$tupid", "stupid"), ("id|ot", "idiot"), ("1d1000t", "idiot"), ("iidiioott", "idiot"), ("m00r0nn", "moron")])
def test_deobfuscation(model, seen, meant):
    assert meant in X.Restorer(model).words(seen)


def test_spaced_and_untouched(model):
    r = X.Restorer(model)
    assert list(r.spaced("you i d i o t there")) == ["idiot"] and r.restore("you i d i o t") == "you idiot"
    # spacing, look-alikes and repetition at once
    for seen, meant in (("1 d 1 0 t", "idiot"), ("m 0 r 0 n", "moron"), ("ii d ii o tt.", "idiot."), ("1.d.1.000.t", "idiot"), ("i*d*i*0*t", "idiot"), ("s + u p 1 d!", "stupid!"), ("1 2 3 4", "1 2 3 4")):
        assert r.restore(seen) == meant
    for token in ("river", "THE!!", "stones***", "a$$$", "é", "tall", "trees"):
        assert len(r.words(token)) == 1


def test_viterbi_finds_the_best_path(model):
    import itertools

    for arcs in (X.lattice("1d10t"), X.lattice("iid||ot"), X.spaced_lattice(["1", "d", "11", "o", "t"])):
        best_path(model, arcs, itertools)


def best_path(model, arcs, itertools):
    score = lambda s: sum(float(model[a, b, c]) for a, b, c in zip([0, 0, *map(X.char_class, s)], [0, *map(X.char_class, s), 0], [*map(X.char_class, s), 0], strict=False))
    paths = [("".join(t for t, _ in p), sum(c for _, c in p)) for p in itertools.product(*arcs)]
    assert X.decode(arcs, model) == max(paths, key=lambda p: p[1] + score(p[0]))[0].strip()


def test_held_out_accuracy_and_odd_rows(documents, spark):
    rows, labels = labelled(documents, spark)
    truth = dict(map(tuple, labels.collect()))
    extra = [(1000, None), (1001, ""), (None, "the river"), (1002, "the river 1d10t runs m0r0n idi0t"), (1002, "the river 1d10t runs m0r0n idi0t")]
    got = X.scored(documents(rows + extra, "score", "predicted"), labels).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and all(r.predicted == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1 and not by[None].held_out


def test_nothing_to_learn(documents, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in X.scored(documents([(1, "idiot"), (2, None)]), none).collect()] == [0, 0]
    assert X.scored(documents([]), none).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert X.scored(documents([(1, "idiot")]), nulls).count() == 1


def test_lexicon_counts_all_labelled_documents(documents, spark, monkeypatch):
    rows, labels = labelled(documents, spark)
    rows = [(i, f"{t} {'rareinsult' if y else 'calm'} {i}") for (i, t), (_, y) in zip(rows, map(tuple, labels.collect()), strict=True)]
    docs = documents(rows)
    whole = X.fit(docs, labels)
    monkeypatch.setattr(X, "MAX_LABELLED", 40)
    part = X.fit(docs, labels)
    assert "=rareinsult" in part.lexicon and part.lexicon == whole.lexicon
    monkeypatch.setattr(X, "BROADCAST_IDS", 10)
    assert X.fit(docs, labels).lexicon == whole.lexicon


def test_trigrams_are_of_characters():
    counts = X.class_trigrams(["Éa ж", "b"]).reshape(X.A, X.A, X.A)
    e, other = X.char_class("é"), X.char_class("ж")
    assert e != X.char_class("è") and other == X.A - 1
    assert counts[0, 0, e] == counts[0, e, 1] == counts[e, 1, 0] == counts[1, 0, other] == counts[0, 0, 2] == 1
    assert counts.sum() == len("  Éa ж  b  ") - 2


def test_labels_of_one_kind_and_clashing_labels(documents, spark):
    docs = documents([(i, f"word{i} and more") for i in range(30)])
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(30)], "doc_id long, toxic int")
        assert {r.predicted for r in X.scored(docs, labels).collect()} == {kind}
    rows, labels = labelled(documents, spark)
    twice = labels.union(spark.createDataFrame([(i, 0) for i, _ in rows], labels.schema))  # toxic if one label says so
    assert X.fit(documents(rows), twice).lexicon == X.fit(documents(rows), labels).lexicon


def test_scores_against_their_definition(documents, spark):
    rows, labels = labelled(documents, spark, 120, 5)
    rows += [(500, "you 1 d 1 0 t and m0ron"), (501, "idiot " * 40)]
    fitted = X.fit(documents(rows), labels)
    got = {r.doc_id: r.score for r in fitted.score(documents(rows), ["doc_id"]).collect()}
    restorer = X.Restorer(fitted.model)
    weight = lambda w: max([fitted.lexicon.get("=" + w, 0.0), *(fitted.lexicon.get("^" + w[:n], 0.0) for n in X.PREFIXES if len(w) >= n)])
    for i, t in rows:
        tokens = t.split()
        hits = [max([0.0, *map(weight, restorer.words(w))]) for w in tokens] + [weight(w) for w in restorer.spaced(t)]
        hits = [h for h in hits if h]
        n = len(hits)
        x = [1, np.log1p(n), sum(hits) / n if n else 0, max(hits, default=0), np.log1p(100 * n / len(tokens)), np.log1p(sum(h >= X.STRONG for h in hits))]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(np.dot(fitted.weights, x), -30, 30)))) < 1e-9


def test_logistic_fit_is_at_the_minimum():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    y = (r.random(300) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -2])))).astype(float)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (w[0] + x @ w[1:])).sum() + 0.5e-4 * len(y) * (w[1:] ** 2).sum()
    w = X.fit_logistic(x, y)
    assert all(loss(w) <= loss(w + d) for d in np.eye(3) * 1e-3) and all(loss(w) <= loss(w - d) for d in np.eye(3) * 1e-3)


def test_doubled_letters_are_decided_as_by_viterbi(model):
    r, random_ = X.Restorer(model), random.Random(8)
    changed = 0
    for _ in range(500):
        word = "".join(random_.choice("aeinorstdmél") * random_.choice([1, 1, 2]) for _ in range(random_.randint(1, 9)))
        if not X.RUN.search(word):
            assert r.undoubled(word) == X.decode(X.lattice(word), model)
            changed += r.undoubled(word) != word
    assert changed > 20


def test_every_spaced_word_is_looked_for():
    random_ = random.Random(4)
    for _ in range(3000):
        text = "".join(random_.choice(["a", "b", "1", " ", " ", ".", "*", "x y", "!", "cd"]) for _ in range(random_.randint(4, 14)))
        assert not X.SPACED.search(text) or X.SPACED_END.search(text)


def test_fit_and_score_is_fit_then_score(documents, spark, monkeypatch):
    rows, labels = labelled(documents, spark, 150, 9)
    docs = documents([*rows, (900, None), (None, "the idiot"), (3, "a second row")])
    key = lambda r: (str(r.doc_id), round(r.score, 9))
    for most in (X.MAX_LABELLED, 60):
        monkeypatch.setattr(X, "MAX_LABELLED", most)
        once, twice = X.fit_and_score(docs, labels, ["doc_id"]), X.fit(docs, labels).score(docs, ["doc_id"])
        assert once.columns == twice.columns == ["doc_id", "score"]
        assert sorted(map(key, once.collect())) == sorted(map(key, twice.collect()))
    assert X.free_name(["doc_id", "_Evidence"]) == "_evidence_"


def test_tokens_known_to_weigh_nothing(model, monkeypatch):
    random_ = random.Random(6)
    token = lambda: "".join(random_.choice("abcéñÉAσΣİß") * random_.choice([1, 1, 1, 2, 3]) for _ in range(random_.randint(1, 6)))
    lexicon = {"=ab": 2.0, "=aabba": 3.0, "^abba": 4.0, "=cé": 5.0, "^bcbc": 1.5, "=bcab": 6.0}
    monkeypatch.setattr(X, "MEMO", 400)
    s, known = X.Scorer(model, lexicon), 0
    for _ in range(6000):
        t = token() + random_.choice(["", "", ".", "!", "!!", "?!", ",", "1", "'"])
        slow = max([0.0, *map(s.weight, s.restorer.words(t))])
        assert s[t] == slow and (not s.weightless(t) or slow == 0)
        known += s.weightless(t)
    assert known > 300 and len(s) <= 200
