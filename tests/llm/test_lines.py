import random

from inferweave.llm import line_dedup as L


def words(line):
    import re

    return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return p + q >= max(len(a), len(b)) - 1


def brute(rows):
    out, seen = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept, n = [], 0
        for line in t.split("\n"):
            w = words(line)
            if not w:
                kept.append(line)
                continue
            n += 1
            if not any(w == s or min(len(w), len(s)) >= L.MIN_WORDS and within_one(w, s) for s in seen):
                kept.append(line)
            seen.append(w)
        out[i] = ("\n".join(kept), n, sum(bool(words(x)) for x in kept))
    return out


def corpus():
    r = random.Random(2)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta".split())
    lines = [" ".join(word() for _ in range(r.randint(1, 14))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a\n\na\n  a \n")]
    for i in range(60):
        text = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(lines).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [word()] if r.random() < 0.7 else []
            text.append(" ".join(w) if w else "")
        rows.append((10 + i, "\n".join(text)))
    return rows


def test_against_brute_force(documents):
    rows = corpus()
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in L.dedup_lines(documents(rows, "keep", "w", "n_lines").drop("n_lines")).collect()}
    assert got == brute(rows)


def test_many_lines(documents, monkeypatch):
    monkeypatch.setattr(L, "FEW", 1)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    rows = corpus()
    assert {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in L.dedup_lines(documents(rows)).collect()} == brute(rows)


def test_ids_and_repeats(documents):
    got = L.dedup_lines(documents([(None, "x"), (None, "y"), (4, "x"), (4, "x"), (4, "z")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("4", "x"), ("4", "x"), ("4", "z"), ("None", ""), ("None", "y")]
    assert L.dedup_lines(documents([])).count() == 0


def test_names_that_clash(spark, documents):
    from pyspark.sql import functions as F

    rows = [(1, "x\ny"), (2, "y\nz"), (3, None)]
    docs = documents(rows).select("doc_id", "text", *[F.lit(c).alias(c) for c in ("_made", "made", "a.b", "keep", "rid", "doc_key", "KEEP2", "others", "N_lines", "lang")])
    got = {r["doc_id"]: r for r in L.dedup_lines(docs).collect()}
    assert {i: (r["text"], r["n_lines"], r["n_kept"]) for i, r in got.items()} == {1: ("x\ny", 2, 2), 2: ("z", 2, 1), 3: (None, 0, 0)}
    for r in got.values():
        assert all(r[c] == c for c in ("_made", "made", "a.b", "keep", "rid", "doc_key", "KEEP2", "others", "lang"))


def test_a_line_separator_is_a_word(documents):
    got = {r.doc_id: r for r in L.dedup_lines(documents([(1, "\u2028\na"), (2, "\u2028\n \nb")])).collect()}
    assert (got[1].text, got[1].n_lines, got[1].n_kept) == ("\u2028\na", 2, 2)
    assert (got[2].text, got[2].n_lines, got[2].n_kept) == (" \nb", 2, 1)
