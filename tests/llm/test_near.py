import collections
import random

import numpy as np

from inferweave.llm import near_dedup as N


def brute(rows):
    """component of each doc_id, from full sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "É a b c d e"), (7, "é a b c d e")]
    base = [word() for _ in range(160)]
    for i in range(70):  # copies of one text with more and more edits: some are linked only through others
        text = list(base)
        for _ in range(r.randint(0, 9)):
            text[r.randrange(len(text))] = word()
        rows.append((10 + i, " ".join(text)))
    chain = [word() for _ in range(60)]
    for i in range(12):  # a chain: each is near the next
        rows.append((200 + i, " ".join(chain)))
        chain = chain[4:] + [word() for _ in range(4)]
    rows += [(300 + i, " ".join(word() for _ in range(r.randint(1, 50)))) for i in range(60)]
    return rows


def test_components_are_those_of_brute_force(documents):
    rows = corpus()
    got = {r.doc_id: r for r in N.near_duplicates(documents(rows, "kept", "rep")).collect()}
    wanted = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len(collections.Counter(c for _, c in wanted.values())) < len(rows) - 40  # the corpus has links


def test_null_ids_repeats_and_none(documents):
    text = "a b c d e f g h"
    got = N.near_duplicates(documents([(None, text), (None, None), (5, text), (5, text), (9, text)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("None", "None", True), ("None", "None", True), ("5", "5", True), ("5", "5", True), ("9", "5", False)])
    assert N.near_duplicates(documents([])).count() == 0


def test_sketches_estimate_and_fill():
    r = np.random.default_rng(1)
    for size in (1, 2, 7, 50, 3000):
        common, a, b = (np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (3 * size, size, size))
        x, y = np.union1d(common, a), np.union1d(common, b)
        s = N.sketches([x, y], 1024)
        assert (s != np.iinfo(np.uint64).max).all()
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s[0] == s[1]).mean() - truth) < 0.08
    assert (N.sketches([x]) == N.sketches([y, x])[1]).all()


def test_big_bucket_is_compared_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_texts_that_share_an_id_are_one_node(documents):
    b, c, d = "b1 b2 b3 b4 b5 b6 b7", "c1 c2 c3 c4 c5 c6 c7", "d1 d2 d3 d4 d5 d6"
    rows = [(1, b), (7, b), (7, c), (9, c), (9, None), (4, d), (5, d), (5, "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(documents(rows)).collect())
    assert got == [(1, 3, 1, True), (4, 2, 4, True), (5, 0, 4, False), (5, 2, 4, False), (7, 3, 1, False), (7, 3, 1, False), (9, 0, 1, False), (9, 3, 1, False)]


def test_recall_of_pairs_at_the_bound(documents):
    """Pairs of documents at 0.75 and just above: all are found, and none just below."""
    r = random.Random(9)
    rows, near = [], 0
    for pair in range(150):
        words = [f"w{pair}x{r.randint(0, 10**9)}" for _ in range(200)]
        k = r.randint(26, 31)  # a changed tail of k words leaves (196 - k) / (196 + k)
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[: 200 - k] + [f"t{i}" + w for i, w in enumerate(words[200 - k :])]))]
        near += 100 * (196 - k) >= 75 * (196 + k)
    got = {x.doc_id: x.component_id for x in N.near_duplicates(documents(rows)).collect()}
    assert sum(got[2 * p + 1] == 2 * p for p in range(150)) == near and 0 < near < 150
    assert got == {i: c for i, (_, c) in brute(rows).items()}
