import hashlib
import random

import pytest

from inferweave.llm import sentencepiece_bpe as B

TEXTS = ["", None, " ", "  a  b ", "\n\t x", "▁▁a▁b", "a" * 300, "日本語 テスト 梦", "\x00a\x01 é̀ 👩‍👩‍👧", "<s> </s> <unk> <0x0A>", " " * 40 + "x" + " " * 17, "▁", "x" * 5000]


@pytest.fixture(scope="module")
def model():
    return B.load_model(B.public_model())


def test_against_the_library(model):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab t he▁ \n\té梦👍in er") for _ in range(r.randint(1, 60))) for _ in range(300)]
    for t, (n, ids, decoded) in zip(texts, B.WordEncoder(model).encode_batch(texts), strict=True):
        theirs = model.library.encode(t or "")
        assert model.encode(t or "") == theirs
        assert (n, ids, decoded) == (len(theirs), ",".join(map(str, theirs)), model.library.decode(theirs))


def test_both_agendas(model):
    r = random.Random(5)
    for _ in range(300):
        w = B.SPACE + "".join(r.choice("abcdefghinorstéñ日x") for _ in range(r.randint(0, 40)))
        assert model.merge_short(w) == model.ids_of(model.merge_long(w))


def test_decode_any_ids(model):
    r = random.Random(4)
    for _ in range(2000):
        ids = [r.choice([r.randint(0, 300), r.randint(3, 260), r.randint(259, 31999)]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == model.library.decode(ids)


def test_operator(spark, documents, model):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "  a  b ")]
    got = B.encode_documents(documents(rows, "ids_sha256"), B.public_model(), with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            ids = model.library.encode(TEXTS[r.doc_id] or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
    assert B.encode_documents(documents([]), B.public_model()).count() == 0
