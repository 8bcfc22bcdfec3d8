import json

import pytest
from pyspark.sql import functions as F

from inferweave.functions.registry import Registry, general, inline, load_registry, medical


def test_packs():
    g, m = general(), medical()
    assert len(g.predicates) == 15 and len(m.predicates) == 45
    assert g.canonical(" Subclass of ") == "is_a" and g.canonical("nobody knows") == "nobody knows"
    assert m.inverse("treats") == "treated_by" and m.conflicting("contraindicated_for") == ["treats"]
    assert m.supers("has_phenotype") == ["has_phenotype", "has_symptom", "associated_with", "related_to"]
    assert "interacts_with" in m.reflexive() and "treats" not in m.reflexive()


def test_accepted():
    r = Registry({"has_symptom": ("symptom_of", [], ""), "symptom_of": ("has_symptom", [], ""), "has_phenotype": (None, ["has_symptom"], ""), "phenotype_of": (None, ["symptom_of"], "")})
    assert r.accepted("has_symptom") == ["has_phenotype", "has_symptom", "phenotype_of", "symptom_of"]


def test_cycle_of_super_properties():
    r = Registry({"p": (None, ["q"], ""), "q": (None, ["p"], ""), "r": (None, ["q"], "")})
    assert "p" in r.supers("r") and "r" not in r.supers("p")


CASES = [
    (["treats"], "treats"),
    (["is_a", "has_symptom"], "has_symptom"),
    (["is_a", "has_phenotype"], "has_phenotype"),
    (["is_a", "is_a", "is_a"], "is_a"),
    (["symptom_of", "causes"], None),
    (["is_a", "is_a", "has_symptom"], None),
    ([], None),
    (["is_a", "  "], None),
]


@pytest.mark.parametrize("preds,wanted", CASES)
def test_effective(preds, wanted):
    assert medical().effective(preds) == wanted


def test_effective_column_agrees(spark):
    rows = inline(spark, [{"p": p} for p, _ in CASES], "p array<string>")
    got = [r[0] for r in rows.select(medical().effective_column(F.col("p"))).collect()]
    assert got == [w for _, w in CASES]


def test_transitive_by_sub_properties(spark):
    r = general().extended({"specializes": (None, ["is_a"], ""), "narrows": (None, ["is_a"], "")})
    assert r.effective(["specializes", "narrows"]) == "is_a"
    row = inline(spark, [{"p": ["specializes", "narrows"]}], "p array<string>").select(r.effective_column(F.col("p")).alias("e")).first()
    assert row.e == "is_a"


def test_layers():
    with pytest.raises(ValueError):
        general().extended({"is_a": (None, [], "")}, override=False)
    with pytest.raises(ValueError):
        general().extended({"x": (None, ["nothing"], "")})
    with pytest.raises(ValueError):
        general().extended(aliases={"y": "nothing"})
    assert general().fingerprint() == general().fingerprint() != medical().fingerprint()


def test_registry_json():
    r = load_registry(json.dumps({"types": [{"name": "Drug", "supertypes": ["Thing"]}], "predicates": [{"canonical": "cures", "domain": ["Drug"], "range": ["Illness"], "characteristics": ["transitive"]}]}))
    assert r.has("cures", "T") and len(r.warnings) == 2
    assert r.check_types("cures", ["Drug"], []) == (True, "") and not r.check_types("cures", ["Place"], [])[0]
