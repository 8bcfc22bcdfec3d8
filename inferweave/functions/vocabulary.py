"""The shipped vocabulary: predicates, compositions, aliases and disjoint pairs of two packs (fixed values)."""

from __future__ import annotations

# name: (inverse, super-properties, characteristics)
# T transitive, S symmetric, R reflexive, A asymmetric
GENERAL = {
    "is_a": ("subsumes", [], "T"),
    "subsumes": ("is_a", [], "T"),
    "instance_of": ("has_instance", ["related_to"], ""),
    "has_instance": ("instance_of", [], ""),
    "part_of": ("has_part", [], "T"),
    "has_part": ("part_of", [], "T"),
    "located_in": ("location_of", [], "T"),
    "location_of": ("located_in", [], "T"),
    "precedes": ("follows", [], "TA"),
    "follows": ("precedes", [], "TA"),
    "same_as": (None, [], "STR"),
    "equivalent_to": (None, [], "STR"),
    "related_to": (None, [], "S"),
    "associated_with": (None, ["related_to"], "S"),
    "depends_on": (None, ["related_to"], "T"),
}
GENERAL_COMPOSITIONS = [("instance_of", "is_a", "instance_of"), ("located_in", "part_of", "located_in"), ("same_as", "is_a", "is_a")]
GENERAL_ALIASES = {
    "is a": "is_a",
    "isa": "is_a",
    "subclass of": "is_a",
    "subclass_of": "is_a",
    "subClassOf": "is_a",
    "is a kind of": "is_a",
    "type of": "is_a",
    "subtype of": "is_a",
    "instance of": "instance_of",
    "part of": "part_of",
    "located in": "located_in",
    "precedes": "precedes",
    "same as": "same_as",
    "equivalent to": "equivalent_to",
    "related to": "related_to",
    "associated with": "associated_with",
    "depends on": "depends_on",
}

MEDICAL = {
    "symptom_of": ("has_symptom", ["associated_with"], ""),
    "has_symptom": ("symptom_of", ["associated_with"], ""),
    "has_phenotype": ("phenotype_of", ["has_symptom"], ""),
    "phenotype_of": ("has_phenotype", ["symptom_of"], ""),
    "sign_of": ("has_sign", ["symptom_of"], ""),
    "has_sign": ("sign_of", ["has_symptom"], ""),
    "manifests_as": ("manifestation_of", ["has_symptom"], ""),
    "manifestation_of": ("manifests_as", ["symptom_of"], ""),
    "causes": ("caused_by", ["associated_with"], ""),
    "caused_by": ("causes", ["associated_with"], ""),
    "risk_factor_for": ("has_risk_factor", ["associated_with"], ""),
    "has_risk_factor": ("risk_factor_for", ["associated_with"], ""),
    "complication_of": ("has_complication", ["associated_with"], ""),
    "has_complication": ("complication_of", ["associated_with"], ""),
    "co_occurs_with": (None, ["associated_with"], "S"),
    "correlated_with": (None, ["associated_with"], "S"),
    "differential_of": (None, ["associated_with"], "S"),
    "treats": ("treated_by", [], ""),
    "treated_by": ("treats", [], ""),
    "prevents": ("prevented_by", ["associated_with"], ""),
    "prevented_by": ("prevents", ["associated_with"], ""),
    "contraindicated_for": ("has_contraindication", [], ""),
    "has_contraindication": ("contraindicated_for", [], ""),
    "interacts_with": (None, [], "SR"),
    "inhibits": ("inhibited_by", [], "R"),
    "inhibited_by": ("inhibits", [], ""),
    "activates": ("activated_by", [], "R"),
    "activated_by": ("activates", [], ""),
    "diagnosed_by": ("diagnoses", [], ""),
    "diagnoses": ("diagnosed_by", [], ""),
}
MEDICAL_COMPOSITIONS = [("is_a", x, x) for x in ("has_symptom", "has_phenotype", "has_sign", "has_risk_factor", "has_complication", "treated_by")] + [("part_of", "has_symptom", "has_symptom")]
MEDICAL_DISJOINT = [("treats", "contraindicated_for"), ("prevents", "causes")]
MEDICAL_ALIASES = {
    "is a symptom of": "symptom_of",
    "symptom of": "symptom_of",
    "is a sign of": "sign_of",
    "sign of": "sign_of",
    "has symptom": "has_symptom",
    "has phenotype": "has_phenotype",
    "phenotype of": "phenotype_of",
    "presents with": "has_symptom",
    "is a presenting feature of": "symptom_of",
    "manifests as": "manifests_as",
    "causes": "causes",
    "cause": "causes",
    "can cause": "causes",
    "may cause": "causes",
    "caused by": "caused_by",
    "results in": "causes",
    "leads to": "causes",
    "risk factor for": "risk_factor_for",
    "is a risk factor for": "risk_factor_for",
    "complication of": "complication_of",
    "is associated with": "associated_with",
    "associate": "associated_with",
    "correlated with": "correlated_with",
    "positive_correlate": "correlated_with",
    "co-occurs with": "co_occurs_with",
    "treats": "treats",
    "treated by": "treated_by",
    "treated with": "treated_by",
    "used to treat": "treats",
    "indicated for": "treats",
    "contraindicated for": "contraindicated_for",
    "interacts with": "interacts_with",
    "interacts": "interacts_with",
    "interact": "interacts_with",
    "inhibits": "inhibits",
    "inhibit": "inhibits",
    "inhibited by": "inhibited_by",
    "activates": "activates",
    "activate": "activates",
    "activated by": "activated_by",
    "diagnosed by": "diagnosed_by",
    "diagnoses": "diagnoses",
}
