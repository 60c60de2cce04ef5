"""Known answers of alignment, detection, slots and matching."""

import random
import sys

import pytest
from pyspark import cloudpickle

from scribegauge.operators.lexicon import Automaton, Combined, Lexicon, Term
from scribegauge.operators.scoring import GermanCanonicalizer, Scorer, score_samples
from scribegauge.operators.slotscan import Slot
from scribegauge.plans.evaluation import score_sample
from scribegauge.sources import reports
from scribegauge.sources.datasets import from_records

pytestmark = pytest.mark.usefixtures("spark")
# Plug-ins of this module travel to the workers, which cannot import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEDS = [{"surface": d, "canonical": d, "type": "MEDICATION"} for d in ("metoprolol", "ramipril", "aspirin", "metamizol")]
CLINICAL = MEDS + [
    {"surface": s, "canonical": c, "type": t}
    for s, c, t in (
        ("thoraxschmerzen", "chest_pain", "SYMPTOM"), ("knie", "knee", "ANATOMY"), ("blutdruck", "blood_pressure", "CLINICAL_FINDING"),
        ("puls", "pulse", "CLINICAL_FINDING"), ("arterielle hypertonie", "hypertension", "DIAGNOSIS"),
        ("hypertonie", "hypertension", "DIAGNOSIS"), ("hypotonie", "hypotension", "DIAGNOSIS"),
    )
]


def entity(name, start, end, surface, canonical, kind="MEDICATION"):
    return {"id": name, "type": kind, "ref_start": start, "ref_end": end, "surface": surface, "canonical": canonical, "concept_id": None}


def slot(name, anchor, kind, start, end, surface, canonical):
    return {"id": name, "anchor_entity_id": anchor, "type": kind, "ref_start": start, "ref_end": end, "surface": surface, "canonical": canonical}


def drug(start, name, ident="e"):
    return entity(ident, start, start + 1, name, name)


def score(ref, hyp, entities=(), slots=(), terms=CLINICAL, **options):
    options.setdefault("recognizer", Lexicon(terms) if terms else None)
    return score_sample(ref, hyp, {"entities": list(entities), "critical_slots": list(slots)}, **options)


def score_all(spark, cases, terms=CLINICAL, **options):
    """Results of ``(reference, hypothesis, entities, slots)`` in order, or their faults, from one plan."""
    options.setdefault("recognizer", Lexicon(terms) if terms else None)
    samples = [
        {"sample_id": f"s{i}", "reference": ref, "hypothesis": hyp, "annotations": {"entities": list(entities), "critical_slots": list(slots)}}
        for i, (ref, hyp, entities, slots) in enumerate(cases)
    ]
    rows = [r.asDict(recursive=True) for r in score_samples(from_records(spark, samples), Scorer(**options)).orderBy("ordinal").collect()]
    return [r["error"] or reports.result_dict(r, r["per_type"]) for r in rows]


def triple(result, family):
    return tuple(result[f"{family}_{x}"] for x in ("tp", "fp", "fn"))


MG50 = slot("s", "e", "DOSE", 1, 3, "50 mg", {"value": 50, "unit": "mg"})


def test_medical_errors(spark):
    wanted = {
        "der patient nimmt metoprolol": (0, 0, 0), "die patient nimmt metoprolol": (0, 0, 0), "der patient nimmt metamizol": (1, 0, 0),
        "der patient nimmt": (0, 1, 0), "der patient nimmt metoprolol und aspirin": (0, 0, 1),
    }
    found = score_all(spark, [("der patient nimmt metoprolol", hyp, [drug(3, "metoprolol")], ()) for hyp in wanted], terms=MEDS)
    assert [(r["medical_substitutions"], r["medical_deletions"], r["medical_insertions"]) for r in found] == list(wanted.values())


def test_medical_rate_without_reference_words_and_with_overlaps():
    r = score("patient", "patient arterielle hypertonie", terms=["arterielle hypertonie"])
    assert (r["medical_insertions"], r["medical_reference_word_count"], r["mt_wer"]) == (2, 0, 2.0)
    both = [entity("a", 0, 2, "arterielle hypertonie", "x", "DIAGNOSIS"), entity("b", 1, 2, "hypertonie", "y", "DIAGNOSIS")]
    r = score("arterielle hypertonie", "arterielle hypotonie", both, terms=None, allow_overlapping_entities=True)
    assert (r["medical_reference_word_count"], r["mt_wer"]) == (2, 0.5)


def test_entities(spark):
    wanted = [
        ("metoprolol", "metamizol", 0, (0, 1, 1)), ("metoprolol", "", 0, (0, 0, 1)), ("metoprolol", "ramipril und aspirin", 0, (0, 2, 1)),
        ("nimmt ramipril", "nimmt ramipril und aspirin", 1, (1, 1, 0)),
    ]
    found = score_all(spark, [(ref, hyp, [drug(start, ref.split()[start])], ()) for ref, hyp, start, _ in wanted])
    assert [triple(r, "entity") for r in found] == [w[-1] for w in wanted]


def test_entity_occurrences_aliases_and_types():
    two = [drug(0, "metoprolol", "a"), drug(2, "metoprolol", "b")]
    assert triple(score("metoprolol dann metoprolol", "metamizol dann metoprolol", two), "entity") == (1, 1, 1)
    long = entity("e", 0, 3, "chronisch obstruktive lungenerkrankung", "copd", "DIAGNOSIS")
    r = score("chronisch obstruktive lungenerkrankung", "chronisch restriktive lungenerkrankung", [long], terms=None)
    assert triple(r, "entity") == (0, 1, 1) and r["mt_wer"] == pytest.approx(1 / 3)
    r = score("arterielle hypertonie", "hypertonie", [entity("e", 0, 2, "arterielle hypertonie", "hypertension", "DIAGNOSIS")])
    assert (r["entity_f1"], r["mt_wer"]) == (1.0, 0.5)
    copd = [{"surface": s, "canonical": "copd", "type": "DIAGNOSIS"} for s in ("copd", "chronisch obstruktive lungenerkrankung")]
    r = score("copd", "chronisch obstruktive lungenerkrankung", [entity("e", 0, 1, "copd", "copd", "DIAGNOSIS")], terms=copd)
    assert triple(r, "entity") == (1, 0, 0)
    wrong = [{"surface": "metoprolol", "canonical": "metoprolol", "type": "SYMPTOM"}]
    assert triple(score("metoprolol", "metoprolol", [drug(0, "metoprolol")], terms=wrong), "entity") == (0, 1, 1)
    assert score("metoprolol", "metoprolol", [drug(0, "metoprolol")], terms=wrong, require_entity_type=False)["entity_f1"] == 1.0


def test_doses(spark):
    wanted = {
        "metoprolol 50 mg": (1, 0, 0), "metoprolol 500 mg": (0, 1, 1), "metoprolol 0,5 mg": (0, 1, 1), "metoprolol 50 g": (0, 1, 1),
        "metoprolol fünfzig milligramm": (1, 0, 0), "metoprolol 50 milligramm": (1, 0, 0), "metoprolol": (0, 0, 1), "metamizol 50 mg": (0, 1, 1),
    }
    found = score_all(spark, [("metoprolol 50 mg", hyp, [drug(0, "metoprolol")], [MG50]) for hyp in wanted])
    assert [triple(r, "critical") for r in found] == list(wanted.values())


def test_other_slots(spark):
    pain = entity("e", 1, 2, "thoraxschmerzen", "chest_pain", "SYMPTOM")
    knee = entity("e", 1, 2, "knie", "knee", "ANATOMY")
    pulse = entity("e", 0, 1, "puls", "pulse", "CLINICAL_FINDING")
    bp = entity("e", 0, 1, "blutdruck", "blood_pressure", "CLINICAL_FINDING")
    both = [drug(0, "ramipril", "e"), drug(1, "metoprolol", "f")]
    text, dose = "ramipril metoprolol 5 mg", slot("s", "e", "DOSE", 2, 4, "5 mg", {"value": 5, "unit": "mg"})
    r = score_all(spark, [
        ("keine thoraxschmerzen", "thoraxschmerzen", [pain], [slot("s", "e", "NEGATION", 0, 1, "keine", True)]),
        ("linkes knie", "rechtes knie", [knee], [slot("s", "e", "LATERALITY", 0, 1, "linkes", "left")]),
        ("ramipril morgens", "ramipril morgens und abends", [drug(0, "ramipril")], [slot("s", "e", "FREQUENCY", 1, 2, "morgens", "morning")]),
        ("ramipril", "ramipril 5 mg", [drug(0, "ramipril")], ()),
        ("puls -5", "puls 5", [pulse], [slot("s", "e", "NUMERIC_VALUE", 1, 2, "-5", -5)]),
        ("blutdruck 120/80", "blutdruck 120/80 puls 170", [bp], [slot("s", "e", "VITAL_VALUE", 1, 2, "120/80", "120/80")]),
        (text, text, both, [dose]),
        ("ramipril eine tablette", "ramipril eine tablette", [drug(0, "ramipril")], [slot("s", "e", "FORM", 1, 3, "eine tablette", "eine tablette")]),
        ("puls links fünf", "puls links fünf", [pulse], [slot("s", "e", "UNIT", 1, 2, "links", "mg"), slot("t", "e", "VITAL_VALUE", 2, 3, "fünf", "5.0")]),
    ])
    assert [triple(x, "critical") for x in r] == [(0, 1, 1), (0, 1, 1), (0, 1, 1), (0, 1, 0), (0, 1, 1), (1, 1, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1)]
    assert r[0]["critical_matches"][0]["hypothesis_canonical"] is False and r[4]["wer"] == 0.5 and triple(r[5], "entity") == (1, 1, 0)


def test_swapped_doses():
    ref = "metoprolol 50 mg ramipril 5 mg aspirin 100 mg"
    drugs = [drug(0, "metoprolol", "a"), drug(3, "ramipril", "b"), drug(6, "aspirin", "c")]
    doses = [slot(f"s{i}", d["id"], "DOSE", 3 * i + 1, 3 * i + 3, f"{v} mg", {"value": v, "unit": "mg"}) for i, (d, v) in enumerate(zip(drugs, (50, 5, 100)))]
    r = score(ref, "metoprolol 5 mg ramipril 50 mg aspirin 100 mg", drugs, doses)
    assert triple(r, "critical") == (1, 2, 2)
    assert [m["status"] for m in r["critical_matches"]] == ["WRONG", "WRONG", "TP"]


def test_end_to_end_golden():
    ref = "Patient nimmt Ramipril 5 mg morgens und Metoprolol 50 mg zweimal täglich, keine Thoraxschmerzen."
    hyp = "Patient nimmt Ramipril 5 mg morgens und Metoprolol 15 mg zweimal täglich, Thoraxschmerzen."
    ents = [drug(2, "ramipril", "e1"), drug(7, "metoprolol", "e2"), entity("e3", 13, 14, "thoraxschmerzen", "chest_pain", "SYMPTOM")]
    slots = [
        slot("1", "e1", "DOSE", 3, 5, "5 mg", {"value": 5, "unit": "mg"}), slot("2", "e1", "FREQUENCY", 5, 6, "morgens", "morning"),
        slot("3", "e2", "DOSE", 8, 10, "50 mg", {"value": "50", "unit": "mg"}), slot("4", "e2", "FREQUENCY", 10, 12, "zweimal täglich", "2/day"),
        slot("5", "e3", "NEGATION", 12, 13, "keine", True),
    ]
    r = score(ref, hyp, ents, slots)
    assert r["wer"] == pytest.approx(2 / 14) and (r["substitutions"], r["deletions"]) == (1, 1)
    assert (r["entity_f1"], r["mt_wer"], triple(r, "critical")) == (1.0, 0.0, (3, 2, 2))
    assert r["critical_accuracy"] == r["critical_f1"] == pytest.approx(0.6)


class Tablets:
    """A plug-in that takes a tablet for five milligrams."""

    def extract(self, tokens, anchors):
        at = [i for i, t in enumerate(tokens) if t == "tablette"]
        return [Slot(i - 1, i + 1, a.start, a.end, "DOSE", {"value": 5, "unit": "mg"}, "eine tablette") for i in at for a in anchors[:1]]


class Shouting(GermanCanonicalizer):
    """A plug-in canonicalizer that knows one alias and hears doses in tablets."""

    def entity(self, tokens, entity_type, recognizer):
        return "metoprolol" if tokens == ["beloc"] else super().entity(tokens, entity_type, recognizer)

    def slot(self, tokens, slot_type):
        return super().slot([t.replace("tabletten", "mg") for t in tokens], slot_type)


def test_plug_in_canonicalizer():
    dose = slot("s", "e", "DOSE", 1, 3, "50 mg", {"value": 50, "unit": "mg"})
    r = score("metoprolol 50 mg", "beloc 50 tabletten", [drug(0, "metoprolol")], [dose], canonicalizer=Shouting())
    assert triple(r, "entity") == (1, 0, 0) and triple(r, "critical") == (1, 0, 0)
    assert r["critical_matches"][0]["hypothesis_canonical"] == {"unit": "mg", "value": 50}


class Initials:
    """A plug-in recognizer."""

    def extract(self, tokens):
        return [Term(i, i + 1, t, "metoprolol", "MEDICATION") for i, t in enumerate(tokens) if t in ("m", "metoprolol")]


def test_plug_in_recognizer():
    r = score("metoprolol", "m", [drug(0, "metoprolol")], recognizer=Initials())
    assert triple(r, "entity") == (1, 0, 0) and r["medical_substitutions"] == 1


def test_automaton_finds_what_the_dictionary_finds():
    rng = random.Random(4)
    for _ in range(200):
        keys = list({tuple(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))})
        words = rng.choices("abcd", k=rng.randint(0, 14))
        want = {(i, i + len(k), n) for n, k in enumerate(keys) for i in range(len(words)) if tuple(words[i : i + len(k)]) == k}
        got = Automaton(keys).occurrences(words)
        assert len(got) == len(want) and set(got) == want


def test_plug_ins():
    dose = slot("s", "e", "DOSE", 1, 3, "5 mg", {"value": 5, "unit": "mg"})
    r = score("metoprolol 5 mg", "metoprolol eine tablette", [drug(0, "metoprolol")], [dose], terms=None, slot_recognizer=Tablets())
    assert triple(r, "critical") == (1, 0, 0)
    with pytest.raises(ValueError, match="normalization_version"):
        Scorer(tokenizer=str.split)
    assert score("A b", "a b", terms=None, tokenizer=str.split, normalization_version="own")["wer"] == 0.5
    short, long = Lexicon([{"surface": "hypertonie", "canonical": "h"}]), Lexicon([{"surface": "arterielle hypertonie", "canonical": "ah"}])
    assert [t.canonical for t in Combined(short, long).extract("arterielle hypertonie".split())] == ["ah"]
    bare = score("metoprolol 50 mg", "metoprolol 50 mg", [drug(0, "metoprolol")], [MG50], terms=["metoprolol", "aspirin"])
    assert bare["entity_f1"] == bare["critical_f1"] == 1.0


def test_faults(spark):
    wrong_entities = [
        ({"ref_start": -1}, "span"), ({"ref_end": 9}, "span"), ({"surface": "other"}, "surface"), ({"canonical": ""}, "canonical"), ({"id": ""}, "id"), ({"type": ""}, "type"),
    ]
    wrong_slots = [
        ({"anchor_entity_id": "x"}, "anchor"), ({"id": "e"}, "unique"), ({"canonical": None}, "required"), ({"canonical": 5}, "value/unit"),
        ({"canonical": {"value": "nan", "unit": "mg"}}, "finite"), ({"canonical": {"value": True, "unit": "mg"}}, "boolean"),
        ({"canonical": {"value": 1, "unit": "foo"}}, "unit"), ({"canonical": {"value": 1, "unit": "mg", "x": 1}}, "exactly"),
        ({"type": "NEGATION", "canonical": "yes"}, "boolean"), ({"type": "LATERALITY", "canonical": {}}, "LATERALITY"),
        ({"type": "LAB_VALUE", "canonical": "abc"}, "not a clinical number: 'abc'"), ({"type": "FREQUENCY", "canonical": 5}, "non-empty string"),
    ]
    met = drug(0, "metoprolol")
    cases = [("metoprolol", "metoprolol", [met | change], ()) for change, _ in wrong_entities] + [("metoprolol 50 mg", "", [met], [MG50 | change]) for change, _ in wrong_slots]
    found = score_all(spark, cases, terms=None)
    for fault, (_, message) in zip(found, wrong_entities + wrong_slots, strict=True):
        assert isinstance(fault, str) and message in fault
    with pytest.raises(ValueError, match="span"):
        score("metoprolol", "metoprolol", [met | {"ref_start": True}], terms=None)


def test_overlap_is_a_fault_unless_allowed():
    both = [drug(0, "metoprolol", "a"), drug(0, "metoprolol", "b")]
    with pytest.raises(ValueError, match="overlapping"):
        score("metoprolol", "metoprolol", both, terms=None)
    assert score("metoprolol", "metoprolol", both, terms=None, allow_overlapping_entities=True)["entity_tp"] == 1
    with pytest.raises(ValueError, match="conflicting"):
        Lexicon([{"surface": "a", "canonical": "x"}, {"surface": "A", "canonical": "y"}])


def test_public_names_and_records():
    import scribegauge

    assert all(getattr(scribegauge, name) is not None for name in scribegauge.__all__)
    noted = {"entities": [drug(0, "metoprolol")], "critical_slots": [MG50]}
    sample = scribegauge.BenchmarkSample.from_dict({"sample_id": "x", "reference": "metoprolol 50 mg", "hypothesis": "metoprolol", "annotations": noted})
    assert scribegauge.BenchmarkSample.from_dict(sample.to_dict()) == sample and sample.annotations.critical_slots[0].canonical == MG50["canonical"]
    for wrong in ({"sample_id": ""}, {"reference": 1}, {"extra": 1}):
        with pytest.raises((TypeError, ValueError)):
            scribegauge.BenchmarkSample.from_dict(sample.to_dict() | wrong)
    found = scribegauge.align("a b c d", "a x b y d")
    assert found.wer == 0.5 and found.counts()["insertions"] == 1
    span = scribegauge.project_span_of(found, 1, 3)
    assert (span.hypothesis_start, span.hypothesis_tokens) == (found.alignment.project(1, 3)[0], found.hypothesis_tokens[slice(*found.alignment.project(1, 3))])
    with pytest.raises(ValueError, match="span"):
        scribegauge.validate_annotations({"entities": [drug(4, "metoprolol")]}, ["metoprolol"])
    own = scribegauge.default_transform().then(lambda t: t.replace("ß", "ss"))
    assert own("Große, Straße") == ["grosse", "strasse"] and scribegauge.normalize_tokens("A, b") == ["a", "b"]
    assert scribegauge.PRFCounts(1, 1, 0) + scribegauge.PRFCounts(0, 0, 1) == scribegauge.PRFCounts(1, 1, 1)
