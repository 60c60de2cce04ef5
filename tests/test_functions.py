"""Normalization, alignment, numbers and values; built-in forms against the Python ones."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribegauge.functions.numerals import parse_number
from scribegauge.functions.text import STABLE, nfkc, tokenize, tokens
from scribegauge.functions.values import plain, read_value
from scribegauge.operators.wordalign import align_tokens, edit_distance, project_span, with_alignment, with_edit_counts


def test_tokens_match_python(spark):
    rng = random.Random(3)
    texts = ["0,5 mg; 0.5 mg. 120/80 mmHg, 37 °C!", "a-b -5 x--3 1.2.3 1:2, m² … ℃ ½", "", "  ", None]
    texts += ["".join(rng.choice("ab1.,:-/ %_*°+<\t\n€ßÉ²µ—'\"()") for _ in range(24)) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens(F.col("t")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in rows} == {i: None if t is None else tokenize(t) for i, t in enumerate(texts)}
    assert tokenize(texts[0]) == ["0,5", "mg", "0.5", "mg", "120/80", "mmhg", "37", "°c"]


def classic(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_alignment_is_minimal_and_complete(a, b):
    found = align_tokens(a, b)
    ops = [s[2] for s in found.steps]
    assert sum(op != "equal" for op in ops) == classic(a, b)
    assert [s[0] for s in found.steps if s[0] is not None] == list(range(len(a)))
    assert [s[1] for s in found.steps if s[1] is not None] == list(range(len(b)))
    assert all((a[i] == b[j]) == (op == "equal") for i, j, op, _ in found.steps if i is not None and j is not None)
    assert not any({x, y} == {"delete", "insert"} for x, y in zip(ops, ops[1:]))


def test_projection():
    found = align_tokens("a b c d".split(), "x a b y c d z".split())
    assert found.project(0, 4) == (1, 6) and found.project(1, 2) == (2, 3)
    found = align_tokens("nimmt metoprolol 50 mg morgens dann ramipril".split(), "nimmt dann ramipril".split())
    assert found.project(1, 5) is None and found.project(6, 7) == (2, 3)
    with pytest.raises(ValueError, match="span"):
        found.project(3, 3)


def test_built_in_forms_match(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "ref_tokens array<string>, hyp_tokens array<string>")
    rows = with_edit_counts(with_alignment(df)).select(
        "*", edit_distance(F.col("ref_tokens"), F.col("hyp_tokens")).alias("d"), project_span(F.col("alignment"), F.lit(1), F.lit(3)).alias("p")
    ).collect()
    for r in rows:
        assert r["d"] == classic(r["ref_tokens"], r["hyp_tokens"]) == r["substitutions"] + r["deletions"] + r["insertions"]
        assert r["reference_word_count"] == len(r["ref_tokens"])
        if len(r["ref_tokens"]) >= 3:
            assert align_tokens(r["ref_tokens"], r["hyp_tokens"]).project(1, 3) == (None if r["p"]["hyp_start"] is None else tuple(r["p"]))


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("einmal täglich", "FREQUENCY", "1/day"), ("morgens und abends", "FREQUENCY", "2/day"), ("bei bedarf", "FREQUENCY", "PRN"),
        ("alle 8 stunden", "FREQUENCY", "every_8h"), ("alle acht stunden", "FREQUENCY", "every_8h"), ("alle stunden", "FREQUENCY", None),
        ("null komma fünf mg", "DOSE", {"value": 0.5, "unit": "mg"}), ("fünfundzwanzig mg", "DOSE", {"value": 25, "unit": "mg"}),
        ("unsicher mg", "DOSE", None), ("5", "DOSE", None), ("5", "LAB_VALUE", 5), ("012/080", "VITAL_VALUE", "12/80"), ("mg", "UNIT", "mg"),
        ("nicht", "NEGATION", True), ("", "NEGATION", False), ("links rechts", "LATERALITY", None), ("", "OTHER", None), ("x y", "OTHER", "x y"),
    ],
)
def test_values(text, kind, value):
    assert plain(read_value(text.split(), kind)) == value


def test_numbers():
    assert parse_number("1.000") == 1 and parse_number("dreitausendvierhundertzwölf") == 3412
    assert parse_number("zweihundertzweihundert") is None and parse_number("eins komma zehn") is None


def test_stable_characters_are():
    matched = [chr(i) for i in range(0x250) if re.fullmatch(STABLE, chr(i))]
    assert len(matched) > 300 and all(unicodedata.normalize("NFKC", c) == c for c in matched)
    assert not any(re.fullmatch(STABLE, c) for c in ("ſ", "ĳ", "ŉ", "ŀ", "\u0301", "µ", "½", "ﬁ"))


def test_nfkc_of_mixed_texts(spark):
    texts = ["größe", "ﬁnd ½", "e\u0301", None, "", "Straße ﬀ 5 µg"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", nfkc(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
