"""Values and terms by expressions against plain token lists."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from scribegauge.functions.values import NUMERIC_TYPES, Quantity, read_value
from scribegauge.operators import lexicon
from scribegauge.operators.lexicon import Lexicon, Term
from scribegauge.operators.readings import readings, span_value, word_number
from scribegauge.operators.slotscan import RuleSlots

WORDS = (
    "keine nicht linkes rechts beidseits 5 mg 50 g 0,50 ml 0120/080 mmhg prozent fünf und zwanzig fünfundzwanzig ein hundert einhundertdrei komma "
    "zwei drei null alle acht stunden morgens abends zweimal täglich bei bedarf dann der -3 +4 -0 007 1.50 zw ei tausend siebentausend ٣ knie"
).split()


def plain_key(value):
    def number(n):
        text = f"{n:f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text == "-0" else text

    if value is None:
        return None
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, Decimal):
        return f"n:{number(value)}"
    if isinstance(value, Quantity):
        return f"q:{number(value.value) if isinstance(value.value, Decimal) else value.value}|{value.unit}"
    return ("r:" if value[:1].isdigit() and "/day" not in value else "t:") + value


def test_values_of_spans(spark):
    rng, kinds = random.Random(1), [*sorted(NUMERIC_TYPES), "NEGATION", "LATERALITY", "FREQUENCY", "UNIT", "OWN"]
    rows = [(i, rng.choices(WORDS, k=rng.randint(1, 5)), rng.choice(kinds)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "i int, words array<string>, kind string")
    got = {r["i"]: r["key"] for r in frame.select("i", span_value(F.col("words"), F.lit(0), F.size("words"), F.col("kind")).alias("key")).collect()}
    for i, words, kind in rows:
        want = read_value(words, kind)
        assert got[i] == (f"t:{want}" if kind == "OWN" else plain_key(want)), (words, kind)


def test_readings_of_token_lists(spark):
    rng, rows = random.Random(2), []
    for i in range(1500):
        words, taken, at = rng.choices(WORDS, k=rng.randint(0, 12)), [], 0
        while at < len(words):
            if rng.random() < 0.15:
                taken.append((at, at + 1))
            at += 1
        rows.append((i, words, taken))
    frame = spark.createDataFrame(rows, "i int, words array<string>, taken array<struct<start:int,end:int>>")
    got = {r["i"]: [tuple(x) for x in r["found"]] for r in frame.select("i", readings(F.col("words"), F.col("taken")).alias("found")).collect()}
    for i, words, taken in rows:
        anchors = [Term(s, e, words[s], "x") for s, e in taken]
        assert got[i] == [(r.start, r.rank, r.end, plain_key(r.value)) for r in RuleSlots().readings(words, anchors)], words


def test_number_words_by_pattern(spark):
    from scribegauge.functions.numerals import number_words

    words = number_words() | dict.fromkeys(("", "undzwanzig", "einund", "hunderthundert", "tausendtausend", "zehnundzwanzig", "einundzehn"))
    frame = spark.createDataFrame(list(words.items()), "word string, value long")
    wrong = frame.select("word", "value", word_number(F.col("word")).cast("long").alias("read")).where(~F.col("value").eqNullSafe(F.col("read")))
    assert wrong.collect() == []


def test_both_forms_of_term_hits(spark, monkeypatch):
    rng = random.Random(3)
    terms = Lexicon([{"surface": s, "canonical": s.upper(), "concept_id": None} for s in ("a", "a b", "b c", "a b c d", "d")])
    rows = [(i, rng.choices("abcde", k=rng.randint(0, 9))) for i in range(200)]
    frame = spark.createDataFrame(rows, "i int, words array<string>")
    found = []
    for few in (256, 0):
        monkeypatch.setattr(lexicon, "FEW_TERMS", few)
        made = frame.select("i", F.array_sort(lexicon.term_hits(spark, terms, F.col("words"))).alias("hits"))
        found.append({r["i"]: [tuple(h) for h in r["hits"]] for r in made.collect()})
    want = {i: sorted((s, s + len(k), m[0], m[1]) for k, m in terms.meanings.items() for s in range(len(w)) if tuple(w[s : s + len(k)]) == k) for i, w in rows}
    assert found[0] == found[1] and {i: [h[:4] for h in hits] for i, hits in found[0].items()} == want
