"""Detection with a terminology of very many key lengths."""

from scribegauge.operators.lexicon import detect_terms, terminology_keys


def test_terms_longer_than_a_thousand_lengths(spark):
    terms = spark.createDataFrame([(["a"] * n, f"c{n}", None, None) for n in range(1, 1002)], "surface_tokens array<string>, canonical string, type string, concept_id string")
    samples = spark.createDataFrame([("s", ["a"] * 1001), ("t", [])], "sample_id string, tokens array<string>")
    got = {r["sample_id"]: [(t["start"], t["end"], t["canonical"]) for t in r["entities"]] for r in detect_terms(samples, terminology_keys(terms)).collect()}
    assert got == {"s": [(0, 1001, "c1001")]}
