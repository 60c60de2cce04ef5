"""Readers, corpus sums, groups, clusters, bootstrap, reports and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from scribegauge import app
from scribegauge.operators.lexicon import Lexicon, detect_terms, terminology_keys
from scribegauge.operators.resample import hash_draws, with_clusters
from scribegauge.operators.rollup import corpus_counts, group_counts, grouping_sets, metadata_groups, sums, type_counts
from scribegauge.operators.scoring import Scorer
from scribegauge.plans.evaluation import score_corpus
from scribegauge.sources.datasets import from_records, load_samples


def entity(start):
    return {"id": "e", "type": "MEDICATION", "ref_start": start, "ref_end": start + 1, "surface": "ramipril", "canonical": "ramipril"}


SAMPLES = [
    {"sample_id": "short", "reference": "ramipril", "hypothesis": "wrong", "annotations": {"entities": [entity(0)]},
     "metadata": {"accent_group": "non_native", "speaker_ids": ["a", "b"]}},
    {"sample_id": "long", "reference": "der patient nimmt ramipril", "hypothesis": "der patient nimmt ramipril", "annotations": {"entities": [entity(3)]},
     "metadata": {"accent_group": "native", "speaker_ids": ["b", "c"]}},
    {"sample_id": "empty", "reference": "", "hypothesis": "", "metadata": {"speaker_ids": ["d"]}},
]


@pytest.fixture(scope="module")
def report(spark):
    return score_corpus(SAMPLES, group_by="accent_group", spark=spark)


def test_sums_and_groups(report):
    row = report.corpus.first()
    assert (row["wer"], row["mt_wer"], row["entity_f1"]) == (0.2, 0.5, 0.5)
    groups = {r["label"]: r["wer"] for r in report.by_group("accent_group").collect()}
    assert groups == {"non_native": 1.0, "native": 0.0, "<missing>": 0.0}
    assert '["a", "b"]' in {r["label"] for r in report.by_group("speaker_ids").collect()}
    report.groups.pop("speaker_ids")


def test_reports(report, tmp_path):
    report.write_json(str(tmp_path / "r.json"))
    data = json.loads((tmp_path / "r.json").read_text())
    assert data["sample_count"] == 3 and list(data["groups"]["accent_group"]) == ["non_native", "native", "<missing>"]
    assert [s["sample_id"] for s in data["samples"]] == ["short", "long", "empty"] and "alignment" not in data["samples"][0]["metrics"]
    report.write_csv(str(tmp_path / "r.csv"))
    lines = (tmp_path / "r.csv").read_text().splitlines()
    assert len(lines) == 8 and [x.split(",")[0] for x in lines[1:]] == ["corpus", *["sample"] * 3, *["group"] * 3]
    text = report.render("short")
    assert "R   0 ramipril -> H   0 wrong [substitute]" in text and "[FN]" in text
    with pytest.raises(ValueError, match="found 0"):
        report.render("nobody")


def test_tables_and_mixed_versions(report, spark, tmp_path):
    report.write_tables(str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{name}").count() for name in ("rows", "types", "samples")] == [7, 1, 3]
    mixed = report.results.withColumn("terminology_version", F.when(F.col("sample_id") == "long", "x"))
    both = F.lit("g").alias("g")
    for sums_of in (corpus_counts, lambda r: group_counts(r, both), lambda r: type_counts(r), lambda r: metadata_groups(r, "none"), lambda r: grouping_sets(r, ["error"])):
        assert sums_of(report.results).count() > 0
        with pytest.raises(Exception, match="different benchmark versions"):
            sums_of(mixed).collect()
    # Absent versions do not change places.
    swapped = report.results.where("sample_id != 'empty'").withColumns({
        "terminology_version": F.when(F.col("sample_id") == "long", "v1"), "annotation_guideline_version": F.when(F.col("sample_id") == "short", "v1")})
    with pytest.raises(Exception, match="different benchmark versions"):
        corpus_counts(swapped).collect()


def test_clusters_and_bootstrap(report):
    got = {r["sample_id"]: r["cluster"] for r in with_clusters(report.results, "speaker_ids").collect()}
    assert got["short"] == got["long"] != got["empty"]
    first = report.bootstrap(metric="wer", n_resamples=50, seed=3, cluster_by="speaker_ids")
    assert first == report.bootstrap(metric="wer", n_resamples=50, seed=3, cluster_by="speaker_ids")
    assert first.lower <= first.estimate <= first.upper and first.estimate == 0.2
    large = report.bootstrap(metric="wer", n_resamples=50, seed=3, draws="hashed")
    assert 0 <= large.lower <= large.upper
    for options in ({"metric": "x"}, {"n_resamples": 0}, {"n_resamples": True}, {"confidence": 1}):
        with pytest.raises(ValueError):
            report.bootstrap(**options)
    with pytest.raises(ValueError, match="missing cluster"):
        report.bootstrap(cluster_by="accent_group")
    drawn = hash_draws(report.results.withColumn("cluster", F.col("ordinal")).groupBy("cluster").agg(*sums()), 400, 1)
    assert 0.8 < drawn.agg(F.avg("hits")).first()[0] / 4 < 1.2


def test_corpus_faults(spark):
    with pytest.raises(ValueError, match="unique"):
        score_corpus([SAMPLES[0], SAMPLES[0]], spark=spark)
    with pytest.raises(ValueError, match="terminology_version"):
        score_corpus([SAMPLES[0] | {"terminology_version": "2"}], Scorer(terminology_version="1"), spark=spark)
    with pytest.raises(ValueError, match="schema version"):
        score_corpus([SAMPLES[0] | {"schema_version": "2"}], spark=spark)
    kept = score_corpus([SAMPLES[0], SAMPLES[1] | {"schema_version": "2"}], strict=False, spark=spark)
    assert kept.results.count() == 1 and kept.rejected.count() == 1
    clash = [SAMPLES[0] | {"metadata": {"g": "1"}}, SAMPLES[1] | {"metadata": {"g": 1}}]
    with pytest.raises(Exception, match="collide"):
        score_corpus(clash, spark=spark).by_group("g").collect()
    assert score_corpus([], spark=spark).corpus.first()["entity_f1"] == 1.0


def test_readers(spark, tmp_path):
    lines = tmp_path / "d.jsonl"
    lines.write_text("\n".join(["", *map(json.dumps, SAMPLES), ""]), encoding="utf-8")
    assert [r["sample_id"] for r in load_samples(spark, str(lines)).orderBy("ordinal").collect()] == ["short", "long", "empty"]
    lines.write_text(json.dumps(SAMPLES[0]) + "\n\n" + json.dumps(SAMPLES[1] | {"odd": 1}) + "\n")
    with pytest.raises(ValueError, match=r"d\.jsonl:3: .*odd"):
        load_samples(spark, str(lines))
    box = tmp_path / "d.json"
    box.write_text(json.dumps({"terminology_version": "7", "samples": [SAMPLES[0], SAMPLES[1] | {"terminology_version": None}]}))
    assert [r["terminology_version"] for r in load_samples(spark, str(box)).orderBy("ordinal").collect()] == ["7", None]
    for data, n in ((SAMPLES[0], 1), (SAMPLES, 3)):
        box.write_text(json.dumps(data))
        assert load_samples(spark, str(box)).count() == n
    box.write_text("5")
    with pytest.raises(ValueError, match="dataset"):
        load_samples(spark, str(box))
    with pytest.raises(TypeError, match="missing"):
        from_records(spark, [{"sample_id": "x"}])


def test_detection_forms_agree(spark):
    texts = ["of the la de la of", "the of the the", "x", ""]
    words = ["of the", "the", "of", "de la", "la"]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "sample_id int, tokens array<string>")
    terms = spark.createDataFrame([(w.split(), w, None, None) for w in words], "surface_tokens array<string>, canonical string, type string, concept_id string")
    got = {r["sample_id"]: [(e["start"], e["end"]) for e in r["entities"]] for r in detect_terms(rows, terminology_keys(terms)).collect()}
    assert got == {i: [(e.start, e.end) for e in Lexicon(words).extract(t.split())] for i, t in enumerate(texts[:2])}


def test_command_line(spark, tmp_path, capsys):
    data, terms = tmp_path / "d.jsonl", tmp_path / "t.json"
    data.write_text("\n".join(map(json.dumps, SAMPLES)))
    terms.write_text(json.dumps({"terminology_version": "1", "entries": ["ramipril"]}))
    assert app.main(["score", "--dataset", str(data), "--terminology", str(terms), "--group-by", "accent_group"]) == 0
    assert json.loads(capsys.readouterr().out)["metrics"]["versions"]["terminology_version"] == "1"
    assert app.main(["score", "--dataset", str(data), "--output", str(tmp_path / "o.csv")]) == 0 and (tmp_path / "o.csv").exists()
    assert app.main(["inspect", "--dataset", str(data), "--sample-id", "long"]) == 0 and "REF: der patient" in capsys.readouterr().out
    assert app.main(["inspect", "--dataset", str(data), "--sample-id", "none"]) == 2 and "found 0" in capsys.readouterr().err
    assert app.main(["score", "--dataset", str(data), "--format", "csv"]) == 2
    assert app.main(["score", "--dataset", str(data), "--terminology", str(terms), "--terminology-version", "2"]) == 2


def test_stream(spark, tmp_path):
    from scribegauge.streaming.scoring import score_stream

    source = tmp_path / "in"
    from_records(spark, SAMPLES).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    query = score_stream(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("scored").agg(F.sum("hits")).first()[0] == 4
