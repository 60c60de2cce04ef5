"""The pipeline's stages one by one against plain versions, and the run against the stages."""

import random

import pytest
from pyspark.sql import functions as F
from test_dedup import fingerprint
from test_line_dedup_whole import every_later_line
from test_text_ops import substring_distance

import corpus_pipeline
from scribegauge.llm import decontaminate, mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    item = " ".join(rng.choice(words) for _ in range(14))

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = []
    for i in range(70):
        lines = [line(rng.randint(1, 25)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0 and texts:
            lines.insert(0, rng.choice(rng.choice(texts).split("\n")))
        if i % 9 == 0:
            lines.append(line(6) + " " + item.replace(words[0], "x") + " " + line(6))
        if i % 7 == 0:
            lines.append("you awful fool " * 3 + line(3))
        texts.append("\n".join(lines))
    texts[40] = texts[11] + " " + line(1)
    texts[41] = texts[12]
    rows = [(i, t, rng.choice(["en", None]), ["a", "a", "a", "b"][i % 4], len(t)) for i, t in enumerate(texts)] + [(70, None, "en", "b", None), (71, "", "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 0)) for i in range(70)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return labels, item


def plain_lines(rows):
    gone = every_later_line([(r[0], r[1] or "") for r in rows])
    out = []
    for doc_id, text, lang, source, _ in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)
        if kept == text or kept.split():
            out.append((doc_id, kept, lang, source, None if kept is None else len(kept)))
    return out


def plain_groups(rows):
    marks = {r[0]: fingerprint(r[1]) for r in rows}
    group = {i: i for i in marks}
    for _ in marks:
        for i in marks:
            for j in marks:
                if (marks[i] ^ marks[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    return [r for r in rows if group[r[0]] == r[0]]


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    labels, item = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = sorted(tuple(r) for r in docs.collect())

    def run(stage, given):
        out = stages[stage](spark, spark.createDataFrame(given, DOCS), folder)
        assert out.columns[:5] == docs.columns and (stage == "mixing" or out.columns == docs.columns)
        return sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = toxicity.Scorer(model)
    clean = [r for r in rows if score(r[1] or "") < model.thresholds.get(r[2], toxicity.THRESHOLD)]
    assert run("toxicity", rows) == clean and len(clean) < len(rows)
    lines = plain_lines(clean)
    assert run("line_dedup", clean) == lines != clean
    single = plain_groups(lines)
    assert run("simhash_near_dedup", lines) == single and len(single) < len(lines)
    wanted = decontaminate.normalise(item)
    fair = [r for r in single if substring_distance(wanted, decontaminate.normalise(r[1])) > decontaminate.edit_budget(len(wanted))]
    assert run("benchmark_decontamination", single) == fair and len(fair) < len(single)
    mixed = run("mixing", fair)
    sources = sorted({r[3] for r in fair})
    tokens = [sum(len((r[1] or "").split()) for r in fair if r[3] == s) for s in sources]
    times = mixing.repetitions(tokens, mixing.weights(tokens, mixing.solve_exponent(tokens, max_repetition=mixing.MAX_REPETITION)), None)
    for source, own, r in zip(sources, tokens, times):
        mine = [x for x in mixed if x[3] == source]
        assert {x[0] for x in mine} == {x[0] for x in fair if x[3] == source}
        assert sum(x[5] for x in mine) == pytest.approx(r * own, abs=120)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.select(*docs.columns, "n_tokens", "epoch", F.round("position", 9).alias("p")).count() == len(mixed)
    assert sorted((tuple(r) for r in whole.collect()), key=lambda r: (r[0], r[6])) == sorted(mixed, key=lambda r: (r[0], r[6]))
