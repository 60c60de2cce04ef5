"""Repeated samples: each content is scored once, and every sample gets its result."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from scribegauge import catalog, catalog_more
from scribegauge.functions import schemas
from scribegauge.operators import rollup, scoring
from scribegauge.operators.resample import cluster_sums, with_clusters
from scribegauge.operators.rollup import sums

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def texts(df):
    return sorted(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0])


@pytest.fixture
def scored_rows(monkeypatch):
    """How many rows each run of scoring was given."""
    given, plain = [], scoring.score_samples
    monkeypatch.setattr(scoring, "score_samples", lambda samples, *a, **b: given.append(samples.count()) or plain(samples, *a, **b))
    return given


@needs_data
def test_distinct_contents_give_the_results_of_all_samples(spark, scored_rows, monkeypatch):
    some = catalog_more.faulty_samples(spark, str(DATA)).where("ordinal % 50 = 0").drop("fault")
    nameless = some.limit(3).withColumns({"sample_id": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")})
    blank = some.limit(2).withColumns({"annotations": F.lit(None).cast(some.schema["annotations"].dataType), "hypothesis": F.lit(None).cast("string")})
    samples = some.unionByName(some.withColumn("ordinal", -F.col("ordinal"))).unionByName(nameless).unionByName(blank).localCheckpoint()
    want = scoring.score_samples(samples, catalog.template_scorer())
    scored_rows.clear()
    assert texts(scoring.score_distinct(samples, catalog.template_scorer())) == texts(want)
    assert scored_rows == [samples.select(*scoring.CONTENT).distinct().count()] and scored_rows[0] < samples.count() / 2
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", -1)
    assert texts(scoring.score_distinct(samples, catalog.template_scorer())) == texts(want)
    assert scoring.score_distinct(samples.limit(0), catalog.template_scorer()).isEmpty()


@needs_data
@pytest.mark.parametrize("name", ["scores_by_flag", "bootstrap", "match_logs", "report_rows", "scores_by_type", "scores_corpus", "scores_grouping_sets", "scoring_faults"])
def test_queries_score_each_content_once(spark, scored_rows, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{DATA}/lineitem.parquet'")
    queries, sql = catalog.QUERIES | catalog_more.QUERIES, catalog.ORACLE_SQL | catalog_more.ORACLE_SQL
    frame = queries[name](spark, str(DATA))
    want = con.execute(f"select count(*) from ({sql[name]})").fetchone()[0]
    assert frame.count() == want
    samples = catalog_more.faulty_samples(spark, str(DATA)) if name == "scoring_faults" else catalog.template_samples(spark, str(DATA))
    assert scored_rows == [samples.select(*scoring.CONTENT).distinct().count()]


def test_sums_by_cluster(spark):
    members = ['["a"]', '["b","c"]', '["c","a"]', '"d"', '["d","d"]', '["e"]', '["f","b"]']
    rows = [(i, f"s{i}", f'{{"who": {m}}}') for i, m in enumerate(members, 5)]
    counts = [F.col("ordinal").alias(c) for c in catalog.COUNTED]
    results = spark.createDataFrame(rows, "ordinal long, sample_id string, metadata string").select("*", *counts)
    clusters = {r["ordinal"]: r["cluster"] for r in with_clusters(results, "who").collect()}
    assert clusters == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 10, 11: 5}
    want = with_clusters(results, "who").groupBy("cluster").agg(*sums())
    assert texts(cluster_sums(results, "who").select(*want.columns)) == texts(want)
    with pytest.raises(ValueError, match="s6: missing cluster metadata"):
        cluster_sums(results.withColumn("metadata", F.when(F.col("ordinal") != 6, F.col("metadata"))), "who")


@needs_data
def test_written_lines_are_compressed(spark, monkeypatch):
    seen, load = [], catalog_more.load_samples

    def loaded(session, path):
        seen.extend(session.read.format("binaryFile").load(path).select("path", "length").collect())
        return load(session, path)

    monkeypatch.setattr(catalog_more, "load_samples", loaded)
    n = catalog_more.written_samples(spark, str(DATA)).count()
    assert seen and all(r["path"].endswith(".gz") for r in seen) and sum(r["length"] for r in seen) < 100 * n


ODD_METADATA = (
    None, "", "{}", '{"flag":"A","status":"x","speaker":3}', '{"status": "x", "flag": "A"}', '{"flag":"A","speaker":4}', '{"flag":5}', '{"a":1,"flag":5.0}',
    '{"flag":"5"}', '{"flag":"A","flag":"B"}', '{"flag":"B","fl\\u0061g":"A"}', '{"x":"\\"flag\\":\\"C\\"","flag":"D"}', '{"x":{"flag":"E"}}', '{"x":{"flag":"E"},"flag":"F"}',
    '{"flag":""}', '{"flag":null,"x":1}', '{"flag":true}', '{"x":-1.5e3,"flag":"G"}', '{"flags":"H","flag":"I"}', '{"flag":["A"],"x":1}', '{"flag":"ü}","x":"{,"}',
)


def test_a_field_alone_has_the_label_of_all_metadata(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_METADATA)), "ordinal long, metadata string")
    for field in ("flag", "speaker", "x", "$1", "a\\E", 'q"'):
        rows = rows.unionByName(rows.limit(1).withColumn("metadata", F.lit(f'{{"y":1,{json.dumps(field)}:"Z"}}')))
        label = lambda df: df.select("ordinal", rollup.group_label(field).alias("l")).select("ordinal", "l.*")  # noqa: B023, E731
        assert texts(label(rows.withColumn("metadata", rollup.only_field(field)))) == texts(label(rows))  # noqa: B023
    short = spark.createDataFrame([('{"status":"x","flag":"A","speaker":3}',), ('{"x":{"flag":"E"},"flag":"F"}',)], "metadata string").select(rollup.only_field("flag"))
    assert [r[0] for r in short.collect()] == ['{"flag":"A"}', '{"x":{"flag":"E"},"flag":"F"}']


@needs_data
def test_sums_of_counted_samples_are_those_of_all(spark, scored_rows, monkeypatch):
    some = catalog_more.faulty_samples(spark, str(DATA)).where("ordinal % 50 = 0").drop("fault").withColumn("metadata", F.get(F.array(*map(F.lit, ODD_METADATA)), (F.col("ordinal") / 50 % 8).cast("int")))
    blank = some.limit(2).withColumns({"annotations": F.lit(None).cast(some.schema["annotations"].dataType), "hypothesis": F.lit(None).cast("string")})
    samples = some.unionByName(some.withColumn("ordinal", -F.col("ordinal"))).unionByName(blank).localCheckpoint()
    scorer, contents = catalog.template_scorer(), samples.select(*scoring.CONTENT).distinct().count()
    want = scoring.score_samples(samples, scorer, matches=False).localCheckpoint()
    scored_rows.clear()
    plain, by_text = scoring.score_counted(samples, scorer), scoring.score_counted(samples.withColumn("metadata", rollup.only_field("flag")), scorer, by=["metadata"])
    own = scoring.score_counted(samples.withColumn("odd", F.col("ordinal") % 2), scorer, by=["odd"])
    assert scored_rows == [contents] * 3 and plain.count() == contents
    assert plain.agg(F.sum("n_samples")).first()[0] == by_text.agg(F.sum("n_samples")).first()[0] == samples.count()
    assert texts(rollup.corpus_counts(plain)) == texts(rollup.corpus_counts(by_text)) == texts(rollup.corpus_counts(want))
    assert texts(rollup.type_counts(plain)) == texts(rollup.type_counts(own)) == texts(rollup.type_counts(want))
    assert texts(rollup.metadata_groups(by_text, "flag")) == texts(rollup.metadata_groups(want, "flag"))
    assert texts(rollup.grouping_sets(own, ["odd"])) == texts(rollup.grouping_sets(want.withColumn("odd", F.col("ordinal") % 2), ["odd"]))
    assert texts(rollup.type_counts(own, "odd")) == texts(rollup.type_counts(want.withColumn("odd", F.col("ordinal") % 2), "odd"))
    none = scoring.score_counted(samples.limit(0), scorer)
    assert none.isEmpty() and rollup.corpus_counts(none).first()["hits"] == 0


@needs_data
@pytest.mark.parametrize("name, sums_of, keys", [
    ("scores_by_flag", "metadata_groups", ["l_returnflag"]), ("scores_by_type", "type_counts", []), ("scores_corpus", "corpus_counts", []),
    ("scores_grouping_sets", "grouping_sets", ["l_returnflag", "l_linestatus"]),
])
def test_queries_sum_counted_contents(spark, monkeypatch, name, sums_of, keys):
    summed, plain = [], getattr(catalog, sums_of)
    monkeypatch.setattr(catalog, sums_of, lambda results, *a: summed.append(results.count()) or plain(results, *a))
    catalog.QUERIES[name](spark, str(DATA))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    kinds = lines.select(F.col("l_partkey") % 4, F.col("l_quantity").cast("int"), (F.col("l_orderkey") + F.col("l_linenumber")) % 8, *keys).distinct().count()
    assert summed == [kinds] and kinds < lines.count()


@needs_data
@pytest.mark.parametrize("name, keys", [("scores_by_flag", ["l_returnflag"]), ("scores_by_type", []), ("scores_corpus", []), ("scores_grouping_sets", ["l_returnflag", "l_linestatus"])])
def test_lines_are_counted_before_their_texts_are_written(spark, monkeypatch, name, keys):
    given, plain = [], catalog.score_counted
    monkeypatch.setattr(catalog, "score_counted", lambda samples, *a, **b: given.append(samples) or plain(samples, *a, **b))
    catalog.QUERIES[name](spark, str(DATA))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    kinds = lines.select(F.col("l_partkey") % 4, F.col("l_quantity").cast("int"), (F.col("l_orderkey") + F.col("l_linenumber")) % 8, *keys).distinct().count()
    (samples,) = given
    assert samples.agg(F.count("*"), F.sum("n_samples")).first()[:] == (kinds, lines.count()) and kinds < lines.count()


def test_counts_of_odd_lines_are_those_of_their_samples(spark, tmp_path):
    rows = [(o, n, p, 7, q, f, "O") for o in (8, 9, None) for n in (1, 5) for p in (3, 4, 8, -4, None) for q in (2.0, 2.9, None) for f in ("A", None)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    lines = spark.createDataFrame(rows, names)
    lines.unionAll(lines.limit(9)).write.parquet(f"{tmp_path}/lineitem.parquet")
    samples, flag = catalog.template_samples(spark, str(tmp_path)), F.get_json_object("metadata", "$.flag").alias("flag")
    want = samples.groupBy(*scoring.CONTENT, flag).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n_samples"))
    by_flag = catalog.template_counts(spark, str(tmp_path), "flag")
    sums = (F.min("ordinal").alias("ordinal"), F.sum("n_samples").alias("n_samples"))
    assert texts(by_flag.groupBy(*scoring.CONTENT, flag).agg(*sums)) == texts(want)
    assert by_flag.where(F.col("metadata").rlike("status|speaker")).isEmpty() and by_flag.count() < samples.count()
    plain = catalog.template_counts(spark, str(tmp_path))
    assert texts(plain.groupBy(*scoring.CONTENT).agg(*sums)) == texts(want.groupBy(*scoring.CONTENT).agg(*sums))
    scorer = catalog.template_scorer()
    assert texts(rollup.type_counts(scoring.score_counted(plain, scorer))) == texts(rollup.type_counts(scoring.score_counted(samples, scorer)))


def test_few_contents_are_one_task(spark, monkeypatch):
    seen, plain = [], scoring.score_samples
    monkeypatch.setattr(scoring, "score_samples", lambda samples, *a, **b: seen.append(samples.rdd.getNumPartitions()) or plain(samples, *a, **b))
    absent = {"annotations": schemas.ANNOTATIONS} | dict.fromkeys(schemas.VERSION_FIELDS[1:], "string")
    given = {"ordinal": F.col("id"), "reference": F.concat(F.lit("knie "), "id"), "hypothesis": F.lit("knie"), "schema_version": F.lit(schemas.SCHEMA_VERSION)}
    given |= {c: F.lit(None).cast(t) for c, t in absent.items()}
    scoring.score_counted(spark.range(1_900).select(*(c.alias(n) for n, c in given.items())), catalog.template_scorer())
    scoring.score_counted(spark.range(4_100).select(*(c.alias(n) for n, c in given.items())), catalog.template_scorer())
    assert seen == [1, 2]
