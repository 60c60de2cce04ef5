"""Queries over the driver's tables and the SQL that checks them.

The tables hold no clinical transcripts, so both engines derive them from the
same columns: a template corpus with one sample for each row of ``lineitem``,
and transcripts of whole conversation turns with known errors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .functions import schemas
from .functions.numerals import number_dimension
from .functions.rates import with_rates
from .functions.text import normalize_text, tokens
from .functions.values import as_json, read_value
from .operators import resample
from .operators.checks import violation_column
from .operators.lexicon import Lexicon, detect_terms, terminology_keys
from .operators.resample import bootstrap_interval, with_clusters
from .operators.rollup import corpus_counts, group_counts, grouping_sets, metadata_groups, type_counts
from .operators.scoring import Scorer, score_counted, score_distinct
from .operators.wordalign import edit_distance, project_span, with_alignment, with_edit_counts

DRUGS = ("metoprolol", "ramipril", "aspirin", "metamizol")
NOVEL = "zzqx"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Template corpus -----------------------------------------------------------


def _drug(number: str) -> Column:
    return F.get(F.array(*map(F.lit, DRUGS)), F.col(number).cast("int"))


def _ordinal() -> Column:
    """A number of the row that does not depend on how rows are spread over tasks."""
    return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 20) + F.col("l_partkey")) * (1 << 10) + F.col("l_suppkey")


#: What the texts of a line are made of (numbers of two drugs, dose, error class), and its metadata.
PARTS, METADATA = ("drug", "next_drug", "dose", "kind"), ("flag", "status", "speaker")


def _line_parts(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"), _ordinal().alias("ordinal"),
        (F.col("l_partkey") % 4).alias("drug"), ((F.col("l_partkey") + 1) % 4).alias("next_drug"), F.col("l_quantity").cast("int").alias("dose"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("kind"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("speaker"),
    )


def template_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotated sample per row of ``lineitem``; the error class is ``(l_orderkey + l_linenumber) % 8``."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    if lines.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        # A small file is one split; the narrow rows are spread before the costly scoring.
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    return _written(_line_parts(lines))


def template_counts(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The samples of all rows of ``lineitem`` as counts by content and metadata ``fields``: ``n_samples``, and the first one's ``ordinal``.

    Every line is counted by what its texts are made of, and the texts are put together once for each count.
    """
    parts = _line_parts(table(spark, sf_dir, "lineitem"))
    counted = parts.groupBy(*PARTS, *fields).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n_samples"))
    absent = {c: F.lit(None).cast("string") for c in ("sample_id", *METADATA) if c not in fields}
    return _written(counted.withColumns(absent), "n_samples")


def _written(parts: DataFrame, *carried: str) -> DataFrame:
    """Texts, annotations and metadata from the parts of lines."""
    dose, kind = F.col("dose"), F.col("kind")
    amount = F.concat_ws(" ", dose.cast("string"), F.lit("mg"))
    said_amount = (
        F.when(kind == 1, F.concat_ws(" ", (dose * 10).cast("string"), F.lit("mg")))
        .when(kind == 4, F.concat_ws(" ", dose.cast("string"), F.lit("Milligramm")))
        .when(kind != 3, amount)
    )
    reference = F.concat_ws(" ", F.lit("Patient nimmt"), _drug("drug"), amount, F.lit("keine Thoraxschmerzen, linkes Knie."))
    hypothesis = F.concat_ws(
        " ", F.lit("Patient nimmt"), F.when(kind == 2, _drug("next_drug")).otherwise(_drug("drug")), said_amount,
        F.when(kind != 6, "keine"), F.lit("Thoraxschmerzen"), F.when(kind == 7, "rechtes").otherwise("linkes"), F.lit("Knie"),
        F.when(kind == 5, F.concat_ws(" ", F.lit("und"), _drug("next_drug"))),
    )

    def item(**fields) -> Column:
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))

    nothing = F.lit(None).cast("string")
    entities = F.array(
        item(id="e1", type="MEDICATION", ref_start=2, ref_end=3, surface=_drug("drug"), canonical=_drug("drug"), concept_id=nothing),
        item(id="e2", type="SYMPTOM", ref_start=6, ref_end=7, surface="thoraxschmerzen", canonical="chest_pain", concept_id=nothing),
        item(id="e3", type="ANATOMY", ref_start=8, ref_end=9, surface="knie", canonical="knee", concept_id=nothing),
    )
    value = F.concat(F.lit('{"value": '), dose.cast("string"), F.lit(', "unit": "mg"}'))
    slots = F.array(
        item(id="s1", anchor_entity_id="e1", type="DOSE", ref_start=3, ref_end=5, surface=amount, canonical=value),
        item(id="s2", anchor_entity_id="e2", type="NEGATION", ref_start=5, ref_end=6, surface="keine", canonical="true"),
        item(id="s3", anchor_entity_id="e3", type="LATERALITY", ref_start=7, ref_end=8, surface="linkes", canonical='"left"'),
    )
    return parts.select(
        "sample_id", "ordinal", reference.alias("reference"), hypothesis.alias("hypothesis"),
        F.struct(entities.alias("entities"), slots.alias("critical_slots")).alias("annotations"),
        F.to_json(F.struct(*METADATA)).alias("metadata"),
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        *(F.lit(None).cast("string").alias(v) for v in schemas.VERSION_FIELDS[1:]), *carried,
    )


def template_scorer() -> Scorer:
    terms = [{"surface": d, "canonical": d, "type": "MEDICATION"} for d in DRUGS]
    terms += [{"surface": "thoraxschmerzen", "canonical": "chest_pain", "type": "SYMPTOM"}, {"surface": "knie", "canonical": "knee", "type": "ANATOMY"}]
    return Scorer(recognizer=Lexicon(terms))


def template_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_distinct(template_samples(spark, sf_dir), template_scorer(), matches=False)


COUNTED = (*schemas.COUNT_FIELDS, *schemas.PRF_FIELDS)
RATES = ("wer", "mt_wer", "entity_precision", "entity_recall", "entity_f1", "critical_precision", "critical_recall", "critical_f1", "critical_accuracy")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *COUNTED, *(F.round(c, 9).alias(c) for c in RATES))


def scores_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(corpus_counts(score_counted(template_counts(spark, sf_dir), template_scorer())))


def scores_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = score_counted(template_counts(spark, sf_dir, "flag"), template_scorer(), by=["metadata"])
    return _rounded(metadata_groups(results, "flag"), "label")


def scores_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "flag string, status string"
    samples = template_counts(spark, sf_dir, "flag", "status").select("*", F.from_json("metadata", fields).alias("m")).select("*", "m.*")
    results = score_counted(samples, template_scorer(), by=["flag", "status"])
    return _rounded(grouping_sets(results, ["flag", "status"]), "group_by", "label")


def scores_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = type_counts(score_counted(template_counts(spark, sf_dir), template_scorer()))
    return found.select("family", "type", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def span_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the dose's reference span lies in each hypothesis; every third one has further words inside the span.

    Where a wrong dose stands before such words, the last of them is its counterpart: a substitution
    goes before an insertion that is only as good, read from the end.
    """
    samples = template_samples(spark, sf_dir)
    said = F.when(F.col("ordinal") % 3 == 0, F.regexp_replace("hypothesis", " (mg|Milligramm) ", " also etwa $1 ")).otherwise(F.col("hypothesis"))
    pairs = samples.select("sample_id", tokens(F.col("reference"), True).alias("ref_tokens"), tokens(said, True).alias("hyp_tokens"))
    found = with_alignment(pairs).select("sample_id", project_span(F.col("alignment"), F.lit(3), F.lit(5)).alias("p"))
    return found.select("sample_id", "p.hyp_start", "p.hyp_end")


def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violated rules of template samples into which faults are put by ``l_orderkey % 7``."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.col("l_orderkey") % 7
    entities = F.array(
        F.struct(F.lit("e1").alias("id"), F.when(kind == 2, "").otherwise("MEDICATION").alias("type"), F.lit(2).alias("ref_start"),
                 F.when(kind == 3, 2).otherwise(3).alias("ref_end"), F.when(kind == 4, "").otherwise("x").alias("canonical")),
        F.struct(F.when(kind == 1, "e1").otherwise("e2").alias("id"), F.lit("SYMPTOM").alias("type"), F.when(kind == 5, 2).otherwise(6).alias("ref_start"),
                 F.lit(7).alias("ref_end"), F.lit("y").alias("canonical")),
    )
    slots = F.array(
        F.struct(F.lit("s1").alias("id"), F.lit("DOSE").alias("type"), F.lit(3).alias("ref_start"), F.lit(5).alias("ref_end"),
                 F.lit("1").alias("canonical"), F.when(kind == 6, "e9").otherwise("e1").alias("anchor_entity_id"))
    )
    words = F.array_repeat(F.lit("w"), 9)
    typed = lines.select("l_returnflag", words.alias("t"), entities.alias("e"), slots.alias("s"))
    found = typed.select("l_returnflag", F.explode(violation_column(F.col("t"), F.col("e"), F.col("s"))).alias("rule"))
    return found.groupBy("l_returnflag", "rule").agg(F.count("*").alias("n"))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of critical F1 by clusters of a speaker, with arithmetic draws."""
    interval = bootstrap_interval(template_results(spark, sf_dir), "critical_f1", 200, seed=7, cluster_by="speaker", draws="hashed")
    names = ("estimate", "lower", "upper")
    row = [(interval.metric, *(round(getattr(interval, n), 9) for n in names), interval.n_resamples, interval.cluster_by)]
    return spark.createDataFrame(row, "metric string, estimate double, lower double, upper double, n_resamples long, cluster_by string")


# Free text ------------------------------------------------------------------


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("normalized_md5"), F.size(F.filter(F.split("t", " "), lambda w: w != "")).cast("long").alias("n_tokens"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", tokens(F.col("text")).alias("t"))
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_documents"), F.sum(F.size("t")).alias("n_tokens"))


def _noisy_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and transcripts that lose every seventh token and mishear others as an unknown word."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens(F.col("text")).alias("ref_tokens"))
    heard = F.transform("ref_tokens", lambda t, i: F.when(i % 7 == 3, F.lit("")).when(i % 11 == 5, F.lit(NOVEL)).otherwise(t))
    return turns.withColumn("hyp_tokens", F.filter(heard, lambda t: t != ""))


def wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_edit_counts(with_alignment(_noisy_turns(spark, sf_dir)))
    summed = counted.groupBy("role").agg(
        F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"),
        F.sum("reference_word_count").alias("words"), F.sum(F.size("hyp_tokens")).alias("hypothesis_words"),
    )
    return summed.select("role", "errors", "words", "hypothesis_words", F.round(F.col("errors") / F.col("words"), 9).alias("wer"))


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each benchmark text to the next, by built-in folds only."""
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("a"))
    others = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return items.join(others, "item_id").select("item_id", edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


COMMON = ("of the", "the", "of", "de la", "la")


def detected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of a few overlapping terms is detected in the turns."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), tokens(F.col("text")).alias("tokens"))
    rows = [(t.split(), t, None, None) for t in COMMON]
    terms = spark.createDataFrame(rows, "surface_tokens array<string>, canonical string, type string, concept_id string")
    found = detect_terms(turns, terminology_keys(terms)).select(F.explode("entities").alias("e"))
    return found.groupBy(F.col("e.canonical").alias("canonical")).agg(F.count("*").alias("n"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words for the part numbers of order lines (their last four digits), and how many lines each thousand has."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 10_000).alias("value")).agg(F.count("*").alias("lines"))
    words = lines.join(F.broadcast(number_dimension(spark)), "value")
    return words.groupBy((F.col("value") / 1000).cast("long").alias("thousands")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.length("word")).cast("long").alias("letters"), F.sum("lines").alias("lines")
    )


@F.pandas_udf(StringType())
def _read(spans: pd.Series, kinds: pd.Series) -> pd.Series:
    return spans.combine(kinds, lambda s, k: as_json(read_value(s.split(), k)))


def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read from spans made of quantities."""
    n = F.col("l_quantity").cast("int").cast("string")
    spans = F.array(
        F.struct(F.concat(n, F.lit(" mg")).alias("span"), F.lit("DOSE").alias("kind")),
        F.struct(F.concat(n, F.lit(",5 Prozent")).alias("span"), F.lit("LAB_VALUE").alias("kind")),
        F.struct(F.concat(F.lit("alle "), n, F.lit(" stunden")).alias("span"), F.lit("FREQUENCY").alias("kind")),
        F.struct(F.concat(F.lit("0"), n, F.lit("/80")).alias("span"), F.lit("VITAL_VALUE").alias("kind")),
        F.struct(n.alias("span"), F.lit("DOSE").alias("kind")),
    )
    wanted = table(spark, sf_dir, "lineitem").select(F.inline(spans)).groupBy("span", "kind").agg(F.count("*").alias("n"))
    return wanted.select("span", "kind", "n", _read(F.lower("span"), "kind").alias("value"))


def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by a metadata field of JSON properties, with numbers as labels."""
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTED if c != "hits"]
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"), F.col("props").alias("metadata"), F.lit(1).cast("long").alias("hits"), *zero,
        *(F.lit("1").alias(v) for v in schemas.VERSION_FIELDS),
    )
    return metadata_groups(events, "k").select("label", "first", "hits")


def speaker_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns clustered by shared members: their conversation, and a speaker of three conversations."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("turn").cast("string").alias("sample_id"),
        F.to_json(F.struct(F.array(F.concat(F.lit("c"), "conv_id"), F.concat(F.lit("s"), F.floor(F.col("conv_id") / 3))).alias("speakers"))).alias("metadata"),
    )
    return with_clusters(turns, "speakers").groupBy("cluster").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scores_corpus, scores_by_flag, scores_grouping_sets, scores_by_type, span_projection, annotation_violations, bootstrap,
        normalized_documents, token_counts, wer_by_role, edit_distances, detected_terms, number_words, slot_values,
        group_labels, speaker_clusters,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the template corpus by group."""
    return with_rates(group_counts(template_results(spark, sf_dir).select("*", F.get_json_object("metadata", "$.flag").alias("flag")), "flag"))


# SQL ------------------------------------------------------------------------

_NORMALIZED = r"""trim(regexp_replace(translate(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    translate(lower({text}), '/', chr(57344)), '(\d)\.(\d)', '\1' || chr(57345) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(57345) || '\2', 'g'),
    '(\d),(\d)', '\1' || chr(57346) || '\2', 'g'), '(\d),(\d)', '\1' || chr(57346) || '\2', 'g'),
    '(\d):(\d)', '\1' || chr(57347) || '\2', 'g'), '(\d):(\d)', '\1' || chr(57347) || '\2', 'g'),
    '(^|\s)-(\d)', '\1' || chr(57348) || '\2', 'g'), '\pP', ' ', 'g'),
    chr(57344) || chr(57345) || chr(57346) || chr(57347) || chr(57348), '/.,:-'), '\s+', ' ', 'g'))"""


def _tokens(text: str) -> str:
    return f"list_filter(string_split({_NORMALIZED.format(text=text)}, ' '), lambda t: t <> '')"


#: What each error class does to the sums; classes without an entry are perfect.
_BY_CLASS = {
    "substitutions": {1: 1, 2: 1, 4: 1, 7: 1}, "deletions": {3: 2, 6: 1}, "insertions": {5: 2},
    "hits": {1: 8, 2: 8, 3: 7, 4: 8, 6: 8, 7: 8}, "medical_substitutions": {2: 1}, "medical_insertions": {5: 1},
    "entity_tp": {2: 2}, "entity_fp": {2: 1, 5: 1}, "entity_fn": {2: 1},
    "critical_tp": {1: 2, 2: 2, 3: 2, 6: 2, 7: 2}, "critical_fp": {1: 1, 2: 1, 6: 1, 7: 1}, "critical_fn": {1: 1, 2: 1, 3: 1, 6: 1, 7: 1},
}
_PERFECT = {"hits": 9, "reference_word_count": 9, "medical_reference_word_count": 3, "entity_tp": 3, "critical_tp": 3}


def _sum(name: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _BY_CLASS.get(name, {-1: 0}).items())
    return f"CAST(sum(CASE c {cases} ELSE {_PERFECT.get(name, 0)} END) AS BIGINT) AS {name}"


_CLASSES = "(SELECT *, (l_orderkey + l_linenumber) % 8 AS c FROM lineitem)"
_RATES_SQL = """round((substitutions + deletions + insertions) / CAST(reference_word_count AS DOUBLE), 9) AS wer,
 round((medical_substitutions + medical_deletions + medical_insertions) / CAST(medical_reference_word_count AS DOUBLE), 9) AS mt_wer,
 round(entity_tp / CAST(entity_tp + entity_fp AS DOUBLE), 9) AS entity_precision, round(entity_tp / CAST(entity_tp + entity_fn AS DOUBLE), 9) AS entity_recall,
 round(2 * entity_tp / CAST(2 * entity_tp + entity_fp + entity_fn AS DOUBLE), 9) AS entity_f1,
 round(critical_tp / CAST(critical_tp + critical_fp AS DOUBLE), 9) AS critical_precision, round(critical_tp / CAST(critical_tp + critical_fn AS DOUBLE), 9) AS critical_recall,
 round(2 * critical_tp / CAST(2 * critical_tp + critical_fp + critical_fn AS DOUBLE), 9) AS critical_f1,
 round(critical_tp / CAST(critical_tp + critical_fn AS DOUBLE), 9) AS critical_accuracy"""


def _scores(keys: str = "", source: str = _CLASSES) -> str:
    lead = f"{keys}, " if keys else ""
    names = ", ".join(k.split(" AS ")[-1] for k in keys.split(", ")) + ", " if keys else ""
    group = f" GROUP BY {', '.join(k.split(' AS ')[0] for k in keys.split(', '))}" if keys else ""
    inner = f"SELECT {lead}{', '.join(map(_sum, COUNTED))} FROM {source}{group}"
    return f"SELECT {names}{', '.join(COUNTED)}, {_RATES_SQL} FROM ({inner})"


_PER_TYPE = {
    ("entity", "MEDICATION"): ({2: 0}, {2: 1, 5: 1}, {2: 1}), ("entity", "SYMPTOM"): ({}, {}, {}), ("entity", "ANATOMY"): ({}, {}, {}),
    ("critical", "DOSE"): ({1: 0, 2: 0, 3: 0}, {1: 1, 2: 1}, {1: 1, 2: 1, 3: 1}),
    ("critical", "NEGATION"): ({6: 0}, {6: 1}, {6: 1}), ("critical", "LATERALITY"): ({7: 0}, {7: 1}, {7: 1}),
}


def _type_sql() -> str:
    def total(cases: dict, other: int) -> str:
        return f"CAST(sum(CASE c {' '.join(f'WHEN {k} THEN {v}' for k, v in (cases or {-1: 0}).items())} ELSE {other} END) AS BIGINT)"

    rows = [
        f"SELECT '{f}' AS family, '{t}' AS type, {total(tp, 1)} AS tp, {total(fp, 0)} AS fp, {total(fn, 0)} AS fn FROM {_CLASSES}"
        for (f, t), (tp, fp, fn) in _PER_TYPE.items()
    ]
    return (
        "SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, "
        f"round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM ({' UNION ALL '.join(rows)})"
    )


_HEARD = f"""SELECT conv_id, turn, role, t, list_filter(list_transform(t, lambda x, i:
    CASE WHEN (i - 1) % 7 = 3 THEN '' WHEN (i - 1) % 11 = 5 THEN '{NOVEL}' ELSE x END), lambda x: x <> '') AS h
    FROM (SELECT *, {_tokens("text")} AS t FROM conversations)"""

_SMALL_SQL = (
    "('null',0),('ein',1),('eins',1),('eine',1),('einen',1),('zwei',2),('drei',3),('vier',4),('fünf',5),('sechs',6),('sieben',7),"
    "('acht',8),('neun',9),('zehn',10),('elf',11),('zwölf',12),('dreizehn',13),('vierzehn',14),('fünfzehn',15),('sechzehn',16),"
    "('siebzehn',17),('achtzehn',18),('neunzehn',19),('zwanzig',20),('dreißig',30),('dreissig',30),('vierzig',40),('fünfzig',50),"
    "('sechzig',60),('siebzig',70),('achtzig',80),('neunzig',90)"
)

def _bootstrap_sql(resamples: int = 200, seed: int = 7) -> str:
    a, b, c, d = resample.FACTORS
    p = resample.PRIME
    times = " + ".join(f"CAST(x >= {step} AS BIGINT)" for step in resample.poisson_steps())
    counts = ", ".join(_sum(f"critical_{x}") for x in ("tp", "fp", "fn"))
    rate = "2 * sum({0}critical_tp) / CAST(sum({0}(2 * critical_tp + critical_fp + critical_fn)) AS DOUBLE)"
    return f"""WITH clusters AS (SELECT min(((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 1024 + l_suppkey) AS k, {counts}
          FROM {_CLASSES} GROUP BY l_suppkey),
        first AS (SELECT *, (k % {p} * {a} + (r + 1) * {b} + {seed * c}) % {p} AS x FROM clusters, (SELECT unnest(range({resamples})) AS r)),
        second AS (SELECT * REPLACE ((x * x % {p} + x * {d}) % {p} AS x) FROM first),
        drawn AS (SELECT * REPLACE ((x * x % {p} + x * {a}) % {p} AS x) FROM second),
        rates AS (SELECT r, {rate.format("n * ")} AS f FROM (SELECT *, {times} AS n FROM drawn) GROUP BY r HAVING sum(n) > 0)
        SELECT 'critical_f1' AS metric, round((SELECT {rate.format("")} FROM clusters), 9) AS estimate, round(quantile_cont(f, 0.025), 9) AS lower,
          round(quantile_cont(f, 0.975), 9) AS upper, CAST({resamples} AS BIGINT) AS n_resamples, 'speaker' AS cluster_by FROM rates"""


ORACLE_SQL = {
    "scores_corpus": _scores(),
    "bootstrap": _bootstrap_sql(),
    "scores_by_flag": _scores("l_returnflag AS label"),
    "scores_grouping_sets": " UNION ALL ".join(
        f"SELECT {g} AS group_by, {label} AS label, * EXCLUDE (k) FROM ({_scores(key + ' AS k')})"
        for g, label, key in (("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "'x'"), ("'flag'", "k", "l_returnflag"), ("'status'", "k", "l_linestatus"))
    ),
    "scores_by_type": _type_sql(),
    "span_projection": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id,
        CAST(CASE WHEN c = 3 THEN NULL WHEN c = 1 AND inner_words THEN 5 ELSE 3 END AS INTEGER) AS hyp_start,
        CAST(CASE WHEN c = 3 THEN NULL WHEN inner_words THEN 7 ELSE 5 END AS INTEGER) AS hyp_end
        FROM (SELECT *, (((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 1024 + l_suppkey) % 3 = 0 AS inner_words FROM {_CLASSES})""",
    "annotation_violations": """SELECT l_returnflag, rule, count(*) AS n FROM (SELECT l_returnflag,
        CASE l_orderkey % 7 WHEN 1 THEN 'ids' WHEN 2 THEN 'type' WHEN 3 THEN 'span' WHEN 4 THEN 'canonical' WHEN 5 THEN 'overlap' WHEN 6 THEN 'anchor' END AS rule
        FROM lineitem) WHERE rule IS NOT NULL GROUP BY ALL""",
    "normalized_documents": f"""SELECT doc_id, md5(t) AS normalized_md5, CAST(len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS BIGINT) AS n_tokens
        FROM (SELECT doc_id, {_NORMALIZED.format(text="text")} AS t FROM documents)""",
    "token_counts": f"""SELECT lang, source, count(*) AS n_documents, CAST(sum(len({_tokens("text")})) AS BIGINT) AS n_tokens FROM documents GROUP BY ALL""",
    "wer_by_role": f"""SELECT role, errors, words, hypothesis_words, round(errors / CAST(words AS DOUBLE), 9) AS wer FROM (SELECT role,
        CAST(sum(len(t) - len(h) + len(list_filter(h, lambda x: x = '{NOVEL}'))) AS BIGINT) AS errors, CAST(sum(len(t)) AS BIGINT) AS words,
        CAST(sum(len(h)) AS BIGINT) AS hypothesis_words FROM ({_HEARD}) GROUP BY role)""",
    "edit_distances": f"""WITH items AS (SELECT item_id, {_tokens("text")} AS t FROM benchmark)
        SELECT a.item_id, CAST(list_extract(list_reduce(list_transform(a.t, lambda w: [w]), lambda row, w:
            list_reduce(list_transform(range(1, len(b.t) + 1), lambda j: [CAST(j AS VARCHAR)]),
                lambda made, j: list_append(made, CAST(least(
                    CAST(row[CAST(j[1] AS BIGINT) + 1] AS BIGINT) + 1, CAST(made[-1] AS BIGINT) + 1,
                    CAST(row[CAST(j[1] AS BIGINT)] AS BIGINT) + CASE WHEN b.t[CAST(j[1] AS BIGINT)] = w[1] THEN 0 ELSE 1 END) AS VARCHAR)),
                [CAST(CAST(row[1] AS BIGINT) + 1 AS VARCHAR)]),
            list_transform(range(0, len(b.t) + 1), lambda x: CAST(x AS VARCHAR))), -1) AS BIGINT) AS distance
        FROM items a JOIN items b ON b.item_id = a.item_id + 1""",
    "detected_terms": f"""WITH w AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {_tokens("text")} AS t FROM conversations)),
        x AS (SELECT t[i] AS a, t[i + 1] AS b, CASE WHEN i > 1 THEN t[i - 1] END AS p FROM w)
        SELECT canonical, count(*) AS n FROM (SELECT CASE WHEN a = 'of' AND b = 'the' THEN 'of the' WHEN a = 'de' AND b = 'la' THEN 'de la'
            WHEN a = 'the' AND coalesce(p, '') <> 'of' THEN 'the' WHEN a = 'of' THEN 'of' WHEN a = 'la' AND coalesce(p, '') <> 'de' THEN 'la' END AS canonical FROM x)
        WHERE canonical IS NOT NULL GROUP BY canonical""",
    "number_words": f"""WITH small(w, n) AS (VALUES {_SMALL_SQL}),
        digits AS (SELECT * FROM small WHERE n BETWEEN 1 AND 9),
        low AS (SELECT * FROM small UNION ALL SELECT d.w || 'und' || t.w, d.n + t.n FROM digits d, small t WHERE t.n >= 20 AND t.n % 10 = 0),
        rest AS (SELECT * FROM low UNION ALL SELECT '', 0),
        hundreds AS (SELECT d.w || 'hundert' || r.w AS w, 100 * d.n + r.n AS n FROM (SELECT * FROM digits UNION ALL SELECT '', 1) d, rest r),
        thousands AS (SELECT d.w || 'tausend' || r.w AS w, 1000 * d.n + r.n AS n FROM (SELECT * FROM digits UNION ALL SELECT '', 1) d,
            (SELECT * FROM rest UNION ALL SELECT * FROM hundreds) r)
        SELECT CAST(n // 1000 AS BIGINT) AS thousands, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, CAST(sum(length(w)) AS BIGINT) AS letters,
          CAST(sum(lines) AS BIGINT) AS lines
        FROM (SELECT * FROM low UNION ALL SELECT * FROM hundreds UNION ALL SELECT * FROM thousands)
          JOIN (SELECT l_partkey % 10000 AS n, count(*) AS lines FROM lineitem GROUP BY 1) USING (n) GROUP BY n // 1000""",
    "slot_values": """WITH q AS (SELECT CAST(l_quantity AS INTEGER) AS n FROM lineitem), v AS (
        SELECT n || ' mg' AS span, 'DOSE' AS kind, '{"value": ' || n || ', "unit": "mg"}' AS value FROM q
        UNION ALL SELECT n || ',5 Prozent', 'LAB_VALUE', '{"value": ' || n || '.5, "unit": "%"}' FROM q
        UNION ALL SELECT 'alle ' || n || ' stunden', 'FREQUENCY', '"every_' || n || 'h"' FROM q
        UNION ALL SELECT '0' || n || '/80', 'VITAL_VALUE', '"' || n || '/80"' FROM q
        UNION ALL SELECT CAST(n AS VARCHAR), 'DOSE', NULL FROM q)
        SELECT span, kind, count(*) AS n, max(value) AS value FROM v GROUP BY span, kind""",
    "group_labels": """SELECT coalesce(json_extract_string(props, '$.k'), '<missing>') AS label, min(event_id) AS first, count(*) AS hits FROM events GROUP BY 1""",
    "speaker_clusters": """SELECT min(conv_id * 1000 + turn) AS cluster, count(*) AS n FROM conversations GROUP BY conv_id // 3""",
}
