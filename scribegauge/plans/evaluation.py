"""Corpus evaluation: validate, score once, keep the results, sum them as asked."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import COUNT_FIELDS, PRF_FIELDS, RATE_FIELDS, VERSION_FIELDS
from ..operators.checks import duplicate_ids
from ..operators.resample import Interval, bootstrap_interval
from ..operators.rollup import corpus_counts, metadata_groups, type_counts
from ..operators.scoring import Scorer, score_samples
from ..sources import reports
from ..sources.datasets import from_records


class CorpusReport:
    """Lazy frames of an evaluation; the scored results are persisted and shared by all of them."""

    def __init__(self, results: DataFrame) -> None:
        self.results = results
        self.groups: dict[str, DataFrame] = {}

    @cached_property
    def corpus(self) -> DataFrame:
        return corpus_counts(self.results)

    @cached_property
    def types(self) -> DataFrame:
        return type_counts(self.results)

    def by_group(self, field: str) -> DataFrame:
        if field not in self.groups:
            self.groups[field] = metadata_groups(self.results, field)
        return self.groups[field]

    def bootstrap(self, **options) -> Interval:
        return bootstrap_interval(self.results, **options)

    # Documents for one reader; large corpora write the frames instead.

    def to_dict(self, include_alignment: bool = False) -> dict:
        import json

        samples = [r.asDict(recursive=True) for r in self.results.orderBy("ordinal").toLocalIterator()]
        return {
            "sample_count": len(samples),
            "metrics": reports.result_dict(self.corpus.first().asDict(), (r.asDict() for r in self.types.collect())),
            "groups": {f: self._group_dict(f, g) for f, g in self.groups.items()},
            "samples": [
                {
                    "sample_id": s["sample_id"], "metadata": json.loads(s["metadata"] or "{}"),
                    "metrics": reports.result_dict(s, s["per_type"], include_alignment),
                }
                for s in samples
            ],
        }

    def _group_dict(self, field: str, groups: DataFrame) -> dict:
        from ..operators.rollup import group_label

        marked = self.results.withColumn("label", group_label(field)["label"])
        types: dict[str, list[dict]] = {}
        for r in type_counts(marked, "label").collect():
            types.setdefault(r["label"], []).append(r.asDict())
        rows = groups.orderBy("first").collect()
        return {r["label"]: reports.result_dict(r.asDict(), types.get(r["label"], ())) for r in rows}

    def write_json(self, path: str, include_alignment: bool = False) -> None:
        reports.write_json(self.to_dict(include_alignment), path)

    def rows(self) -> DataFrame:
        """Corpus, sample and group rows of the CSV report as one frame, with ``rank`` and ``at`` to order by."""
        from ..functions.rates import with_rates

        numbers = [*COUNT_FIELDS, *PRF_FIELDS, *RATE_FIELDS]
        none = F.lit(None).cast("string")

        def part(df: DataFrame, scope: str, rank: int, at, sample=none, field=none, label=none) -> DataFrame:
            return df.select(
                F.lit(rank).alias("rank"), at.alias("at"), F.lit(scope).alias("scope"), sample.alias("sample_id"),
                field.alias("group_by"), label.alias("group"), *numbers,
            )

        out = part(self.corpus, "corpus", 0, F.lit(0).cast("long"))
        out = out.unionAll(part(with_rates(self.results), "sample", 1, F.col("ordinal"), sample=F.col("sample_id")))
        for i, (field, groups) in enumerate(self.groups.items()):
            out = out.unionAll(part(groups, "group", 2 + i, F.col("first"), field=F.lit(field), label=F.col("label")))
        return out

    def write_csv(self, path: str) -> None:
        rows = self.rows().orderBy("rank", "at").toLocalIterator()
        reports.write_csv(({k: v for k, v in r.asDict().items() if v is not None} for r in rows), path)

    def write_tables(self, path: str, form: str = "parquet") -> None:
        """The report as tables below ``path``, written by the executors: ``rows``, ``types`` and ``samples``."""
        for name, frame in (("rows", self.rows()), ("types", self.types), ("samples", self.results)):
            frame.write.format(form).save(f"{path}/{name}")

    def render(self, sample_id: str) -> str:
        found = self.results.where(F.col("sample_id") == sample_id).limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"expected one sample with id {sample_id!r}; found {len(found)}")
        return reports.render_alignment(found[0].asDict(recursive=True))


def score_corpus(
    samples: DataFrame | Iterable[dict], scorer: Scorer | None = None, group_by: str | None = None,
    strict: bool = True, include_alignment: bool = True, spark: SparkSession | None = None,
) -> CorpusReport:
    """Score a corpus.

    Strict evaluation raises the fault of the first faulty sample; otherwise
    faulty samples are left out and stay in ``report.rejected``.
    """
    if not isinstance(samples, DataFrame):
        samples = from_records(spark or SparkSession.active(), samples)
    repeated = duplicate_ids(samples).select("sample_id").orderBy("sample_id").first()
    if repeated:
        raise ValueError(f"sample id must be non-empty and unique: {repeated['sample_id']!r}")
    scored = score_samples(samples, scorer, include_alignment).persist(StorageLevel.MEMORY_AND_DISK)
    rejected = scored.where("error is not null")
    if strict:
        fault = rejected.orderBy("ordinal").select("error").first()
        if fault:
            scored.unpersist()
            raise ValueError(fault["error"])
    report = CorpusReport(scored.where("error is null"))
    report.rejected = rejected.select("sample_id", "ordinal", "error")
    if group_by:
        report.by_group(group_by)
    return report


def score_sample(reference: str, hypothesis: str, annotations: dict | None = None, **options) -> dict:
    """One sample by itself: counts, rates and matches; its fault is a ``ValueError``."""
    scorer = Scorer(**options)
    samples = from_records(SparkSession.builder.getOrCreate(), [{"sample_id": "sample", "reference": reference, "hypothesis": hypothesis, "annotations": annotations or {}}])
    row = score_samples(samples, scorer, include_alignment=True).first().asDict(recursive=True)
    if row["error"]:
        raise ValueError(row["error"].removeprefix("sample: "))
    return reports.result_dict(row, row["per_type"], include_alignment=True)


__all__ = ["CorpusReport", "VERSION_FIELDS", "score_corpus", "score_sample"]
