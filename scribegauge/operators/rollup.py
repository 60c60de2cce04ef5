"""Sums of sample results: corpus, groups, types.  Counts are summed, rates come once at the end.

A row with ``n_samples`` stands for that many samples of the same result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import f1, precision, recall, with_rates
from ..functions.schemas import COUNT_FIELDS, PRF_FIELDS, VERSION_FIELDS
from ..functions.values import canonical_json

MISSING = "<missing>"


def sums(times: Column | None = None) -> list[Column]:
    """Summed counts, each multiplied by ``times`` if given."""
    return [F.coalesce(_total(c, times), F.lit(0)).cast("long").alias(c) for c in (*COUNT_FIELDS, *PRF_FIELDS)]


def _total(name: str, times: Column | None) -> Column:
    return F.sum(F.col(name) if times is None else F.col(name) * times)


def _times(results: DataFrame) -> Column | None:
    return F.col("n_samples") if "n_samples" in results.columns else None


def version_guard() -> list[Column]:
    """Whether all versions are alike, by the least and the greatest of them, which needs no shuffle of its own; an absent version is one by itself."""
    versions = F.struct(*(F.struct(F.col(v).isNull().alias("absent"), F.col(v).alias("version")) for v in VERSION_FIELDS))
    return [(~F.min(versions).eqNullSafe(F.max(versions))).alias("_mixed")]


def _versions() -> list[Column]:
    return [F.first(v).alias(v) for v in VERSION_FIELDS]


def guarded(df: DataFrame) -> DataFrame:
    mixed = F.raise_error(F.lit("cannot aggregate results of different benchmark versions"))
    return df.where(F.when(F.col("_mixed"), mixed.cast("boolean")).otherwise(F.lit(True))).drop("_mixed")


def corpus_counts(results: DataFrame) -> DataFrame:
    """One row of summed counts and rates; no results give all zeros."""
    return with_rates(guarded(results.agg(*sums(_times(results)), *version_guard(), *_versions())))


def group_counts(results: DataFrame, *by: Column | str) -> DataFrame:
    """Summed counts and rates by native columns, in one shuffle with map-side sums."""
    return with_rates(guarded(results.groupBy(*by).agg(*sums(_times(results)), *version_guard())))


def grouping_sets(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Corpus and every single column's groups in one pass: ``group_by, label`` and the sums.

    The corpus row has a null ``group_by``.
    """
    labels = F.array(
        F.struct(F.lit(None).cast("string").alias("group_by"), F.lit(None).cast("string").alias("label")),
        *(F.struct(F.lit(c).alias("group_by"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("label")) for c in columns),
    )
    return group_counts(results.select("*", F.inline(labels)), "group_by", "label")


def type_counts(results: DataFrame, *by: Column | str) -> DataFrame:
    """``family, type, tp, fp, fn`` and rates over all results (or by group)."""
    times = _times(results)
    weight = [] if times is None else ["n_samples"]
    events = results.select(*by, *VERSION_FIELDS, *weight, F.inline("per_type"))
    names = [c for c in events.columns if c not in ("tp", "fp", "fn", *weight, *VERSION_FIELDS)]
    out = guarded(events.groupBy(*names).agg(*(_total(x, times).alias(x) for x in ("tp", "fp", "fn")), *version_guard()))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": precision(tp, fp, fn), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def group_label(field: str):
    """Column function from metadata JSON to ``struct<label, identity>``.

    A string is its own label; an absent field is ``<missing>``; any other
    value is its canonical JSON.  ``identity`` tells equal labels of different
    values apart.
    """

    @F.pandas_udf("label string, identity string")
    def label(metadata: pd.Series) -> pd.DataFrame:
        rows = []
        for text in metadata:
            data = json.loads(text) if text else {}
            if field not in data:
                rows.append((MISSING, "absent"))
                continue
            value = canonical_json(data[field])
            rows.append((data[field] if isinstance(data[field], str) else value, "json " + value))
        return pd.DataFrame(rows, columns=["label", "identity"])

    return label(F.col("metadata"))


#: A string or number of JSON that is its own text, and a member of an object that has one as its value.
_TEXT = r'"[^"\\\x00-\x1f]*"'
_PLAIN = rf"(?:{_TEXT}|-?(?:0|[1-9][0-9]*)|true|false|null)"


def only_field(field: str) -> Column:
    """Metadata without all but one field, where it is a plain object with that field once; other metadata as it is.

    Samples then meet by what :func:`group_label` reads of them.
    """
    key = json.dumps(field, ensure_ascii=False)
    if "\\" in key:
        return F.col("metadata")
    name = r"\Q" + key + r"\E"
    other = rf"(?!{name}){_TEXT}[ ]?:[ ]?{_PLAIN}"
    whole = rf"\A\{{(?:{other},[ ]?)*+({name}[ ]?:[ ]?{_PLAIN})(?:,[ ]?{other})*+\}}\z"
    return F.regexp_replace("metadata", whole, "{$1}")


def metadata_groups(results: DataFrame, field: str) -> DataFrame:
    """Sums and rates by a metadata field: ``label`` and ``first`` (ordinal of its first sample)."""
    marked = results.withColumn("_label", group_label(field))
    summed = marked.groupBy(F.col("_label.label").alias("label")).agg(
        F.min("ordinal").alias("first"), F.min("_label.identity").alias("_low"), F.max("_label.identity").alias("_high"),
        *sums(_times(results)), *version_guard(), *_versions(),
    )
    clash = F.raise_error(F.concat(F.lit(f"metadata group labels collide for {field}: "), F.col("label")))
    checked = summed.withColumn("_clash", F.when(F.col("_low") != F.col("_high"), clash).otherwise(F.lit(None).cast("string")))
    return with_rates(guarded(checked.where(F.col("_clash").isNull()).drop("_clash", "_low", "_high")))
