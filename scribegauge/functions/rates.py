"""Rates from summed counts, as Columns and for plain numbers.

Empty denominators: an error rate without reference tokens is the number of
errors; precision with nothing predicted is 1 if nothing was missed, else 0;
recall with nothing to find is 1; F1 of all zeros is 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_rate(errors: Column, words: Column) -> Column:
    return F.when(words > 0, errors / words).otherwise(errors.cast("double"))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    both = 2 * tp + fp + fn
    return F.when(both > 0, 2 * tp / both).otherwise(F.lit(1.0))


def with_rates(df):
    """Add every derived rate to a frame of summed counts."""
    c = F.col
    found: dict[str, Column] = {
        "wer": error_rate(c("substitutions") + c("deletions") + c("insertions"), c("reference_word_count")),
        "mt_wer": error_rate(
            c("medical_substitutions") + c("medical_deletions") + c("medical_insertions"), c("medical_reference_word_count")
        ),
    }
    for family in ("entity", "critical"):
        tp, fp, fn = (c(f"{family}_{x}") for x in ("tp", "fp", "fn"))
        found |= {f"{family}_precision": precision(tp, fp, fn), f"{family}_recall": recall(tp, fn), f"{family}_f1": f1(tp, fp, fn)}
    found["critical_accuracy"] = found["critical_value_accuracy"] = found["critical_value_recall"] = found["critical_recall"]
    return df.withColumns(found)


def ratio(count: int, total: int, empty: float) -> float:
    return count / total if total else empty


def rates_of(counts: dict) -> dict[str, float]:
    """The same rates for one dictionary of counts."""
    out = {}
    for name, prefix in (("wer", ""), ("mt_wer", "medical_")):
        errors = sum(counts[prefix + k] for k in ("substitutions", "deletions", "insertions"))
        out[name] = ratio(errors, counts[prefix + "reference_word_count"], float(errors))
    for family in ("entity", "critical"):
        out |= {f"{family}_{k}": v for k, v in prf(*(counts[f"{family}_{x}"] for x in ("tp", "fp", "fn"))).items()}
    out["critical_accuracy"] = out["critical_value_accuracy"] = out["critical_value_recall"] = out["critical_recall"]
    return out


def prf(tp: int, fp: int, fn: int) -> dict[str, float]:
    return {
        "precision": ratio(tp, tp + fp, 0.0 if fn else 1.0),
        "recall": ratio(tp, tp + fn, 1.0),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, 1.0),
    }
