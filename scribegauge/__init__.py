"""Clinical transcript evaluation on Spark."""

import importlib

__version__ = "0.1.0"

#: Public names by module; they are imported when first used.
_NAMES = {
    "api": (
        "AlignmentResult Annotations BenchmarkSample CriticalSlotAnnotation EntityAnnotation Normalizer PRFCounts ProjectedSpan "
        "align default_transform load_dataset normalize_tokens project_span_of validate_annotations"
    ),
    "functions.schemas": "SCHEMA_VERSION",
    "functions.text": "NORMALIZATION_VERSION",
    "operators.lexicon": "Combined Lexicon Recognizer Term detect_terms terminology_keys",
    "operators.resample": "Interval bootstrap_interval with_clusters",
    "operators.scoring": "Canonicalizer GermanCanonicalizer Scorer score_samples",
    "operators.slotscan": "RuleSlots Slot SlotRecognizer",
    "plans.evaluation": "CorpusReport score_corpus score_sample",
    "sources.datasets": "from_records load_samples load_terminology",
    "sources.reports": "render_alignment",
}
_MODULE_OF = {name: module for module, names in _NAMES.items() for name in names.split()}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(name)
    return getattr(importlib.import_module(f".{_MODULE_OF[name]}", __name__), name)
