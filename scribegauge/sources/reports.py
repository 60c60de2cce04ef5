"""Report renderings and writers."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from ..functions.rates import prf, rates_of
from ..functions.schemas import COUNT_FIELDS, PRF_FIELDS, VERSION_FIELDS

#: Columns of the CSV report, in order.
CSV_FIELDS = (
    "scope", "sample_id", "group_by", "group", *COUNT_FIELDS, "wer", "mt_wer",
    "entity_tp", "entity_fp", "entity_fn", "entity_precision", "entity_recall", "entity_f1",
    "critical_tp", "critical_fp", "critical_fn", "critical_accuracy", "critical_precision", "critical_recall", "critical_f1",
)
ABSENT = "∅"


def _prf_dict(tp: int, fp: int, fn: int) -> dict:
    return {"tp": tp, "fp": fp, "fn": fn} | prf(tp, fp, fn)


def _loaded(text: str | None) -> Any:
    return None if text is None else json.loads(text)


def entity_match_dict(match: dict) -> dict:
    extra = match["status"] == "FP"
    return {k: v for k, v in match.items() if not (extra and k in ("reference", "reference_canonical"))}


def slot_match_dict(match: dict) -> dict:
    out = match | {"hypothesis_canonical": _loaded(match.get("hypothesis_canonical"))}
    if match["status"] == "FP":
        return {k: v for k, v in out.items() if k not in ("reference", "reference_canonical", "anchor_entity_id", "anchor_correct")}
    out["reference_canonical"] = _loaded(match.get("reference_canonical"))
    return {k: v for k, v in out.items() if k not in ("anchor_start", "anchor_end")}


def result_dict(row: dict, per_type: Iterable[dict] = (), include_alignment: bool = False) -> dict:
    """A result with its counts, rates, per-type counts, matches and versions."""
    counts = {c: row[c] for c in (*COUNT_FIELDS, *PRF_FIELDS)}
    out = {c: row[c] for c in COUNT_FIELDS}
    for family, name in (("entity", "entities"), ("critical", "critical")):
        out[name] = _prf_dict(*(row[f"{family}_{x}"] for x in ("tp", "fp", "fn")))
    for family, name in (("entity", "per_entity_type"), ("critical", "per_slot_type")):
        out[name] = {t["type"]: _prf_dict(t["tp"], t["fp"], t["fn"]) for t in per_type if t["family"] == family}
    out["entity_matches"] = [entity_match_dict(m) for m in row.get("entity_matches") or []]
    out["critical_matches"] = [slot_match_dict(m) for m in row.get("critical_matches") or []]
    out["versions"] = {v: row.get(v) for v in VERSION_FIELDS}
    if include_alignment and row.get("alignment") is not None:
        out["alignment"] = {
            "reference_tokens": row["ref_tokens"], "hypothesis_tokens": row["hyp_tokens"], "token_alignments": row["alignment"],
        }
    return out | {c: counts[c] for c in PRF_FIELDS} | rates_of(counts)


def write_json(data: Any, path: str) -> None:
    Path(path).write_text(render_json(data) + "\n", encoding="utf-8")


def render_json(data: Any) -> str:
    return json.dumps(data, ensure_ascii=False, indent=2, allow_nan=False)


def write_csv(rows: Iterable[dict], path: str) -> None:
    with Path(path).open("w", encoding="utf-8", newline="") as out:
        writer = csv.DictWriter(out, CSV_FIELDS, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)


def render_alignment(row: dict) -> str:
    """Readable view of one sample's alignment and matches."""
    if row.get("alignment") is None:
        raise ValueError("a view of the alignment needs a single sample's result")
    ref, hyp, rates = row["ref_tokens"], row["hyp_tokens"], rates_of(row)

    def side(tokens: list[str], at: int | None) -> str:
        return ABSENT if at is None else tokens[at]

    head = [f"REF: {' '.join(ref)}", f"HYP: {' '.join(hyp)}", f"WER: {rates['wer']:.6f}  MT-WER: {rates['mt_wer']:.6f}", "", "TOKENS:"]
    steps = [
        f"  R{s['ref_index']!s:>4} {side(ref, s['ref_index'])} -> H{s['hyp_index']!s:>4} {side(hyp, s['hyp_index'])} [{s['operation']}]"
        for s in row["alignment"]
    ]
    medical = " ".join(f"{k}={row['medical_' + k]}" for k in ("substitutions", "deletions", "insertions"))
    medical = ["\nMEDICAL TOKEN ERRORS:", f"  {medical} reference_tokens={row['medical_reference_word_count']}"]
    blocks = [
        line
        for title, matches in (
            ("ENTITY", map(entity_match_dict, row["entity_matches"])), ("CRITICAL", map(slot_match_dict, row["critical_matches"])),
        )
        for line in [f"\n{title}:", *(text for m in matches for text in _match_lines(m))]
    ]
    return "\n".join([*head, *steps, *medical, *blocks])


def _match_lines(match: dict) -> list[str]:
    owner = match.get("anchor_entity_id")
    anchor = f" anchor={owner}" if owner is not None else ""
    name = match.get("reference_id") or "extra"
    said = f"{match.get('reference', ABSENT)} -> {match.get('hypothesis') or ABSENT}"
    return [
        f"  {name} {match['type']}{anchor}: {said} [{match['status']}]",
        f"    canonical: {match.get('reference_canonical')} -> {match.get('hypothesis_canonical')}",
    ]
