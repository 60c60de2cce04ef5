"""Integrity checks of samples and annotations.

The checks are built-in expressions over typed annotations: the ``_fault``
columns give the first message in a fixed order, which strict scoring reports,
and :func:`violation_column` the codes of all structural rules, for filtering or
quarantine.  :func:`annotation_faults` checks plain records on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import SCHEMA_VERSION, VERSION_FIELDS
from ..functions.text import Tokenizer
from .readings import let
from .values import quoted


def annotation_faults(
    entities: list[dict], slots: list[dict], ref_tokens: list[str], tokenizer: Tokenizer, surfaces: bool = True, overlaps: bool = False
) -> Iterator[str]:
    seen: set[str] = set()
    for item in [*entities, *slots]:
        name, start, end = item["id"], item["ref_start"], item["ref_end"]
        if not isinstance(name, str) or not name or name in seen:
            yield f"annotation id must be non-empty and unique: {name!r}"
        seen.add(name)
        if not isinstance(item["type"], str) or not item["type"]:
            yield f"{name}: type must be a non-empty string"
        if type(start) is not int or type(end) is not int or not 0 <= start < end <= len(ref_tokens):
            yield f"{name}: span must satisfy 0 <= start < end <= token count"
        elif not isinstance(item["surface"], str):
            yield f"{name}: surface must be text"
        elif surfaces and tokenizer(item["surface"]) != ref_tokens[start:end]:
            yield f"{name}: surface does not match normalized reference span"
    for entity in entities:
        if not isinstance(entity["canonical"], str) or not entity["canonical"]:
            yield f"{entity['id']}: entity canonical must be a non-empty string"
    if not overlaps:
        for a, b in pairwise(sorted(entities, key=lambda e: e["ref_start"])):
            if b["ref_start"] < a["ref_end"]:
                yield f"overlapping entities: {a['id']}, {b['id']}"
    known = {e["id"] for e in entities}
    for slot in slots:
        yield from _slot_faults(slot, known)


def _slot_faults(slot: dict, known: set[str]) -> Iterator[str]:
    name, kind, value = slot["id"], slot["type"], slot["canonical"]
    if slot["anchor_entity_id"] not in known:
        yield f"{name}: unknown anchor entity {slot['anchor_entity_id']!r}"
    if value is None:
        yield f"{name}: canonical value is required"
    if kind == "NEGATION" and not isinstance(value, bool):
        yield f"{name}: NEGATION canonical must be boolean"
    if kind == "LATERALITY" and value not in ("left", "right", "bilateral"):
        yield f"{name}: invalid LATERALITY canonical"
    if kind == "DOSE" and not (isinstance(value, dict) and {"value", "unit"} <= value.keys()):
        yield f"{name}: DOSE requires a value/unit object"


def first_message(messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m.isNotNull()), F.lit(0))


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def version_fault(expected: dict[str, str | None]) -> Column:
    """Message about the first version of a sample that scoring does not share."""
    found = F.when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), F.concat(F.lit("unsupported schema version "), quoted(F.col("schema_version"))))
    for name in VERSION_FIELDS[1:]:
        differs = F.col(name).isNotNull() & ~F.col(name).eqNullSafe(F.lit(expected[name]).cast("string"))
        found = found.when(differs, F.concat(F.lit(f"{name} "), quoted(F.col(name)), F.lit(" does not match scorer "), quoted(F.lit(expected[name]).cast("string"))))
    return found


def item_fault(items: Column, ref: Column, surfaces: Column | None) -> Column:
    """Message about the first entity or value with a bad id, type, span or surface.

    ``surfaces`` are the tokens of the items' surfaces, in order; null to leave them unchecked.
    """
    ids = F.transform(items, lambda x: x["id"])

    def message(x: Column, i: Column) -> Column:
        named = lambda text: F.concat(x["id"], F.lit(f": {text}"))
        span = F.coalesce((x["ref_start"] >= 0) & (x["ref_start"] < x["ref_end"]) & (x["ref_end"] <= F.size(ref)), F.lit(False))
        found = (
            F.when(_blank(x["id"]) | (F.array_position(ids, x["id"]) <= i), F.concat(F.lit("annotation id must be non-empty and unique: "), quoted(x["id"])))
            .when(_blank(x["type"]), named("type must be a non-empty string"))
            .when(~span, named("span must satisfy 0 <= start < end <= token count"))
            .when(x["surface"].isNull(), named("surface must be text"))
        )
        if surfaces is None:
            return found
        return found.when(F.get(surfaces, i) != F.slice(ref, x["ref_start"] + 1, x["ref_end"] - x["ref_start"]), named("surface does not match normalized reference span"))

    return first_message(F.transform(items, message))


def entity_fault(entities: Column, overlaps: bool) -> Column:
    """Message about the first entity without a meaning, or the first two that overlap."""
    nameless = first_message(F.transform(entities, lambda e: F.when(_blank(e["canonical"]), F.concat(e["id"], F.lit(": entity canonical must be a non-empty string")))))
    if overlaps:
        return nameless
    ordered = F.array_sort(F.transform(entities, lambda e, i: F.struct(e["ref_start"].alias("start"), i.alias("i"), e["ref_end"].alias("end"), e["id"].alias("id"))))

    def crossing(order: Column) -> Column:
        return first_message(F.transform(order, lambda e, i: F.when(
            (i > 0) & (F.get(order, i - 1)["end"] > e["start"]), F.concat(F.lit("overlapping entities: "), F.get(order, i - 1)["id"], F.lit(", "), e["id"])
        )))

    return F.coalesce(nameless, let(ordered, crossing))


def slot_fault(slots: Column, entities: Column, states: Column) -> Column:
    """Message about the first value with an unknown entity or a canonical form of another shape; ``states`` are those of :func:`canonical_state`."""
    known = F.transform(entities, lambda e: e["id"])

    def message(s: Column, i: Column) -> Column:
        unknown = ~F.coalesce(F.array_contains(known, s["anchor_entity_id"]), F.lit(False))
        return F.when(unknown, F.concat(s["id"], F.lit(": unknown anchor entity "), quoted(s["anchor_entity_id"]))).otherwise(
            F.concat(s["id"], F.lit(": "), F.get(states, i)["shape"])
        )

    return first_message(F.transform(slots, message))


def canonical_fault(slots: Column, states: Column) -> Column:
    """Message about the first value whose canonical form is invalid."""
    return first_message(F.transform(slots, lambda s, i: F.concat(s["id"], F.lit(": invalid canonical value: "), F.get(states, i)["fault"])))


def meaning_fault(entities: Column, ref: Column) -> Column:
    """Message about the first annotated words that an earlier entity gives another meaning."""
    said = F.transform(entities, lambda e: F.struct(
        F.array_join(F.slice(ref, e["ref_start"] + 1, e["ref_end"] - e["ref_start"]), " ").alias("words"),
        F.struct(e["canonical"].alias("c"), e["type"].alias("t"), F.coalesce(e["concept_id"], F.lit("")).alias("i")).alias("meaning"),
    ))

    def conflict(x: Column, i: Column) -> Column:
        other = F.exists(F.slice(said, 1, i), lambda y: (y["words"] == x["words"]) & (y["meaning"] != x["meaning"]))
        return F.when(other, F.concat(F.lit("conflicting dictionary entry: "), x["words"]))

    return first_message(F.transform(said, conflict))


def duplicate_ids(samples: DataFrame) -> DataFrame:
    """Sample ids that are null, empty or repeated, with their count."""
    counted = samples.groupBy("sample_id").agg(F.count("*").alias("n"))
    return counted.where((F.coalesce("sample_id", F.lit("")) == "") | (F.col("n") > 1))


def violation_column(ref_tokens: Column, entities: Column, slots: Column) -> Column:
    """``array<string>`` of the codes of violated structural rules, for typed annotation columns."""
    both = F.concat(F.transform(entities, lambda x: x["id"]), F.transform(slots, lambda x: x["id"]))
    spans = F.concat(*(F.transform(a, lambda x: F.struct(x["ref_start"].alias("s"), x["ref_end"].alias("e"))) for a in (entities, slots)))
    by_start = F.array_sort(F.transform(entities, lambda x: F.struct(x["ref_start"].alias("s"), x["ref_end"].alias("e"))))
    known = F.transform(entities, lambda x: x["id"])
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    rules = {
        "ids": (F.size(F.array_distinct(both)) != F.size(both)) | F.exists(both, empty),
        "type": F.exists(entities, lambda x: empty(x["type"])) | F.exists(slots, lambda x: empty(x["type"])),
        "span": F.exists(
            spans, lambda x: ~F.coalesce((x["s"] >= 0) & (x["s"] < x["e"]) & (x["e"] <= F.size(ref_tokens)), F.lit(False))
        ),
        "canonical": F.exists(entities, lambda x: empty(x["canonical"])) | F.exists(slots, lambda x: x["canonical"].isNull()),
        "overlap": F.exists(
            F.transform(by_start, lambda x, i: F.coalesce((i > 0) & (F.get(by_start, i - 1)["e"] > x["s"]), F.lit(False))), lambda x: x
        ),
        "anchor": F.exists(slots, lambda x: ~F.coalesce(F.array_contains(known, x["anchor_entity_id"]), F.lit(False))),
    }
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
