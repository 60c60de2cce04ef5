"""Scoring of samples: one result row per sample, without a shuffle (:func:`score_samples`).

Tokens, terms, spans, values and their matching are expressions over the row
(``matching``, ``readings``, ``values``); the alignment is an Arrow function.
Plug-ins answer questions of the same plan, batch by batch: tokens of texts,
terms of a transcript, meanings of spans, values near terms.  Everything that
adds samples up is relational (``rollup``).

Where samples repeat, :func:`score_distinct` scores each content once and joins
the results back to all samples, and :func:`score_counted` counts equal samples
for runs that only sum up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.text import NORMALIZATION_VERSION, Tokenizer, checked_tokenizer, normalize_text
from ..functions.values import NUMERIC_TYPES, Quantity, Value, canonical_json, plain, read_value, typed_value
from ..runtime import checkpointed
from . import matching as m
from .checks import canonical_fault, entity_fault, item_fault, meaning_fault, slot_fault, version_fault
from .lexicon import Combined, Lexicon, Recognizer, Term, term_hits, whole_term
from .matching import count_if, staged
from .readings import built_once, json_text, let, readings, span_value, words_text
from .slotscan import RuleSlots, SlotRecognizer
from .values import canonical_state
from .wordalign import LINKS, linked, with_alignment


class Canonicalizer(Protocol):
    """Meaning of spans and values; plug-ins must be picklable."""

    def entity(self, tokens: list[str], entity_type: str, recognizer: Recognizer) -> str | None: ...
    def slot(self, tokens: list[str], slot_type: str) -> Any: ...
    def typed(self, value: Any, slot_type: str) -> Any: ...


class GermanCanonicalizer:
    """Exact equivalences of German clinical language; nothing fuzzy."""

    def entity(self, tokens: list[str], entity_type: str, recognizer: Recognizer) -> str | None:
        term = whole_term(recognizer, tokens) if tokens else None
        return term.canonical if term is not None and term.type == entity_type else None

    def slot(self, tokens: list[str], slot_type: str) -> Value | None:
        return read_value(tokens, slot_type)

    def typed(self, value: Any, slot_type: str) -> Value:
        return typed_value(value, slot_type)


@dataclass
class Scorer:
    """Options of scoring; picklable, so plug-ins reach the executors."""

    tokenizer: Tokenizer | None = None
    recognizer: Recognizer | None = None
    canonicalizer: Canonicalizer = field(default_factory=GermanCanonicalizer)
    slot_recognizer: SlotRecognizer | None = None
    normalization_version: str | None = None
    terminology_version: str | None = None
    annotation_guideline_version: str | None = None
    require_entity_type: bool = True
    check_surfaces: bool = True
    allow_overlapping_entities: bool = False

    def __post_init__(self) -> None:
        if self.tokenizer is not None and not self.normalization_version:
            raise ValueError("a custom tokenizer needs an explicit normalization_version")
        self.normalization_version = self.normalization_version or NORMALIZATION_VERSION

    @property
    def versions(self) -> dict[str, str | None]:
        return {"schema_version": schemas.SCHEMA_VERSION} | {v: getattr(self, v) for v in schemas.VERSION_FIELDS[1:]}

    @property
    def own_meanings(self) -> bool:
        """Whether meanings of spans are asked of a plug-in."""
        return type(self.canonicalizer) is not GermanCanonicalizer or not isinstance(self.recognizer, (Lexicon, type(None)))

    @property
    def own_values(self) -> bool:
        """Whether values are asked of a plug-in."""
        return type(self.canonicalizer) is not GermanCanonicalizer or self.slot_recognizer is not None


# Plug-ins ------------------------------------------------------------------------


def answered(returns: str, answer: Callable[..., Any]) -> Callable[..., Column]:
    """A function of columns that asks a plug-in, row by row; its faults come back as ``error`` beside ``found``."""

    def one(*row: Any) -> dict:
        try:
            return {"found": answer(*(_plain_data(x) for x in row)), "error": None}
        except (ValueError, TypeError) as error:
            return {"found": None, "error": str(error)}

    @F.pandas_udf(f"struct<found:{returns},error:string>")
    def run(first: pd.Series, *more: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(first, *more)], columns=["found", "error"])

    return run


def _plain_data(value: Any) -> Any:
    """Arrays of Arrow as lists."""
    if isinstance(value, dict):
        return {k: _plain_data(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    return [_plain_data(v) for v in value] if isinstance(value, list) else value


def _own_lexicon(entries: list[dict]) -> Lexicon:
    return Lexicon(({k: e[k] for k in ("surface", "canonical", "type", "concept_id")} for e in entries), str.split)


def plugin_key(value: Any) -> str | None:
    """The key of a value that a plug-in gave."""
    return None if value is None else "j:" + canonical_json(plain(value))


def _asked_terms(scorer: Scorer, hyp: Column) -> Column:
    def extract(words: list[str]) -> list[dict]:
        found = scorer.recognizer.extract(words)
        for term in found:
            if not 0 <= term.start < term.end <= len(words):
                raise ValueError(f"recognizer returned an invalid span: {term}")
        return [{"start": t.start, "end": t.end, "canonical": t.canonical, "type": t.type, "concept_id": t.concept_id} for t in found]

    return answered(f"array<{m.TERM}>", extract)(hyp)


def _asked_meanings(scorer: Scorer, hyp: Column, spans: Column, types: Column, own: Column) -> Column:
    def means(words: list[str], spans: list[dict], types: list[str], own: list[dict]) -> list[dict]:
        lexicon = _own_lexicon(own)
        recognizer = Combined(scorer.recognizer, lexicon) if scorer.recognizer else lexicon
        asked = [(s["start"], s["end"], kind) for s in spans for kind in types]
        found = [(s, e, kind, scorer.canonicalizer.entity(words[s:e], kind, recognizer)) for s, e, kind in asked]
        return [dict(zip(("start", "end", "type", "canonical"), f)) for f in found]

    return answered("array<struct<start:int,end:int,type:string,canonical:string>>", means)(hyp, spans, types, own)


def _asked_expected(scorer: Scorer, slots: Column) -> Column:
    def typed(slots: list[dict]) -> list[str | None]:
        out = []
        for slot in slots:
            try:
                out.append(plugin_key(scorer.canonicalizer.typed(json.loads(slot["canonical"]), slot["type"])))
            except (ValueError, TypeError) as error:
                raise ValueError(f"{slot['id']}: invalid canonical value: {error}") from error
        return out

    return answered("array<string>", typed)(slots)


def _asked_slots(scorer: Scorer, hyp: Column, anchors: Column, slots: Column) -> Column:
    recognizer = scorer.slot_recognizer or RuleSlots(scorer.canonicalizer.slot)

    def as_kind(value: Any, kind: str) -> str | None:
        try:
            return plugin_key(scorer.canonicalizer.typed(value, kind))
        except ValueError:
            return None

    def extract(words: list[str], anchors: list[dict], slots: list[dict]) -> list[dict]:
        terms = [Term(a["start"], a["end"], " ".join(words[a["start"] : a["end"]]), a["canonical"], a["type"], a["concept_id"]) for a in anchors]
        places, kinds, out = {(t.start, t.end) for t in terms}, {s["type"] for s in slots}, []
        for s in recognizer.extract(words, terms):
            if not 0 <= s.start < s.end <= len(words) or (s.anchor_start, s.anchor_end) not in places:
                raise ValueError(f"slot recognizer returned an invalid span or anchor: {s}")
            key = plugin_key(scorer.canonicalizer.typed(s.canonical, s.type))
            related = {k for k in kinds if k == s.type or {k, s.type} <= NUMERIC_TYPES}
            out.append({
                "start": s.start, "end": s.end, "anchor_start": s.anchor_start, "anchor_end": s.anchor_end, "type": s.type, "key": key,
                "surface": s.surface, "kinds": [{"kind": k, "key": as_kind(s.canonical, k)} for k in sorted(related)],
            })
        return out

    returns = m.SLOT.replace("key:string>", "key:string,surface:string,kinds:array<struct<kind:string,key:string>>>")
    return answered(f"array<{returns}>", extract)(hyp, anchors, slots)


def _asked_spans(scorer: Scorer, hyp: Column, spans: Column) -> Column:
    def said(words: list[str], spans: list[dict]) -> list[str | None]:
        return [plugin_key(scorer.canonicalizer.slot([] if s["start"] is None else words[int(s["start"]) : int(s["end"])], s["type"])) for s in spans]

    return answered("array<string>", said)(hyp, spans)


# Stages --------------------------------------------------------------------------

#: Parts the texts of a sample while they are normalized together, and what stands for it in a text.
PART, SHOWN = "\x01", "\x02"


def _parts_tokens(texts: Column) -> Column:
    """Tokens of several texts, which are normalized as one."""
    whole = normalize_text(F.array_join(F.transform(texts, lambda t: F.translate(F.coalesce(t, F.lit("")), PART, SHOWN)), f" {PART} "))
    return F.transform(F.split(whole, PART), lambda p: F.filter(F.split(p, " "), lambda t: t != ""))


def _with_tokens(samples: DataFrame, scorer: Scorer) -> DataFrame:
    """Token columns ``ref, hyp`` and the surfaces' tokens, and annotations as arrays."""
    entities, slots = (F.coalesce(F.col(f"annotations.{name}"), m.no_items(ddl)) for name, ddl in (("entities", schemas.ENTITY), ("critical_slots", schemas.SLOT)))
    out = staged(samples, ents=entities, slots=slots)
    item = lambda x: F.struct(*(x[n].alias(n) for n in ("id", "type", "ref_start", "ref_end", "surface")))
    out = staged(out, items=built_once("items", make=lambda: F.concat(F.transform("ents", item), F.transform("slots", item))))
    if scorer.tokenizer is None:
        texts = lambda: F.concat(F.array("reference", "hypothesis"), F.transform("items", lambda x: x["surface"]))
        made, error = staged(out, made=built_once("tokens", make=lambda: _parts_tokens(texts()))), F.lit(None).cast("string")
        found = F.col("made")
    else:
        cut = checked_tokenizer(scorer.tokenizer)

        def all_tokens(reference: str | None, hypothesis: str | None, items: list[dict]) -> list[list[str]]:
            return [cut(t) if isinstance(t, str) else [] for t in (reference, hypothesis, *(i["surface"] for i in items))]

        made = out.withColumn("made", answered("array<array<string>>", all_tokens)(F.col("reference"), F.col("hypothesis"), F.col("items")))
        found, error = F.col("made.found"), F.col("made.error")
    rest = F.slice(found, 3, F.greatest(F.size(found) - 2, F.lit(0)))
    return staged(made, ref=F.get(found, F.lit(0)), hyp=F.get(found, F.lit(1)), surfaces=rest, asked=error).drop("made")


def _checked(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``error``, and for a faulty sample no tokens and annotations, so that nothing is counted."""
    ref, items, ents, slots = map(F.col, ("ref", "items", "ents", "slots"))
    texts = F.when(F.col("reference").isNull() | F.col("hypothesis").isNull(), "reference and hypothesis must be strings")
    surfaces = F.col("surfaces") if scorer.check_surfaces else None
    own_typed = type(scorer.canonicalizer) is not GermanCanonicalizer
    df = staged(df, states=built_once("states", make=lambda: F.transform(slots, lambda s: canonical_state(s["type"], s["canonical"]))))
    faults = [
        version_fault(scorer.versions), texts, F.col("asked"), built_once("item", scorer.check_surfaces, make=lambda: item_fault(items, ref, surfaces)),
        built_once("entity", scorer.allow_overlapping_entities, make=lambda: entity_fault(ents, scorer.allow_overlapping_entities)),
        built_once("slot", make=lambda: slot_fault(slots, ents, F.col("states"))), *([] if own_typed else [built_once("canonical", make=lambda: canonical_fault(slots, F.col("states")))]),
        built_once("meaning", make=lambda: meaning_fault(ents, ref)),
    ]
    found = F.coalesce(*faults)
    if own_typed:
        # A canonicalizer of the user's own judges its values, after the shape of the annotations.
        df = df.withColumn("typed", _asked_expected(scorer, slots))
        found = F.coalesce(*faults[:-1], F.col("typed.error"), faults[-1])
    out = staged(df, fault=found)
    clean = F.col("fault").isNull()
    keep = lambda name: F.when(clean, F.col(name)).otherwise(F.filter(name, lambda x: F.lit(False)))
    parts = {f"c_{n}": F.coalesce(keep(n), F.array().cast("array<string>")) if n in ("ref", "hyp") else keep(n) for n in ("ref", "hyp", "ents", "slots")}
    out = staged(out, **parts, keys=F.transform("states", lambda x: x["key"])).drop("ref", "hyp", "ents", "slots", "items", "surfaces", "asked", "states")
    return out.withColumnsRenamed({f"c_{n}": n for n in ("ref", "hyp", "ents", "slots")})


def _with_terms(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``terms``: ``struct<t, at, origin>`` of the terms that the hypothesis says; ``hits`` of all sources; ``asked``."""
    hyp, ents = F.col("hyp"), F.col("ents")
    own = built_once("own", make=lambda: m.own_hits(hyp, ents, F.col("ref")))
    none = F.lit(None).cast("string")
    if scorer.recognizer is None:
        df = staged(df, own=own, given=m.no_items(m.TERM), asked=none)
    elif isinstance(scorer.recognizer, Lexicon):
        df = staged(df, own=own, given=term_hits(df.sparkSession, scorer.recognizer, hyp), asked=none)
    else:
        df = df.withColumn("made", _asked_terms(scorer, hyp))
        df = staged(df, own=own, given=F.coalesce("made.found", m.no_items(m.TERM)), asked=F.col("made.error")).drop("made")
    given = F.col("given") if scorer.recognizer is not None and not isinstance(scorer.recognizer, Lexicon) else m.packed(F.col("given"))
    typed = lambda source: F.transform(source, lambda t: t.cast(m.TERM))
    df = staged(df, first=typed(given), second=typed(m.packed(F.col("own"))))
    df = staged(df, chosen=built_once("chosen", make=lambda: m.combined(F.col("first"), F.col("second")))).drop("first", "second")
    return staged(df, terms=F.transform("chosen", lambda t, i: F.struct(t.alias("t"), i.alias("at"), m.origin(F.col("to_ref"), t).alias("origin"))))


def _with_entities(df: DataFrame, scorer: Scorer) -> DataFrame:
    hyp, ents, terms, links = *map(F.col, ("hyp", "ents", "terms")), (F.col("to_hyp"), F.col("inserted"))
    if scorer.own_meanings:
        images = F.filter(F.transform(ents, lambda e: m.image(links, e["ref_start"], e["ref_end"])), lambda s: s["start"].isNotNull())
        spans = F.array_distinct(F.concat(F.transform(terms, lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].cast("int").alias("end"))), F.transform(images, lambda s: F.struct(s["start"].alias("start"), s["end"].cast("int").alias("end")))))
        own = F.transform(ents, lambda e: F.struct(words_text(F.col("ref"), e["ref_start"], e["ref_end"]).alias("surface"), *(e[n].alias(n) for n in ("canonical", "type", "concept_id"))))
        df = staged(df, ask_spans=spans, ask_types=F.array_distinct(F.transform(ents, lambda e: e["type"])), ask_own=own)
        df = df.withColumn("made", _asked_meanings(scorer, hyp, F.col("ask_spans"), F.col("ask_types"), F.col("ask_own")))
        df = staged(df, meanings=F.col("made.found"), asked_meanings=F.col("made.error")).drop("made", "ask_spans", "ask_types", "ask_own")
        means = lambda span, e: m.first_of(F.filter("meanings", lambda x: m.same_span(x, span) & (x["type"] == e["type"])))["canonical"]
    else:
        df = df.withColumn("asked_meanings", F.lit(None).cast("string"))

        def means(span: Column, e: Column) -> Column:
            return F.get(F.transform(F.array(m.meaning([F.col("given"), F.col("own")], span)), lambda t: F.when(t["type"] == e["type"], t["canonical"])), F.lit(0))

    df = staged(df, related=built_once("related", scorer.own_meanings, scorer.require_entity_type, make=lambda: m.entity_candidates(ents, terms, links, means, scorer.require_entity_type)))
    df = staged(df, used_terms=built_once("used terms", make=lambda: m.use_terms(F.col("related"))))
    judged = built_once("judged", make=lambda: m.entity_verdicts(F.col("related"), F.col("used_terms"), terms))
    return staged(df, judged=judged, left_terms=m.unused(terms, F.col("used_terms")))


def _with_slots(df: DataFrame, scorer: Scorer) -> DataFrame:
    hyp, slots, links = F.col("hyp"), F.col("slots"), (F.col("to_hyp"), F.col("inserted"))
    df = staged(df, anchors=built_once("anchors", make=lambda: m.anchors_of(F.col("terms"), F.col("judged"))))
    images = built_once("images", make=lambda: F.transform(slots, lambda s: F.struct(m.image(links, s["ref_start"], s["ref_end"]).alias("span"), s["type"].alias("type"))))
    df = staged(df, images=images)
    none = F.lit(None).cast("string")
    if scorer.own_values:
        asked = F.transform("images", lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["type"].alias("type")))
        df = df.withColumns({"made": _asked_slots(scorer, hyp, F.col("anchors"), slots), "said": _asked_spans(scorer, hyp, asked), "wanted": _asked_expected(scorer, slots)})
        df = staged(df, values=F.coalesce("made.found", F.filter("made.found", lambda x: F.lit(False))), plains=F.col("said.found"), expected=F.col("wanted.found"), asked_values=F.coalesce("made.error", "said.error")).drop("made", "said", "wanted")
        typed = lambda v, kind: m.first_of(F.filter(v["kinds"], lambda k: k["kind"] == kind))["key"]
    else:
        places = m.by_place(F.col("anchors"))
        df = staged(df, ends=places["ends"], starts=places["starts"], read=built_once("read", make=lambda: readings(hyp, F.col("anchors"))))
        plains = built_once("plains", make=lambda: F.transform("images", lambda x: span_value(hyp, x["span"]["start"], x["span"]["end"], x["type"])))
        df = staged(df, values=built_once("values", make=lambda: m.extracted(F.col("read"), F.col("ends"), F.col("starts"), RuleSlots().max_distance)), plains=plains, expected=F.col("keys"), asked_values=none)
        typed = lambda v, kind: m.as_kind(v["key"], kind)
    df = staged(df, found=F.transform(F.coalesce("values", F.filter("values", lambda v: F.lit(False))), lambda v, i: F.struct(v.alias("v"), i.alias("at"))))
    parts = map(F.col, ("judged", "found", "images", "plains", "expected"))
    df = staged(df, slot_related=built_once("slot related", scorer.own_values, make=lambda: m.slot_candidates(slots, *parts, typed)))
    df = staged(df, used_values=built_once("used values", make=lambda: m.use_values(F.col("slot_related"))))
    judged = built_once("slot judged", make=lambda: m.slot_verdicts(F.col("slot_related"), F.col("used_values"), F.col("found")))
    return staged(df, slot_judged=judged, left_values=m.unused(F.col("found"), F.col("used_values")))


# Results -------------------------------------------------------------------------


def _counts() -> dict[str, Column]:
    ents = F.col("ents")
    annotated = lambda i: F.exists(ents, lambda e: (e["ref_start"] <= i) & (i < e["ref_end"]))
    said = lambda i: F.exists("terms", lambda x: (x["t"]["start"] <= i) & (i < x["t"]["end"]))
    marked = F.size(F.array_distinct(F.flatten(F.transform(ents, lambda e: F.sequence(e["ref_start"], e["ref_end"] - 1)))))
    size = lambda c: F.size(c).cast("long")
    judged, slots = F.col("judged"), F.col("slot_judged")
    return {
        "substitutions": size("changed"), "deletions": size("deleted"), "insertions": size("inserted"),
        "hits": size("ref") - size("changed") - size("deleted"), "reference_word_count": size("ref"),
        "medical_substitutions": count_if("changed", annotated), "medical_deletions": count_if("deleted", annotated),
        "medical_insertions": count_if("inserted", lambda x: said(x["hyp"])), "medical_reference_word_count": marked.cast("long"),
        "entity_tp": count_if(judged, lambda v: v["right"]), "entity_fp": count_if(judged, lambda v: v["replaced"]) + size("left_terms"),
        "entity_fn": count_if(judged, lambda v: ~v["right"]), "critical_tp": count_if(slots, lambda v: v["right"]),
        "critical_fp": count_if(slots, lambda v: v["wrong"]) + size("left_values"), "critical_fn": count_if(slots, lambda v: ~v["right"]),
    }


def _per_type() -> Column:
    entities = F.transform("judged", lambda v: F.struct(v["e"]["type"].alias("type"), v["right"].alias("right"), v["replaced"].alias("more")))
    slots = F.transform("slot_judged", lambda v: F.struct(v["s"]["type"].alias("type"), v["right"].alias("right"), v["wrong"].alias("more")))
    terms, values = F.transform("left_terms", lambda x: F.struct(x["t"]["type"].alias("type"))), F.transform("left_values", lambda x: F.struct(x["v"]["type"].alias("type")))
    return F.concat(m.type_rows("critical", slots, "more", values), m.type_rows("entity", entities, "more", terms))


def _logs() -> dict[str, Column]:
    """The matches of entities and of values, one row each, as JSON-free structs."""
    hyp, nothing, no_place = F.col("hyp"), F.lit(None).cast("string"), F.lit(None).cast("int")
    said = lambda span: F.coalesce(words_text(hyp, span["start"], span["end"]), F.lit(""))

    def row(**columns: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in columns.items()))

    entities = F.transform("judged", lambda v: row(
        reference_id=v["e"]["id"], type=v["e"]["type"], reference=v["e"]["surface"], hypothesis=said(v["span"]), reference_canonical=v["e"]["canonical"],
        hypothesis_canonical=v["found"], status=F.when(v["right"], "TP").otherwise("FN"), hypothesis_start=v["span"]["start"], hypothesis_end=v["span"]["end"],
    ))
    more_entities = F.transform("left_terms", lambda x: row(
        reference_id=nothing, type=x["t"]["type"], reference=nothing, hypothesis=said(x["t"]), reference_canonical=nothing,
        hypothesis_canonical=x["t"]["canonical"], status=F.lit("FP"), hypothesis_start=x["t"]["start"], hypothesis_end=x["t"]["end"],
    ))
    slots = F.transform("slot_judged", lambda v: row(
        reference_id=v["s"]["id"], anchor_entity_id=v["s"]["anchor_entity_id"], type=v["s"]["type"], reference=v["s"]["surface"], hypothesis=said(v["span"]),
        reference_canonical=json_text(v["expected"]), hypothesis_canonical=json_text(v["value"]), anchor_correct=v["anchored"], status=v["status"],
        anchor_start=no_place, anchor_end=no_place,
    ))
    more_slots = F.transform("left_values", lambda x: row(
        reference_id=nothing, anchor_entity_id=nothing, type=x["v"]["type"], reference=nothing, hypothesis=said(x["v"]), reference_canonical=nothing,
        hypothesis_canonical=json_text(x["v"]["key"]), anchor_correct=F.lit(None).cast("boolean"), status=F.lit("FP"),
        anchor_start=x["v"]["anchor_start"], anchor_end=x["v"]["anchor_end"],
    ))
    cast = lambda a, b, ddl: F.concat(a.cast(ddl), b.cast(ddl))
    return {"entity_matches": cast(entities, more_entities, schemas.ENTITY_MATCH), "critical_matches": cast(slots, more_slots, schemas.SLOT_MATCH)}


def score_samples(
    samples: DataFrame, scorer: Scorer | None = None, include_alignment: bool = False, matches: bool = True, carried: Sequence[str] = ()
) -> DataFrame:
    """One result row per row of ``samples``; a faulty sample has zero counts and its ``error``.

    Without ``matches`` the logs of single matches are null, for runs that only sum counts.
    Columns ``carried`` come along unread.
    """
    scorer = scorer or Scorer()
    columns = [*FROM_SAMPLE, *CONTENT, *carried]
    df = _checked(_with_tokens(samples.select(*columns), scorer), scorer)
    df = df.withColumn("links", linked(F.col("ref"), F.col("hyp")))
    df = staged(df, **{n: F.col(f"links.{n}") for n in LINKS.names}).drop("links")
    df = _with_slots(_with_entities(_with_terms(df, scorer), scorer), scorer)
    # What a plug-in got wrong is the sample's fault, and voids its counts.
    df = staged(df, error=F.concat(F.coalesce("sample_id", F.lit("None")), F.lit(": "), F.coalesce("fault", "asked", "asked_meanings", "asked_values")))
    clean = F.col("error").isNull()
    counts = {n: F.when(clean, c).otherwise(0).cast("long") for n, c in built_once("counts", make=_counts).items()}
    logs = built_once("logs", make=_logs) if matches or include_alignment else {f"{x}_matches": F.lit(None) for x in ("entity", "critical")}
    made = counts | {"per_type": F.when(clean, built_once("types", make=_per_type)).cast(schemas.PER_TYPE)} | {n: F.when(clean, c) for n, c in logs.items()}
    made |= {v: F.lit(x).cast("string") for v, x in scorer.versions.items()}
    known = {"sample_id": F.col("sample_id"), "ordinal": F.col("ordinal")} | made | {"metadata": F.col("metadata"), "error": F.col("error")}
    known["entity_matches"], known["critical_matches"] = (known[n].cast(d) for n, d in (("entity_matches", schemas.ENTITY_MATCH), ("critical_matches", schemas.SLOT_MATCH)))
    if include_alignment:
        df = with_alignment(df, "ref", "hyp")
        known |= {"ref_tokens": F.col("ref"), "hyp_tokens": F.col("hyp"), "alignment": F.col("alignment")}
    return df.select(*(c.alias(n) for n, c in known.items()), *carried)


#: What the score of a sample depends on, and what its result only takes over.
CONTENT = ("reference", "hypothesis", "annotations", *schemas.VERSION_FIELDS)
FROM_SAMPLE = ("sample_id", "ordinal", "metadata")
#: Most bytes (as JSON) of scored contents that are sent to every executor; more of them meet the samples by a shuffle.
BROADCAST_BYTES = 32_000_000
#: Contents or letters of them that are worth a task of their own: some four seconds of scoring, as an executor that is new to the plan takes longer to load and compile it.
TASK_CONTENTS, TASK_LETTERS = 4_000, 400_000


def _most_tasks(spark: SparkSession) -> int:
    """Tasks for many contents; adaptive execution would put them into one by their size, however dear they are."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def score_distinct(
    samples: DataFrame, scorer: Scorer | None = None, include_alignment: bool = False, matches: bool = True, carried: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """The rows of :func:`score_samples` where samples repeat: each distinct content is scored once.

    Contents are told apart in full and scored by a run of their own, whose
    results are checkpointed; samples then find theirs by the content's SHA-256.
    Where nearly all contents differ, this costs a shuffle of them and saves nothing.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}), 256))
    contents = samples.select(*CONTENT).distinct().repartition(tasks or _most_tasks(samples.sparkSession))
    nothing = F.lit(None)
    contents = contents.select("*", F.lit("").alias("sample_id"), nothing.cast("long").alias("ordinal"), nothing.cast("string").alias("metadata"), digest.alias("content"))
    scored = score_samples(contents, scorer, include_alignment, matches, carried=["content"])
    names = [n for n in scored.columns if n != "content"]
    scored = checkpointed(scored.drop(*FROM_SAMPLE))
    size = scored.agg(F.sum(F.length(F.to_json(F.struct(*(c for c in scored.columns if c != "content")))))).first()[0]
    results = F.broadcast(scored) if (size or 0) <= BROADCAST_BYTES else scored
    found = samples.select(*FROM_SAMPLE, *carried, digest.alias("content")).join(results, "content")
    return found.withColumn("error", F.concat(F.coalesce("sample_id", F.lit("None")), "error")).select(*names, *carried)


def score_counted(samples: DataFrame, scorer: Scorer | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Results for sums where samples repeat: a row for each distinct content and values of columns ``by``.

    ``n_samples`` is how many samples a row stands for, by which ``rollup``
    multiplies its counts, and ``ordinal`` the first of them; logs, ids and, unless
    in ``by``, metadata are null.  Samples are read once and meet as counts,
    contents are told apart in full and scored once.  Samples that come with
    ``n_samples`` are counts already.
    """
    number = F.sum("n_samples") if "n_samples" in samples.columns else F.count("*")
    counted = samples.groupBy(*CONTENT, *by).agg(F.min("ordinal").alias("ordinal"), number.alias("n_samples"))
    counted = checkpointed(counted).withColumns({c: F.lit(None).cast("string") for c in FROM_SAMPLE if c not in counted.columns})
    length = F.length(F.coalesce("reference", F.lit(""))) + F.length(F.coalesce("hypothesis", F.lit("")))
    contents, letters = counted.select(*CONTENT).distinct().agg(F.count("*"), F.sum(length)).first()
    tasks = min(_most_tasks(samples.sparkSession), 1 + max(contents // TASK_CONTENTS, (letters or 0) // TASK_LETTERS))
    if not by:
        return score_samples(counted.repartition(tasks), scorer, matches=False, carried=["n_samples"])
    own = [c for c in by if c not in FROM_SAMPLE]
    return score_distinct(counted, scorer, matches=False, carried=[*own, "n_samples"], tasks=tasks)
