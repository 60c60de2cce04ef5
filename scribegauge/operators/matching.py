"""Matching of annotations with what a hypothesis says, as one expression plan.

Every step is a column of the sample's own row, so samples never meet and
nothing is shuffled.  Pairs of an annotation and an occurrence that may answer
it are formed first, each with its outcome; what is left is the order in which
occurrences are used up, a fold over the annotations that carries the places of
the used ones.  Words of the two texts meet through their alignment, the one
step that is an Arrow function.

Plug-ins supply data to the same plan: tokens, terms, meanings of spans, values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DOSE_UNITS, NUMERIC_TYPES
from .lexicon import OTHER
from .readings import RANKS, let

#: What a bare number means next to a term of this type.
BY_ANCHOR = {"LAB_TEST": "LAB_VALUE", "CLINICAL_FINDING": "VITAL_VALUE"}
#: How far after a value its term may be, by rank, and whether such a term comes before one that precedes the value; the ranks that look ahead are the first.
AHEAD, FORWARD = (2, 2, 1, 1), (True, True, False, False)

TERM = "struct<start:int,end:int,canonical:string,type:string,concept_id:string>"


def no_items(ddl: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{ddl}>")


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a token; null spans share none."""
    return F.coalesce((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(False))


def same_span(a: Column, b: Column) -> Column:
    return F.coalesce((a["start"] == b["start"]) & (a["end"] == b["end"]), F.lit(False))


# Terms ---------------------------------------------------------------------------


def packed(hits: Column) -> Column:
    """Leftmost-longest choice among term occurrences."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h.alias("hit"))))
    keep = lambda kept, x: F.when(
        (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["end"] <= x["start"]), F.concat(kept, F.array(x["hit"]))
    ).otherwise(kept)
    return F.when(F.size(hits) < 2, hits).otherwise(F.aggregate(ordered, F.filter(hits, lambda h: F.lit(False)), keep))


def own_hits(hyp: Column, entities: Column, ref: Column) -> Column:
    """Occurrences of the annotated surfaces, as the reference says them."""
    said = F.transform(
        entities,
        lambda e: F.struct(F.slice(ref, e["ref_start"] + 1, e["ref_end"] - e["ref_start"]).alias("key"), (e["ref_end"] - e["ref_start"]).alias("n"), e["canonical"].alias("canonical"), e["type"].alias("type"), e["concept_id"].alias("concept_id")),
    )
    return let(F.struct(F.array_distinct(said).alias("keys"), F.transform(said, lambda k: F.get(k["key"], F.lit(0))).alias("firsts")), lambda own: _own_places(hyp, own))


def _own_places(hyp: Column, own: Column) -> Column:
    keys = own["keys"]

    def at_place(word: Column, at: Column) -> Column:
        fitting = F.filter(keys, lambda k: (F.get(k["key"], F.lit(0)) == word) & (F.slice(hyp, at + 1, k["n"]) == k["key"]))
        return F.transform(fitting, lambda k: F.struct(at.alias("start"), (at + k["n"]).cast("int").alias("end"), k["canonical"].alias("canonical"), k["type"].alias("type"), k["concept_id"].alias("concept_id")))

    places = F.filter(F.transform(hyp, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(own["firsts"], x["word"]))
    return F.flatten(F.transform(places, lambda x: at_place(x["word"], x["at"])))


def combined(given: Column, own: Column) -> Column:
    """Terms of two recognizers: longer first, then specific types, then earlier start and recognizer."""

    def offers(source: Column, number: int) -> Column:
        return F.transform(source, lambda t: F.struct((t["start"] - t["end"]).alias("n"), (t["type"] == OTHER).alias("vague"), t["start"].alias("start"), F.lit(number).alias("source"), t.alias("t")))

    keep = lambda kept, o: F.when(F.exists(kept, lambda k: overlap(k, o["t"])), kept).otherwise(F.concat(kept, F.array(o["t"])))
    weighed = F.aggregate(F.array_sort(F.concat(offers(given, 0), offers(own, 1))), F.filter(given, lambda t: F.lit(False)), keep)
    # Often the second recognizer finds nothing that the first one does not.
    return F.array_sort(F.when(F.size(F.array_except(own, given)) == 0, given).otherwise(weighed))


def meaning(hits: list[Column], span: Column) -> Column:
    """The term that all words of a span together are: the first specific one, or else the first; null if none."""
    fitting = F.concat(*(F.filter(h, lambda t: same_span(t, span)) for h in hits))
    specific = F.filter(fitting, lambda t: t["type"] != OTHER)
    return F.coalesce(first_of(specific), first_of(fitting))


# Spans ---------------------------------------------------------------------------


def image(links: tuple[Column, Column], start: Column, end: Column) -> Column:
    """``struct<start, end>`` of what the hypothesis says for a reference span; insertions count strictly inside.

    ``links`` are the counterparts of the reference tokens and the inserted tokens.
    """
    to_hyp, insertions = links
    inserted = F.filter(insertions, lambda x: (x["boundary"] > start) & (x["boundary"] < end))
    at = F.concat(F.slice(to_hyp, start + 1, end - start), F.transform(inserted, lambda x: x["hyp"]))
    return F.struct(F.array_min(at).alias("start"), (F.array_max(at) + 1).alias("end"))


def origin(to_ref: Column, term: Column) -> Column:
    """``struct<start, end>`` of the reference tokens that a hypothesis span is aligned to."""
    at = F.slice(to_ref, term["start"] + 1, term["end"] - term["start"])
    return F.struct(F.array_min(at).alias("start"), (F.array_max(at) + 1).alias("end"))


# Entities ------------------------------------------------------------------------

PICKED = "struct<choice:int,right:boolean>"
STATE = f"struct<used:array<int>,picked:array<{PICKED}>>"


def consumed(items: Column, pick) -> Column:
    """Fold over items: ``pick(used, item)`` gives a choice, whether it is right, and the place to use up (or null)."""
    start = F.from_json(F.lit('{"used": [], "picked": []}'), STATE)

    def step(state: Column, item: Column) -> Column:
        return let(
            pick(state["used"], item),
            lambda p: F.struct(
                F.when(p["spent"].isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(p["spent"]))).alias("used"),
                F.concat(state["picked"], F.array(F.struct(p["choice"].alias("choice"), p["right"].alias("right")))).alias("picked"),
            ),
        )

    return F.aggregate(items, start, step)


def entity_candidates(entities: Column, terms: Column, links: tuple[Column, Column], means, require_type: bool) -> Column:
    """Each entity with its image and the terms that may answer it, those of its meaning first, each with its outcome.

    A term may answer if it covers the image and its own words come from nowhere
    outside the entity.
    """

    def with_terms(e: Column) -> Column:
        return let(image(links, e["ref_start"], e["ref_end"]), lambda span: relation(e, span))

    def relation(e: Column, span: Column) -> Column:
        def answers(x: Column) -> Column:
            t = x["t"]
            covers = F.coalesce((t["start"] <= span["start"]) & (span["end"] <= t["end"]), F.lit(False))
            return covers & F.coalesce((e["ref_start"] <= x["origin"]["start"]) & (x["origin"]["end"] <= e["ref_end"]), F.lit(True))

        def outcome(x: Column) -> Column:
            t = x["t"]
            exact = (t["canonical"] == e["canonical"]) & ((t["type"] == e["type"]) | F.lit(not require_type))
            found = means(t, e) if require_type else t["canonical"]
            return F.struct((~exact).alias("other"), x["at"].alias("at"), found.alias("found"))

        return F.struct(
            e.alias("e"), span.alias("span"), F.array_sort(F.transform(F.filter(terms, answers), outcome)).alias("offers"),
            F.when(span["start"].isNotNull(), means(span, e)).alias("plain"),
            F.transform(F.filter(terms, lambda x: same_span(x["t"], span)), lambda x: x["at"]).alias("same"),
            F.exists(terms, lambda x: overlap(x["t"], span)).alias("met"),
        )

    return F.transform(entities, with_terms)


def use_terms(related: Column) -> Column:
    """Which term answers each entity, in order; a term is used up by an entity of its meaning.

    Words that are no term of their own count unless a used term stands on them.
    """

    def pick(used: Column, r: Column) -> Column:
        def judged(offer: Column) -> Column:
            found = F.when(offer.isNull(), r["plain"]).otherwise(offer["found"])
            right = F.coalesce(found == r["e"]["canonical"], F.lit(False)) & (offer.isNotNull() | ~F.exists(r["same"], lambda i: F.array_contains(used, i)))
            return F.struct(offer["at"].alias("choice"), right.alias("right"), F.when(right, offer["at"]).alias("spent"))

        return let(first_of(F.filter(r["offers"], lambda o: ~F.array_contains(used, o["at"]))), judged)

    return consumed(related, pick)


def entity_verdicts(related: Column, folded: Column, terms: Column) -> Column:
    """Each entity with its outcome and the span that stands for it."""

    def verdict(r: Column, i: Column) -> Column:
        picked = F.get(folded["picked"], i)
        term = F.get(terms, picked["choice"])
        found = F.when(picked["choice"].isNull(), r["plain"]).otherwise(first_of(F.filter(r["offers"], lambda o: o["at"] == picked["choice"]))["found"])
        span = F.when(picked["choice"].isNull(), r["span"]).otherwise(F.struct(term["t"]["start"].alias("start"), term["t"]["end"].alias("end")))
        # Other words in its place are one more error, unless a term there counts by itself.
        replaced = ~picked["right"] & r["span"]["start"].isNotNull() & ~r["met"]
        return F.struct(r["e"].alias("e"), r["span"].alias("image"), span.alias("span"), found.alias("found"), picked["right"].alias("right"), replaced.alias("replaced"))

    return F.transform(related, verdict)


# Values --------------------------------------------------------------------------

SLOT = "struct<start:int,end:int,anchor_start:int,anchor_end:int,type:string,key:string>"


def anchors_of(terms: Column, verdicts: Column) -> Column:
    """``array<TERM>`` of the terms, then of recovered words that are none; of equal spans the first."""
    plain = F.transform(terms, lambda x: x["t"])
    recovered = F.filter(verdicts, lambda v: v["right"] & ~F.exists(plain, lambda t: same_span(t, v["span"])))
    more = F.transform(recovered, lambda v: F.struct(
        v["span"]["start"].alias("start"), v["span"]["end"].alias("end"), v["e"]["canonical"].alias("canonical"), v["e"]["type"].alias("type"), F.lit(None).cast("string").alias("concept_id")
    ).cast(TERM))
    new = lambda kept, m: F.when(F.exists(kept, lambda k: same_span(k, m)), kept).otherwise(F.concat(kept, F.array(m)))
    return F.when(F.size(more) == 0, plain).otherwise(F.aggregate(more, plain, new))


def by_place(anchors: Column) -> Column:
    """``struct<ends, starts>``: the anchors in the two orders in which values look for them; of ties the first given comes first."""
    ends = F.transform(anchors, lambda a, i: F.struct(a["end"].alias("at"), (-i).alias("i"), a.alias("a")))
    starts = F.transform(anchors, lambda a, i: F.struct(a["start"].alias("at"), i.alias("i"), a.alias("a")))
    return F.struct(ends.alias("ends"), starts.alias("starts"))


def nearest(ends: Column, starts: Column, start: Column, end: Column, rank: Column, reach: int) -> Column:
    """The anchor of a value: the last one that ends before it within reach, or the first one right after it; some kinds look ahead first."""
    ahead = F.when(rank < sum(FORWARD), AHEAD[0]).otherwise(AHEAD[-1])
    last = F.array_max(F.filter(ends, lambda x: (x["at"] <= start) & (x["at"] >= start - reach)))["a"]
    first = F.array_min(F.filter(starts, lambda x: (x["at"] >= end) & (x["at"] <= end + ahead)))["a"]
    return F.when(rank < sum(FORWARD), F.coalesce(first, last)).otherwise(F.coalesce(last, first))


def slot_type(rank: Column, key: Column, anchor: Column) -> Column:
    """A bare number becomes what its term gives it."""
    dose = (anchor["type"] == "MEDICATION") & key.startswith("q:") & F.regexp_extract(key, r"\|(.*)$", 1).isin(*DOSE_UNITS)
    named = reduce(lambda made, kind: made.when(anchor["type"] == kind, BY_ANCHOR[kind]), BY_ANCHOR, F.when(dose, "DOSE")).otherwise(RANKS[3])
    return F.when(rank == 3, named).otherwise(F.element_at(F.array(*map(F.lit, RANKS)), rank + 1))


def extracted(found: Column, ends: Column, starts: Column, reach: int) -> Column:
    """Readings near their terms, packed from left to right: the first one of each place that has a term."""

    def as_slot(r: Column) -> Column:
        return let(
            nearest(ends, starts, r["start"], r["end"], r["rank"], reach),
            lambda a: F.when(a.isNotNull(), F.struct(
                r["start"].alias("start"), r["end"].alias("end"), a["start"].alias("anchor_start"), a["end"].alias("anchor_end"),
                slot_type(r["rank"], r["key"], a).alias("type"), r["key"].alias("key"),
            )),
        )

    offered = F.filter(F.transform(found, as_slot), lambda s: s.isNotNull())
    return let(offered, left_to_right)


def left_to_right(offered: Column) -> Column:
    """The items that begin where the last one kept has ended."""
    keep = lambda kept, s: F.when(
        (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["end"] <= s["start"]), F.concat(kept, F.array(s))
    ).otherwise(kept)
    return F.aggregate(offered, F.filter(offered, lambda s: F.lit(False)), keep)


def family(kind: Column) -> Column:
    """Numeric types are one family: which of them a number is depends on its term only."""
    return F.when(kind.isin(*NUMERIC_TYPES), "NUMERIC").otherwise(kind)


def as_kind(key: Column, kind: Column) -> Column:
    """The key of a value as one of a kind; a number without a unit is no dose."""
    return F.when((kind != "DOSE") | key.startswith("q:"), key)


def slot_candidates(slots: Column, verdicts: Column, found: Column, images: Column, plains: Column, expected: Column, typed) -> Column:
    """Each annotated value with the extracted ones that may answer it, and what its own words say.

    A value of the family answers if it belongs to the same term and stands on
    the image; a negation without an image may stand anywhere.
    """

    def with_owner(s: Column, i: Column) -> Column:
        owner = first_of(F.filter(verdicts, lambda v: v["e"]["id"] == s["anchor_entity_id"]))
        home = let(owner, lambda v: F.struct(v["right"].alias("anchored"), F.when(v["right"], v["span"]).otherwise(v["image"]).alias("home"), F.get(images, i)["span"].alias("span")))
        return let(home, lambda o: relation(s, i, o))

    def relation(s: Column, i: Column, o: Column) -> Column:
        kin = F.filter(found, lambda x: family(x["v"]["type"]) == family(s["type"]))
        anywhere = o["span"]["start"].isNull() & (s["type"] == "NEGATION")
        at_home = lambda x: F.coalesce((x["v"]["anchor_start"] == o["home"]["start"]) & (x["v"]["anchor_end"] == o["home"]["end"]), F.lit(False))
        offers = F.filter(kin, lambda x: at_home(x) & (anywhere | overlap(x["v"], o["span"])))
        return F.struct(
            s.alias("s"), o["span"].alias("span"), o["anchored"].alias("anchored"), F.get(expected, i).alias("expected"),
            F.transform(offers, lambda x: F.struct(x["at"].alias("at"), typed(x["v"], s["type"]).alias("key"))).alias("offers"),
            F.exists(kin, lambda x: overlap(x["v"], o["span"])).alias("elsewhere"), F.get(plains, i).alias("plain"),
        )

    return F.transform(slots, with_owner)


def use_values(related: Column) -> Column:
    """Which extracted value answers each annotated one, in order; an answer is used up, right or wrong."""

    def pick(used: Column, r: Column) -> Column:
        return let(
            first_of(F.filter(r["offers"], lambda o: ~F.array_contains(used, o["at"]))),
            lambda o: F.struct(o["at"].alias("choice"), F.lit(False).alias("right"), o["at"].alias("spent")),
        )

    return consumed(related, pick)


def slot_verdicts(related: Column, folded: Column, found: Column) -> Column:
    def verdict(r: Column, i: Column) -> Column:
        choice = F.get(folded["picked"], i)["choice"]
        answered = choice.isNotNull()
        value = F.when(answered, first_of(F.filter(r["offers"], lambda o: o["at"] == choice))["key"]).otherwise(r["plain"])
        answer = F.get(found, choice)["v"]
        span = F.when(answered, F.struct(answer["start"].alias("start"), answer["end"].alias("end"))).otherwise(r["span"])
        return let(F.struct(answered.alias("answered"), value.alias("value"), span.alias("span")), lambda v: judged(r, v))

    def judged(r: Column, v: Column) -> Column:
        # Silence about a recovered finding affirms it; a value that belongs to another term says nothing here.
        present = v["span"]["start"].isNotNull() | ((r["s"]["type"] == "NEGATION") & r["anchored"])
        counts = present & (v["answered"] | ~r["elsewhere"])
        right = counts & r["anchored"] & F.coalesce(v["value"] == r["expected"], F.lit(False))
        wrong = counts & ~right & (v["answered"] | v["value"].isNotNull())
        status = F.when(right, "TP").when(present, "WRONG").otherwise("FN")
        return F.struct(
            r["s"].alias("s"), v["span"].alias("span"), v["value"].alias("value"), r["expected"].alias("expected"), r["anchored"].alias("anchored"),
            right.alias("right"), wrong.alias("wrong"), status.alias("status"),
        )

    return F.transform(related, verdict)


def unused(items: Column, folded: Column) -> Column:
    return F.filter(items, lambda x: ~F.array_contains(folded["used"], x["at"]))


# Sums ----------------------------------------------------------------------------


def count_if(items: Column, holds) -> Column:
    return F.size(F.filter(items, holds)).cast("long")


def type_rows(name: str, judged: Column, extra: str, left: Column) -> Column:
    """``array<struct<family, type, tp, fp, fn>>`` of one family, by type."""
    kinds = F.array_sort(F.array_distinct(F.concat(F.transform(judged, lambda v: v["type"]), F.transform(left, lambda t: t["type"]))))

    def row(kind: Column) -> Column:
        own = lambda v: v["type"] == kind
        tp = count_if(judged, lambda v: own(v) & v["right"])
        fp = count_if(judged, lambda v: own(v) & v[extra]) + count_if(left, own)
        return F.struct(F.lit(name).alias("family"), kind.alias("type"), tp.alias("tp"), fp.alias("fp"), count_if(judged, lambda v: own(v) & ~v["right"]).alias("fn"))

    return F.transform(kinds, row)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns of one stage that later stages refer to often.

    A generator over one row keeps the stages apart, as the optimizer would else
    put the whole expression in place of every reference.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
