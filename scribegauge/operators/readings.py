"""Values that words express, as built-in expressions.

A value is a tagged key, so equal values have equal keys and values of different
kinds never do: ``n:`` a decimal number in its shortest form, ``r:`` a ratio,
``q:amount|unit`` a quantity, ``b:`` a flag, ``t:`` text.  German number words are
a finite language with a regular grammar, so one pattern reads a word of any
size; windows of words are probed only where the first word may begin a value.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numerals import POINT, SMALL_NUMBERS
from ..functions.values import FREQUENCIES, NEGATIONS, NUMERIC_TYPES, SIDES, UNITS

#: Widest value, in words.
MAX_WINDOW = 6


def nothing() -> Column:
    """An absent text."""
    return F.lit(None).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BUILT: dict[tuple, Any] = {}


def built_once(name: str, *options: object, make: Callable[[], Any]) -> Any:
    """Columns of one stage, which are put together once for each session and choice of options, as that takes longer than its analysis."""
    key = (SparkContext._active_spark_context, name, *options)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def literals(texts: Iterable[str | None]) -> str:
    """Texts as a list of SQL literals."""
    return ", ".join("cast(null as string)" if t is None else "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts)


def table(entries: dict[str, str]) -> Callable[[Column], Column]:
    """Lookup in a small fixed table, which is a single literal of the plan."""
    return lambda key: F.try_element_at(F.expr(f"map({literals(x for pair in entries.items() for x in pair)})"), key)


def among(words: Iterable[str]) -> Callable[[Column], Column]:
    """Whether a word is one of a fixed list, a single literal as well."""
    return lambda word: F.array_contains(F.expr(f"array({literals(sorted(words))})"), word)


unit_of, side_of, phrase_of = table(UNITS), table(SIDES), table(FREQUENCIES)
_small = table({word: str(n) for word, n in SMALL_NUMBERS.items()})

# Numbers ------------------------------------------------------------------------

_DIGIT_WORDS = "|".join(w for w, n in SMALL_NUMBERS.items() if 0 < n < 10)
_TENS = "|".join(w for w, n in SMALL_NUMBERS.items() if n >= 20 and n % 10 == 0)
_SMALL = "|".join(sorted(SMALL_NUMBERS, key=len, reverse=True))
#: Thousands, hundreds and the rest, each of which may be absent.
WORD_PATTERN = f"^(?:({_DIGIT_WORDS})?(tausend))?(?:({_DIGIT_WORDS})?(hundert))?(?:({_DIGIT_WORDS})und({_TENS})|({_SMALL}))?$"


def beginnings_pattern(words: Iterable[str]) -> str:
    """A pattern, letter by letter, of what begins with one of ``words`` or is the beginning of one."""
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(word[1:])
    parts = (letter if "" in rest else f"{letter}(?:$|{beginnings_pattern(rest)})" for letter, rest in sorted(by_letter.items()))
    return f"(?:{'|'.join(parts)})"


#: What a word must begin with, or be a beginning of, to begin a number word.
_ATOMS = sorted({*SMALL_NUMBERS, "hundert", "tausend"})
NUMBER_BEGINS = f"^(?:[+-]?\\p{{Nd}}|{beginnings_pattern(_ATOMS)})"
DIGITS, RATIO = r"^[+-]?\p{Nd}+([.,]\p{Nd}+)?$", r"^\p{Nd}+/\p{Nd}+$"
#: Decimal digits of all scripts, and what they stand for.
_SCRIPTS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_AS_ASCII = "".join(str(unicodedata.digit(c)) for c in _SCRIPTS)


def plain_digits(text: Column) -> Column:
    """Digits of other scripts as ASCII."""
    return F.translate(text, _SCRIPTS, _AS_ASCII)


def shortest(number: Column) -> Column:
    """A decimal numeral without leading and trailing zeros, plus signs and negative zero; any length."""
    text = F.replace(plain_digits(number), F.lit(","), F.lit("."))
    text = F.regexp_replace(text, r"^(?:\+|(-))?0*(\d+)(?:\.0*$|(\.\d*[1-9])0*$)?", "$1$2$3")
    return F.regexp_replace(text, "^-0$", "0")


def ratio(text: Column) -> Column:
    return F.regexp_replace(plain_digits(text), r"(^|/)0+(?=\d)", "$1")


def word_number(word: Column) -> Column:
    """The number that a German number word names, as text; null if it names none."""

    def value(groups: Column, at: int, absent: str) -> Column:
        return F.coalesce(_small(F.get(groups, F.lit(at))), F.lit(absent)).cast("long")

    def total(groups: Column) -> Column:
        thousands = F.when(F.get(groups, F.lit(1)) != "", value(groups, 0, "1") * 1000).otherwise(0)
        hundreds = F.when(F.get(groups, F.lit(3)) != "", value(groups, 2, "1") * 100).otherwise(0)
        return (thousands + hundreds + value(groups, 4, "0") + value(groups, 5, "0") + value(groups, 6, "0")).cast("string")

    # The parts of the word, in order, from one match.
    parts = F.split(F.regexp_replace(word, WORD_PATTERN, "$1,$2,$3,$4,$5,$6,$7"), ",")
    return F.when((word != "") & word.rlike(WORD_PATTERN), let(parts, total))


def spoken_number(text: Column) -> Column:
    """A number in words, with a digit for each word after the point, as its shortest numeral."""
    parts = F.split(text, f" {POINT} ", 2)
    whole = word_number(F.regexp_replace(F.get(parts, F.lit(0)), " ", ""))
    places = F.transform(F.split(F.get(parts, F.lit(1)), " "), lambda w: F.when(F.length(_small(w)) == 1, _small(w)))
    broken = F.exists(places, lambda p: p.isNull())
    with_point = F.when(~broken, shortest(F.concat(whole, F.lit("."), F.array_join(places, ""))))
    return F.when(F.size(parts) == 2, with_point).otherwise(whole)


def number(text: Column) -> Column:
    """A number in digits or words, as its shortest numeral."""
    return F.when(text.rlike(DIGITS), shortest(text)).otherwise(spoken_number(text))


def amount_key(text: Column) -> Column:
    """Tagged number or ratio."""
    return F.when(text.rlike(RATIO), F.concat(F.lit("r:"), ratio(text))).otherwise(F.concat(F.lit("n:"), number(text)))


def quantity_key(amount: Column, unit: Column) -> Column:
    return F.concat(F.lit("q:"), F.substring(amount, 3, 1 << 30), F.lit("|"), unit)


# Values of a span ----------------------------------------------------------------


def words_text(words: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, end - start), " ")


def often(text: Column) -> Column:
    """How often, from a set phrase or "alle <number> stunden"."""
    hours = number(F.regexp_extract(text, "^alle (.+) stunden$", 1))
    every = F.when(~hours.startswith("-") & (hours != "0"), F.concat(F.lit("t:every_"), hours, F.lit("h")))
    return F.when(text.rlike("^alle .+ stunden$"), every).otherwise(F.concat(F.lit("t:"), phrase_of(text)))


def numeric_key(words: Column, start: Column, end: Column, bare: bool | Column = True) -> Column:
    """An amount with its unit, or a bare one where that is allowed."""
    unit = F.when(end - start > 1, unit_of(F.get(words, end - 1)))
    measured = F.when(unit.isNotNull(), quantity_key(amount_key(words_text(words, start, end - 1)), unit))
    allowed = F.lit(bare) if isinstance(bare, bool) else bare
    return F.coalesce(measured, F.when(allowed, amount_key(words_text(words, start, end))))


def span_value(words: Column, start: Column, end: Column, kind: Column) -> Column:
    """What a span says about a kind of value; a null span says nothing, but for a negation, which is then absent."""
    said = F.slice(words, start + 1, end - start)
    denied = F.concat(F.lit("b:"), F.coalesce(F.exists(said, among(NEGATIONS)), F.lit(False)).cast("string"))
    sides = F.array_distinct(F.filter(F.transform(said, side_of), lambda s: s.isNotNull()))
    text = words_text(words, start, end)
    return (
        F.when(kind == "NEGATION", denied)
        .when(start.isNull(), nothing())
        .when(kind.isin(*NUMERIC_TYPES), numeric_key(words, start, end, kind != "DOSE"))
        .when(kind == "LATERALITY", F.when(F.size(sides) == 1, F.concat(F.lit("t:"), F.get(sides, F.lit(0)))))
        .when(kind == "FREQUENCY", often(text))
        .when(kind == "UNIT", F.concat(F.lit("t:"), unit_of(text)))
        .otherwise(F.concat(F.lit("t:"), text))
    )


# Scan ----------------------------------------------------------------------------

_OFTEN_BEGINS = sorted({p.split()[0] for p in (*FREQUENCIES, "alle")})
is_negation, is_side, begins_often = among(NEGATIONS), among(SIDES), among(_OFTEN_BEGINS)
may_be_value = among({*NEGATIONS, *SIDES, *_OFTEN_BEGINS})
#: Values in order of preference at one place.
RANKS = ("NEGATION", "LATERALITY", "FREQUENCY", "NUMERIC_VALUE")
READING = "struct<start:int,rank:int,end:int,key:string>"


def readings(words: Column, taken: Column) -> Column:
    """``array<READING>`` of the values outside of the spans of ``taken``, in order: the widest of each place and kind."""
    size = F.size(words)

    def widest(at: Column, room: Column, read: Callable[[Column], Column]) -> Column:
        windows = F.filter(F.array(*(F.lit(n) for n in range(MAX_WINDOW, 0, -1))), lambda n: n <= room)
        found = F.transform(windows, lambda n: F.struct((at + n).alias("end"), read(at + n).alias("key")))
        return F.get(F.filter(found, lambda r: r["key"].isNotNull()), F.lit(0))

    def at_place(x: Column) -> Column:
        at, word = x["at"], x["word"]
        room = F.coalesce(F.array_min(F.transform(F.filter(taken, lambda t: t["start"] > at), lambda t: t["start"])), size) - at

        def reading(rank: int, end: Column, key: Column) -> Column:
            return F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), key.alias("key"))

        def wide(rank: int, may: Column, read: Callable[[Column], Column]) -> Column:
            return F.when(may, let(widest(at, room, read), lambda w: reading(rank, w["end"], w["key"])))

        unit = F.when(room > 1, unit_of(F.get(words, at + 1)))
        in_digits = let(amount_key(word), lambda a: reading(3, at + F.when(unit.isNotNull(), 2).otherwise(1), F.coalesce(quantity_key(a, unit), a)))
        return F.array(
            F.when(is_negation(word), reading(0, at + 1, F.lit("b:true"))),
            F.when(is_side(word), reading(1, at + 1, F.concat(F.lit("t:"), side_of(word)))),
            wide(2, begins_often(word), lambda end: often(words_text(words, at, end))),
            F.when(word.rlike(f"{DIGITS}|{RATIO}"), in_digits).otherwise(
                wide(3, word.rlike(NUMBER_BEGINS), lambda end: numeric_key(words, at, end))
            ),
        )

    places = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    may = F.filter(
        places,
        lambda x: (may_be_value(x["word"]) | x["word"].rlike(NUMBER_BEGINS)) & ~F.exists(taken, lambda t: (t["start"] <= x["at"]) & (x["at"] < t["end"])),
    )
    return F.filter(F.flatten(F.transform(may, at_place)), lambda r: r["key"].isNotNull())


# JSON ----------------------------------------------------------------------------


def json_text(key: Column) -> Column:
    """A tagged value as JSON."""
    body = F.substring(key, 3, 1 << 30)
    quoted = F.regexp_extract(F.to_json(F.struct(body.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    amount = F.split(body, r"\|")
    value = F.get(amount, F.lit(0))
    value = F.when(value.contains("/"), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    measured = F.concat(F.lit('{"value": '), value, F.lit(', "unit": "'), F.get(amount, F.lit(1)), F.lit('"}'))
    return F.when(key.startswith("q:"), measured).when(key.rlike("^[nbj]:"), body).when(key.isNotNull(), quoted)
