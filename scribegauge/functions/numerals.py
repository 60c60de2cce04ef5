"""German number words and decimal numbers."""

from __future__ import annotations

import functools
import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# The German words for 0 to 20 and the tens, with spelling variants.
SMALL_NUMBERS = {
    "null": 0, "ein": 1, "eins": 1, "eine": 1, "einen": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5,
    "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12, "dreizehn": 13,
    "vierzehn": 14, "fünfzehn": 15, "sechzehn": 16, "siebzehn": 17, "achtzehn": 18, "neunzehn": 19,
    "zwanzig": 20, "dreißig": 30, "dreissig": 30, "vierzig": 40, "fünfzig": 50, "sechzig": 60,
    "siebzig": 70, "achtzig": 80, "neunzig": 90,
}


@functools.cache
def number_words() -> dict[str, int]:
    """Every accepted number word from 0 to 9,999 with its value.

    The language is finite, so it is generated: ones-and-tens compounds, then
    hundreds over those, then thousands over both.  A multiplier takes an
    optional prefix of one digit word and an optional smaller remainder.
    """
    digits = {w: n for w, n in SMALL_NUMBERS.items() if 0 < n < 10}
    tens = {w: n for w, n in SMALL_NUMBERS.items() if n >= 20 and n % 10 == 0}
    words = SMALL_NUMBERS | {f"{d}und{t}": digits[d] + tens[t] for d in digits for t in tens}
    for name, size in (("hundert", 100), ("tausend", 1000)):
        heads = {name: size} | {d + name: n * size for d, n in digits.items()}
        words = words | {h + w: a + b for h, a in heads.items() for w, b in ({"": 0} | words).items()}
    return words


def number_dimension(spark: SparkSession) -> DataFrame:
    """``word, value`` for joins; about 28 thousand rows, whatever the data."""
    return spark.createDataFrame(list(number_words().items()), "word string, value long")


#: Numbers in digits, and two whole numbers over each other.
DIGITS, RATIO = re.compile(r"[+-]?\d+([.,]\d+)?"), re.compile(r"\d+/\d+")
POINT = "komma"


@functools.cache
def word_beginnings() -> frozenset[str]:
    """Every beginning of a number word: a word outside of it begins no number in words."""
    return frozenset(word[:n] for word in number_words() for n in range(1, len(word) + 1))


def in_digits(words: list[str]) -> str | None:
    """Spoken words as a numeral: a whole number in any number of words, then after ``komma`` a digit for each word."""
    point = words.index(POINT) if POINT in words[1:-1] else len(words)
    whole = number_words().get("".join(words[:point]))
    places = [SMALL_NUMBERS.get(word, 10) for word in words[point + 1 :]]
    if whole is None or any(digit > 9 for digit in places):
        return None
    return f"{whole}." + "".join(map(str, places)) if places else str(whole)


def parse_number(text: str) -> Decimal | None:
    """A number in digits or in words, else None."""
    text = text.strip().lower()
    numeral = text.replace(",", ".") if DIGITS.fullmatch(text) else in_digits(text.split())
    return None if numeral is None else Decimal(numeral)
