"""Normalization and tokenization of transcripts.

Steps: Unicode NFKC, lower case, punctuation to blanks (keeping numeric
separators between digits, a minus that signs a number, and every slash), white
space squeezed, split into tokens.  All but NFKC are built-in expressions.
Latin letters but for a few ligatures are their own NFKC form, which one regular
expression decides, so only other texts cross to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NORMALIZATION_VERSION = "de-clinical-asr-v1"

#: Punctuation that turns into a blank (after NFKC and lower-casing).
TO_BLANK = r"(?!(?<=\p{Nd})[.,:](?=\p{Nd}))(?!(?<=^|\s)-(?=\p{Nd}))(?!/)\p{P}"
#: Characters that NFKC never changes, alone or together: Latin with German, French and Spanish letters.
STABLE = r"^[\x00-\x9f¡-§©«¬®°±¶»¿-ıĴ-ľŁ-ňŊ-ž]*$"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def is_stable(text: Column) -> Column:
    """True where NFKC certainly changes nothing."""
    return text.rlike(STABLE)


def nfkc(text: Column, assume_composed: bool = False) -> Column:
    """NFKC form; only texts that it may change are sent to Python.  With ``assume_composed`` none are."""
    return text if assume_composed else F.coalesce(_nfkc(F.when(~is_stable(text), text)), text)


def normalize_text(text: Column, assume_composed: bool = False) -> Column:
    lowered = F.lower(nfkc(text, assume_composed))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, TO_BLANK, " "), r"(?U)\s+", " "))


def tokens(text: Column, assume_composed: bool = False) -> Column:
    """``array<string>`` of normalized tokens; null text gives null, blank text an empty array."""
    return F.filter(F.split(normalize_text(text, assume_composed), " "), lambda t: t != "")


#: Whatever may be punctuation.
MARK = re.compile(r"[^\w\s]|_")


def _is_blank(at: int, text: str) -> bool:
    """Whether the character at ``at`` of a lower-cased NFKC text is punctuation to blank out."""
    char = text[at]
    if char == "/" or not unicodedata.category(char).startswith("P"):
        return False
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if char in ".,:":
        return not (before.isdigit() and after.isdigit())
    return not (char == "-" and after.isdigit() and (before == "" or before.isspace()))


def normalized(text: str) -> str:
    """The normal form of one Python string, but for its white space."""
    text = unicodedata.normalize("NFKC", text).lower()
    return MARK.sub(lambda m: " " if _is_blank(m.start(), text) else m[0], text)


def tokenize(text: str) -> list[str]:
    """The same tokens for one Python string (used for surfaces and terminologies)."""
    return normalized(text).split()


Tokenizer = Callable[[str], list[str]]


def checked_tokenizer(tokenizer: Tokenizer) -> Tokenizer:
    """A plug-in tokenizer that must return a list of non-empty strings."""

    def run(text: str) -> list[str]:
        out = tokenizer(text)
        if not isinstance(out, list) or not all(isinstance(t, str) and t for t in out):
            raise ValueError("a tokenizer must return one list of non-empty string tokens")
        return out

    return run
