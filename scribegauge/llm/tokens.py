"""Exact token counts with a whole-token shortcut.

The tokenizer normalises (NFC, white space, lower case), cuts a text into
pre-tokens and merges each pre-token on its own, so a text's count is the sum
over its pre-tokens.  ``whole_tokens`` proves offline which vocabulary strings
encode alone as one token, by encoding every one of them.  Counting then looks
pre-tokens up in that set, and only the rest is merged by the library, once
per distinct string and cached in a bounded dictionary.

The own pre-tokenizer is used only on texts whose characters all lie in a
range where its normalisation and classes are the library's: code points up to
U+024F without U+0130 and without the separators U+001C to U+001F.  Any other
text, and any text with one of the tokenizer's special strings, is counted by
the library as a whole; and so are all texts where the tokenizer file names
another normalisation or pre-token pattern, or is a sentencepiece model.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id
stays null; repeated rows are counted each; long texts are counted whole.
"""

from __future__ import annotations

import functools
import json
import os
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .runtime import map_rows

#: Pre-token pattern of the tokenizer file; fixed value of its format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with a character outside this class go to the library.
OUTSIDE = r"[^\x00-\x1b\x20-įı-ɏ]"
CACHE_ENTRIES = 1 << 19
TOKEN_LIMIT = 2048

ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)


@functools.cache
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def is_known_kind(path: str) -> bool:
    """Whether the tokenizer cuts texts as this module does, by what its file says."""
    if not path.endswith(".json"):
        return False
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = (data.get("normalizer") or {}).get("normalizers", [])
    cuts = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [s["type"] for s in steps], [c["type"] for c in cuts]
    return (
        kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": PRETOKEN}, "Removed", True)
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    )


def library_counter(path: str):
    """Function from text to its number of tokens, by the library alone."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    tok = load_tokenizer(path)
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


@functools.cache
def whole_tokens(path: str) -> frozenset[str]:
    """Strings that are one pre-token and encode, alone, as exactly one token; none for an unknown kind of tokenizer."""
    if not is_known_kind(path):
        return frozenset()
    tok = load_tokenizer(path)
    suffix = tok.model.end_of_word_suffix or ""
    ends = [t for t in tok.get_vocab() if t.endswith(suffix)]
    strings = {tok.decode([tok.token_to_id(t)]).strip() for t in ends} if tok.decoder else set()
    strings |= {_unmap(t[: len(t) - len(suffix)] if suffix else t) for t in ends}
    strings = sorted(s for s in strings if s and regex.fullmatch(PRETOKEN, s))
    coded = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, coded) if len(e.ids) == 1)


@functools.cache
def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def _unmap(token: str) -> str:
    try:
        return bytes(_byte_chars()[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return ""


def make_counter(path: str, whole: frozenset[str]):
    """Function from text to its number of tokens."""
    if not is_known_kind(path):
        return library_counter(path)
    tok, in_library = load_tokenizer(path), library_counter(path)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    outside = regex.compile(OUTSIDE + "".join("|" + regex.escape(s) for s in specials))
    cut = regex.compile(PRETOKEN).findall
    known: dict[str, int] = dict.fromkeys(whole, 1)

    def count(text: str) -> int:
        if outside.search(text):
            return in_library(text)
        parts = cut(text.lower())
        found = list(map(known.get, parts))
        if None in found:
            new = list({p for p, n in zip(parts, found) if n is None})
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                known.update(dict.fromkeys(whole, 1))
                new = list(set(parts).difference(known))
            for p, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False)):
                known[p] = len(e.ids)
            found = map(known.__getitem__, parts)
        return sum(found)

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer_path`` must be readable on the executors (it belongs to their
    Python environment).  The whole-token set is broadcast; it is at most the
    tokenizer's vocabulary and does not grow with the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def setup():
        count = _worker_counter(tokenizer_path, shared)

        def process(cols):
            out = []
            for doc_id, text in zip(*cols):
                text = text or ""
                n = count(text)
                out.append((doc_id, len(text.encode()), n, n > limit))
            return out

        return process

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", ARROW, setup)


_COUNTERS: dict[str, object] = {}


def _worker_counter(path: str, shared):
    """One counter, with its cache, for each Python worker and tokenizer."""
    if path not in _COUNTERS:
        _COUNTERS[path] = make_counter(path, shared.value)
    return _COUNTERS[path]
