"""Packing of documents into sequences by a configuration linear program.

Documents become token ids; only those longer than a sequence are cut.  From
then on a piece matters by its length alone, so the problem is a histogram of at
most ``capacity`` entries, whatever the number of documents, and is solved on the
driver: a configuration is a multiset of lengths that fits one sequence, and the
linear program asks for the fewest configurations that hold every piece.

It is solved by multiplicative weights.  A length is worth its tokens times a
weight that falls exponentially with the share of its pieces held so far.
Pricing is a knapsack over the capacity: one dynamic program gives the dearest
configuration that contains each of the lengths.  Those within ``SLACK`` of the
dearest that leave next to nothing free are taken, each as often as the share of a length that one pass may add
allows, and never beyond the pieces that there are.  Amounts are then rounded
down, and what is left is packed best-fit decreasing, over the histogram as well,
into what the configurations leave free and into new sequences.

Pieces then take their places by rank: the pieces of one length are numbered,
by counts of slices and numbers inside a slice, and a number falls into the
stretch of one configuration, which gives sequence and offset.  No slice has many
pieces, however frequent its length.

Defined results: a null text is empty, and an empty document is its end id; a
null id stays null; repeated rows are packed each; texts are taken whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import map_rows, saved
from .tokens import OUTSIDE, PRETOKEN, is_known_kind, load_tokenizer

CAPACITY = 2048
END = 0
#: Passes of multiplicative weights at most, how fast a weight falls, and the share of a length that one pass adds.
PASSES, RATE, STEP = 240, 0.2, 0.1
#: Configurations this near to the dearest are taken in the same pass.
SLACK = 0.002
#: Share of a sequence that a configuration of the program may leave free; pieces that fit none such are packed best-fit.
MOST_FREE = 0.001
#: A length is held when no more than this share of it is not.
NEARLY = 1e-9
#: Configurations that are kept as such, most used first; the rest of the pieces is packed best-fit.
MOST_CONFIGURATIONS = 20_000
#: Pieces of one slice, on average.
SLICE_ROWS = 1_000
#: Distinct words whose ids a worker remembers in each of two generations.
CACHE_ENTRIES = 1 << 19

PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


# Tokens ------------------------------------------------------------------------


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def make_encoder(path: str) -> Callable[[str], bytes]:
    """Function from text to its token ids as little-endian 32-bit numbers."""
    tok = load_tokenizer(path)

    def in_library(text: str) -> bytes:
        return _as_bytes(tok.encode(text, add_special_tokens=False).ids)

    if not is_known_kind(path):
        return in_library
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    outside = re.compile(OUTSIDE + "".join("|" + re.escape(s) for s in specials))
    cut = regex.compile(PRETOKEN).findall
    suffix = tok.model.end_of_word_suffix
    closes = np.zeros(tok.get_vocab_size(), dtype=bool)
    closes[[i for token, i in tok.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def by_word(words: list[str]) -> list[bytes]:
        """The ids of each word, from one text of all of them: a pre-token ends with an id that closes one."""
        ids = np.array(tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(closes[ids])
        last = np.cumsum([len(cut(word)) for word in words], dtype=np.int64) - 1
        if not words or len(ends) != last[-1] + 1:
            return [_as_bytes(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
        stops, data = (4 * (ends[last] + 1)).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    # No pre-token reaches over white space, so a word between blanks has the same ids in every text.
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        nonlocal known, before
        if outside.search(text):
            return in_library(text)
        words = text.lower().split()
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE_ENTRIES:
                # Words that are still in use come back from the generation before.
                known, before = {}, known
                new = set(words)
            unseen = [word for word in new if word not in before]
            known.update((word, before[word]) for word in new.difference(unseen))
            known.update(zip(unseen, by_word(unseen)))
        return b"".join(map(known.__getitem__, words))

    return encode


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""
    end = _as_bytes([END])

    def setup():
        encode = _worker_encoder(tokenizer_path)

        def process(cols):
            out = []
            for doc_id, text in zip(*cols):
                ids = memoryview(encode(text or "") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            return out

        return process

    return map_rows(docs, ["doc_id", "text"], PIECE_DDL, _PIECE_ARROW, setup)


_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def _worker_encoder(path: str) -> Callable[[str], bytes]:
    if path not in _ENCODERS:
        _ENCODERS[path] = make_encoder(path)
    return _ENCODERS[path]


# Configurations ----------------------------------------------------------------


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the most that every capacity can hold, and the length to take first for it (-1: leave one token free)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by_length, index = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
    by_length[lengths], index[lengths] = worth, np.arange(len(lengths))
    for room in range(1, capacity + 1):
        values = by_length[1 : room + 1] + best[room - 1 :: -1]
        length = values.argmax()
        best[room] = best[room - 1]
        if values[length] > best[room]:
            best[room], take[room] = values[length], index[length + 1]
    return best, take


def _filled(lengths: np.ndarray, take: np.ndarray, room: int, first: int) -> tuple[tuple[int, int], ...]:
    """The dearest configuration that contains the length of index ``first``."""
    chosen, room = Counter([first]), room - int(lengths[first])
    while room:
        if take[room] < 0:
            room -= 1
        else:
            chosen[int(take[room])] += 1
            room -= int(lengths[take[room]])
    return tuple(sorted(chosen.items()))


def solve(histogram: dict[int, int], capacity: int, passes: int = PASSES) -> dict[tuple[tuple[int, int], ...], float]:
    """Amounts of configurations, as ``(length, times)`` tuples, that together hold as much of ``histogram`` as it has."""
    every = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in every.tolist()], dtype=float)
    held, amounts = np.zeros(len(every)), Counter()
    for _ in range(passes):
        missing = np.flatnonzero(held < demand * (1 - NEARLY))
        if not len(missing):
            break
        lengths = every[missing]
        worth = lengths * np.exp(-RATE * (held / demand)[missing])
        best, take = price(lengths, worth, capacity)
        allowed = np.minimum(STEP * demand[missing], (demand - held)[missing])
        taken = 0
        for first in np.flatnonzero(worth + best[capacity - lengths] >= (1 - SLACK) * best[capacity])[::-1]:
            if allowed[first] <= 0:
                continue
            chosen = _filled(lengths, take, capacity, int(first))
            at, times = np.array([i for i, _ in chosen]), np.array([n for _, n in chosen])
            amount = (allowed[at] / times).min()
            if capacity - lengths[at] @ times > MOST_FREE * capacity or amount <= 0:
                continue
            allowed[at] -= amount * times
            held[missing[at]] += amount * times
            amounts[tuple((int(lengths[i]), n) for i, n in reversed(chosen))] += amount
            taken += 1
        if not taken:
            break
    return amounts


class Fill(NamedTuple):
    """``count`` sequences that hold ``items``, as ``(length, times)`` in order."""

    items: tuple[tuple[int, int], ...]
    count: int


def best_fit(left: dict[int, int], open_fills: list[Fill], capacity: int) -> list[Fill]:
    """Best-fit decreasing over a histogram: alike sequences are filled together."""
    by_room: dict[int, list[Fill]] = {}
    for fill in open_fills:
        by_room.setdefault(capacity - sum(n * times for n, times in fill.items), []).append(fill)
    for length in sorted(left, reverse=True):
        rest = left[length]
        while rest:
            room = min((r for r in by_room if r >= length), default=None)
            fill = by_room[room].pop() if room is not None else Fill((), rest)
            if room is not None and not by_room[room]:
                del by_room[room]
            room = capacity if room is None else room
            times = room // length
            full = min(fill.count, rest // times)
            placed = [(times, full)] if full else []
            if full < fill.count and rest - full * times:
                part = min(times, rest - full * times)
                placed.append((part, 1))
            for n, count in placed:
                by_room.setdefault(room - n * length, []).append(Fill((*fill.items, (length, n)), count))
                rest -= n * count
            unused = fill.count - sum(count for _, count in placed)
            if unused and fill.items:
                by_room.setdefault(room, []).append(Fill(fill.items, unused))
    return [fill for fills in by_room.values() for fill in fills]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Fill]:
    """Sequences, grouped by what they hold, that hold every piece of a histogram of lengths exactly once."""
    left = Counter(histogram)
    fills = [Fill(((capacity, 1),), left.pop(capacity))] if capacity in left else []
    amounts = solve(left, capacity)
    for chosen, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0]))[:MOST_CONFIGURATIONS]:
        # What the rounding of sums took from a whole amount is given back.
        count = min(int(amount + 1e-6), *(left[n] // times for n, times in chosen))
        if count > 0:
            fills.append(Fill(chosen, count))
            left.subtract({n: times * count for n, times in chosen})
    return best_fit(+left, fills, capacity)


# Places ------------------------------------------------------------------------


def stretches(fills: list[Fill], capacity: int) -> np.ndarray:
    """One row for each length of each fill, by length and first rank: ``length, rank, times, sequence, offset``."""
    ranks, rows, sequence = Counter(), [], 0
    for fill in fills:
        offset = 0
        for length, times in fill.items:
            rows.append((length, ranks[length], times, sequence, offset))
            ranks[length] += times * fill.count
            offset += times * length
        sequence += fill.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with ``rank``, their number among those of their length; ``row`` must be unique."""
    slices = pieces.sparkSession.createDataFrame([(n, -(-c // SLICE_ROWS)) for n, c in histogram.items()], "length long, slices long")
    sliced = pieces.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices"))).drop("slices")
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("length", "slice").orderBy("row")
    numbered = sliced.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "slice"]).withColumn("rank", F.col("first") + F.col("at")).drop("slice", "at", "first")


def placed(pieces: DataFrame, table: np.ndarray) -> DataFrame:
    """Ranked pieces with ``sequence_id, offset`` from the table of stretches, whose size has a bound."""
    names = [f.name for f in _PIECE_ARROW]
    arrow = pa.schema([*_PIECE_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, times, sequence, offset = shared.value.T
        # Lengths are far apart as keys, so one search finds length and rank.
        keys, wide = length * (1 << 48) + rank, 1 << 48
        for batch in batches:
            own, at = (batch.column(name).to_numpy() for name in ("length", "rank"))
            row = np.searchsorted(keys, own * wide + at, side="right") - 1
            inner = at - rank[row]
            columns = [batch.column(name) for name in names]
            columns += [pa.array(sequence[row] + inner // times[row]), pa.array(offset[row] + inner % times[row] * own)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pieces.select(*names, "rank").mapInArrow(run, f"{PIECE_DDL}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row of ``docs``.

    ``tokenizer_path`` must be readable on the executors (it belongs to their
    Python environment).
    """
    cut = cut_documents(docs, tokenizer_path, capacity)
    # The row numbers are written down with the pieces, so they are the same for every later reader.
    pieces = saved(cut.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = stretches(pack_histogram(histogram, capacity), capacity)
    return placed(ranked(pieces, histogram), table)
