"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of length L occurs in a document when some stretch of it is
within ``k = error_rate * L`` edits of the item, both lower-cased and with white
space turned into single blanks.  By the q-gram lemma such a stretch shares at
least ``L - q + 1 - k q`` q-grams with the item, and their diagonals span at
most ``k + 1`` values.  Shared q-grams are counted in cells of ``k + 1``
diagonals; two adjacent cells form a band, bands overlap by half, and so one
band holds every such span.  Bands that reach the bound are verified by
alignment inside the band.  q is 8, and 5 for short items to which the lemma
would else say nothing.  Nothing is sampled: every q-gram of every document is
looked up.

Grams that an item repeats often would pair with every place of a repetitive
text.  They are not counted, and the item's bound is lowered by as many.  Items
of which nothing is left to count are told from a text by their pieces, of which
``k`` edits leave one whole, and then aligned with all of it.  Memory is linear
in text and item.

The documents are scanned once for each block of at most ``BLOCK_CHARS``
characters of the benchmark, without a shuffle; a block is broadcast.

Defined results: null or empty documents and items match nothing; items shorter
than the smaller q are looked for exactly, as the budget of so few characters is
zero; repeated items and rows are reported each; texts and items of any length
are compared whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_rows

Q, SHORT_Q = 8, 5
ERROR_RATE = 0.1
BLOCK_CHARS = 4_000_000
FILTER_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Grams that occur more often than this in an item are not counted.
MOST_REPEATS = 8
#: Grams of a text that are looked up at once.
TEXT_CHUNK = 1 << 16


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_budget(length: int, error_rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item."""
    return int(length * error_rate)


def gram_size(length: int, budget: int) -> int:
    """The q with which the lemma asks an item for one shared gram at least, or 0 for items to look for otherwise."""
    return next((q for q in (Q, SHORT_Q) if length - q + 1 - budget * q >= 1), 0)


def q_grams(text: str, q: int = Q) -> np.ndarray:
    """Codes of all q-grams, q up to 8; each character is folded to one byte, which can only add matches."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < q:
        return np.empty(0, dtype=np.uint64)
    codes = ((points ^ (points >> np.uint32(8)) * np.uint32(37)) & np.uint32(255)).astype(np.uint8)
    codes = np.append(codes, np.zeros(8 - q, np.uint8))
    return np.ndarray(shape=(len(points) - q + 1,), dtype="<u8", buffer=codes, strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def slots_of(grams: np.ndarray) -> np.ndarray:
    return (grams * MULTIPLIER) >> np.uint64(64 - FILTER_BITS)


def _counted(grams: np.ndarray) -> np.ndarray:
    """Places of the grams that an item does not repeat too often."""
    _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
    return np.flatnonzero(times[which] <= MOST_REPEATS) if len(grams) else np.empty(0, np.int64)


@dataclass
class Grams:
    """The grams of some items for one q, in compressed rows that lie in the order of their filter slots."""

    q: int
    items: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    longest: int
    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    slot_at: np.ndarray
    chain: int

    @classmethod
    def build(cls, q: int, numbers: list[int], texts: list[str], budgets: list[int]) -> tuple[Grams, list[int]]:
        """The grams of the items that have something to count, and the other items."""
        kept, places, coded, bounds = [], [], [], []
        for n in numbers:
            grams = q_grams(texts[n], q)
            place = _counted(grams)
            bound = len(place) - budgets[n] * q
            if bound >= 1:
                kept.append(n)
                places.append(place)
                coded.append(grams[place])
                bounds.append(bound)
        every = np.concatenate([*coded, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(kept)), [len(c) for c in coded])
        order = np.lexsort((every, slots_of(every)))
        ordered = every[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        grams = ordered[starts]
        slots, first, chain = np.unique(slots_of(grams), return_index=True, return_counts=True)
        slot_at = np.full(1 << FILTER_BITS, -1, dtype=np.int32)
        slot_at[slots] = first
        made = cls(
            q, np.array(kept, np.int64), np.array([budgets[n] for n in kept], np.int64), np.array(bounds, np.int64),
            max((len(texts[n]) for n in kept), default=0), grams, np.append(starts, len(order)).astype(np.int64), owner[order],
            np.concatenate([*places, np.empty(0, np.int64)])[order], slot_at, int(chain.max(initial=0)),
        )
        return made, sorted(set(numbers) - set(kept))

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``grams`` that are grams of items, and their rows."""
        row = self.slot_at[slots_of(grams)]
        at = np.flatnonzero(row >= 0)
        row, sought = row[at], grams[at]
        matched = self.grams[row] == sought
        rest = np.flatnonzero(~matched)
        for _ in range(1, self.chain):  # later grams of the same slot
            row[rest] = np.minimum(row[rest] + 1, len(self.grams) - 1)
            good = self.grams[row[rest]] == sought[rest]
            matched[rest[good]] = True
            rest = rest[~good]
        return at[matched], row[matched]

    def bands(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(item number, lowest diagonal, its budget)`` of the bands that reach the item's bound, by item and diagonal."""
        grams = q_grams(text, self.q)
        stride = np.int64(len(text) + 2 * self.longest + 4)
        keys, counts = [], []
        for start in range(0, len(grams), TEXT_CHUNK):
            at, row = self.shared(grams[start : start + TEXT_CHUNK])
            count = self.starts[row + 1] - self.starts[row]
            if not len(count):
                continue
            posting = np.repeat(self.starts[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            item = self.item[posting]
            # Diagonals are shifted by the longest item, so that cells count from zero.
            shifted = np.repeat(at + start, count) - self.place[posting] + np.int64(self.longest)
            key, found = np.unique(item * stride + shifted // (self.budget[item] + 1), return_counts=True)
            keys.append(key)
            counts.append(found)
        if not keys:
            return
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        owner, paired = key // stride, found.copy()
        adjacent = (key[1:] == key[:-1] + 1) & (owner[1:] == owner[:-1])
        paired[:-1][adjacent] += found[1:][adjacent]
        for i in np.flatnonzero(paired >= self.bound[owner]).tolist():
            own, budget = int(owner[i]), int(self.budget[owner[i]])
            yield int(self.items[own]), int(key[i] - owner[i] * stride) * (budget + 1) - self.longest, budget


@dataclass
class Index:
    """A block of items, for the search of texts."""

    ids: list[int]
    texts: list[str]
    budgets: list[int]
    exact: list[int]
    whole: list[int]
    grams: list[Grams]

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], rate: float = ERROR_RATE) -> Index:
        known = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
        texts = [t for _, t in known]
        budgets = [edit_budget(len(t), rate) for t in texts]
        by_size: dict[int, list[int]] = {}
        for n, text in enumerate(texts):
            by_size.setdefault(gram_size(len(text), budgets[n]), []).append(n)
        rest, made = by_size.pop(0, []), []
        for q, numbers in by_size.items():
            grams, repetitive = Grams.build(q, numbers, texts, budgets)
            made.append(grams)
            rest += repetitive
        exact = [n for n in rest if budgets[n] == 0]
        return cls([i for i, _ in known], texts, budgets, exact, [n for n in rest if budgets[n]], made)

    def found(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """``(item number, edits, start, end)`` of stretches that are near enough; an item may come several times."""
        perfect: set[int] = set()
        for grams in self.grams:
            for n, low, budget in grams.bands(text):
                if n in perfect:
                    continue
                item = self.texts[n]
                begin, end = max(0, low - budget), min(len(text), low + 2 * (budget + 1) + len(item) + budget)
                near = best_stretch(item, text[begin:end], budget)
                if near is not None:
                    yield n, near[2], begin + near[0], begin + near[1]
                    if near[2] == 0:  # bands come in order, so this is the first whole one
                        perfect.add(n)
        for n in self.exact:
            start = text.find(self.texts[n])
            if start >= 0:
                yield n, 0, start, start + len(self.texts[n])
        for n in self.whole:
            if any(piece in text for piece in pieces(self.texts[n], self.budgets[n] + 1)):
                near = best_stretch(self.texts[n], text, self.budgets[n])
                if near is not None:
                    yield n, near[2], near[0], near[1]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, edits)``: the best stretch of each item that occurs in ``text``."""
        best: dict[int, tuple[int, int, int]] = {}
        for n, *here in self.found(text):
            best[n] = min(best.get(n, tuple(here)), tuple(here))
        return [(self.ids[n], start, end, edits) for n, (edits, start, end) in sorted(best.items())]

    def occurs(self, text: str) -> bool:
        """Whether any item occurs in ``text``."""
        return next(self.found(text), None) is not None


def pieces(item: str, number: int) -> set[str]:
    """An item cut into ``number`` pieces of about the same length; ``number - 1`` edits leave one whole."""
    cuts = [len(item) * i // number for i in range(number + 1)]
    return {item[a:b] for a, b in zip(cuts, cuts[1:])}


def distances(item: str, text: str, anchored: bool) -> Iterator[int]:
    """Edits between ``item`` and the nearest stretch of ``text`` that ends at each character, one begun at its start if ``anchored``.

    A column of the distance table is two bit vectors, of its rises and falls.
    """
    where: dict[str, int] = {}
    for i, char in enumerate(item):
        where[char] = where.get(char, 0) | 1 << i
    every, last = (1 << len(item)) - 1, 1 << len(item) - 1
    rise, fall, edits = every, 0, len(item)
    for char in text:
        same = where.get(char, 0)
        level = ((same & rise) + rise ^ rise) | same | fall
        up, down = fall | every & ~(level | rise), level & rise
        edits += bool(up & last) - bool(down & last)
        up, down = up << 1 | anchored, down << 1
        rise, fall = (down | ~(level | up)) & every, up & level & every
        yield edits


def best_stretch(item: str, region: str, budget: int) -> tuple[int, int, int] | None:
    """``(start, end, edits)`` of the first stretch of ``region`` nearest to ``item``, if within ``budget`` edits.

    The region is a diagonal band, so its free start and end make the alignment
    banded.  The start is found by aligning backwards from the end.
    """
    exact = region.find(item)
    if exact >= 0:
        return exact, exact + len(item), 0
    if len(region) < len(item) - budget:
        return None
    edits, end = min(((d, i) for i, d in enumerate(distances(item, region, False), 1)), default=(budget + 1, 0))
    if edits > budget:
        return None
    back = distances(item[::-1], region[:end][::-1], True)
    return end - next((i for i, d in enumerate(back, 1) if d == edits), 0), end, edits


MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def benchmark_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``chars`` characters, one at a time; an empty benchmark has none."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    block = F.pmod(F.xxhash64("text"), F.lit(n))
    found = ([(r[0], r[1]) for r in items.where(block == i).orderBy("item_id", "text").collect()] for i in range(n))
    return (b for b in found if b)


def find_matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: one row per document row and item found in it.

    Offsets count code points of the normalised text.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, start long, end long, edits int")
    for block in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index.build(block, rate))

        def setup(shared=shared):
            index = shared.value
            return lambda cols: [(i, *m) for i, t in zip(*cols) if t for m in index.search(normalise(t))]

        out = out.unionAll(map_rows(docs, ["doc_id", "text"], out.schema.simpleString()[7:-1].replace(":", " "), MATCHES, setup))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, unchanged and without a shuffle."""
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index.build(block, rate))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                keep = [not index.occurs(normalise(t.as_py())) for t in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
