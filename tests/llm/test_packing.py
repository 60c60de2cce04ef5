"""Packing against the library's ids, an exhaustive packer and best-fit decreasing."""

import random
import zlib
from collections import Counter
from functools import cache
from math import ceil

import numpy as np

from scribegauge.llm import packing
from scribegauge.llm.queries import tokenizer_path
from scribegauge.llm.tokens import load_tokenizer

SCHEMA = "doc_id long, text string, lang string, piece string, length double"


def held(fills, capacity):
    found = Counter()
    for fill in fills:
        assert fill.count > 0 and sum(n * times for n, times in fill.items) <= capacity
        found.update({n: 0 for n, _ in fill.items})
        for n, times in fill.items:
            found[n] += times * fill.count
    return found


def fewest(lengths, capacity):
    @cache
    def need(rest):
        if not rest:
            return 0
        found = set()

        def fill(chosen, room, at):
            if not any(n <= room for n in rest[at:]):
                found.add(chosen)
            for i in range(at, len(rest)):
                if rest[i] <= room:
                    fill((*chosen, i), room - rest[i], i + 1)

        fill((0,), capacity - rest[0], 1)
        return min(1 + need(tuple(n for i, n in enumerate(rest) if i not in chosen)) for chosen in found)

    return need(tuple(sorted(lengths, reverse=True)))


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else capacity) - n)
    return len(rooms)


def test_every_piece_once_in_few_sequences():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 11))]
        fills = packing.pack_histogram(Counter(lengths), 12)
        assert held(fills, 12) == Counter(lengths)
        assert fewest(lengths, 12) <= sum(f.count for f in fills) <= fewest(lengths, 12) + 1
    for _ in range(40):
        lengths = [rng.randint(1, 40) for _ in range(80)]
        assert sum(f.count for f in packing.best_fit(Counter(lengths), [], 40)) == plain_best_fit(lengths, 40)
    assert packing.pack_histogram({}, 12) == []


def test_program_beats_best_fit_on_large_histograms():
    rng = random.Random(1)
    many = {n: rng.randint(500, 900) for n in range(60, 240)}
    fills = packing.pack_histogram(many, 410)
    assert held(fills, 410) == Counter(many)
    bound, used = ceil(sum(n * c for n, c in many.items()) / 410), sum(f.count for f in fills)
    assert used < sum(f.count for f in packing.best_fit(many, [], 410)) and used <= bound * 1.003
    # Most of the pieces are held by configurations of the program, not by what packs the rest.
    amounts = packing.solve(many, 410)
    assert sum(a * sum(t for _, t in c) for c, a in amounts.items()) > 0.99 * sum(many.values())


def test_knapsack_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 20), 6)))
        worth = np.array([rng.random() * n for n in lengths])
        best, _ = packing.price(lengths, worth, 30)
        want = [0.0] * 31
        for room in range(1, 31):
            want[room] = max([want[room - 1], *(w + want[room - n] for n, w in zip(lengths.tolist(), worth.tolist()) if n <= room)])
        assert np.allclose(best, want)


def test_documents(spark, monkeypatch):
    rng = random.Random(9)
    words = "the naïve Straße don't 123 <|endoftext|> été of, re-use 中文 ünïcode".split()
    texts = [None, "", " ", "a " * 9000, "same text", "same text", *(" ".join(rng.choices(words, k=rng.randint(1, 700))) for _ in range(120))]
    rows = [(i, t, "en", "clash", 0.5) for i, t in enumerate(texts)] + [(None, "no id", "en", "x", 1.0), (4, "same text", "en", "clash", 0.5)]
    monkeypatch.setattr(packing, "SLICE_ROWS", 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = packing.pack_documents(frame, tokenizer_path(), 256).collect()
    tok, want = load_tokenizer(tokenizer_path()), Counter()
    for doc_id, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[doc_id, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    tokens = sum(r["length"] for r in found)
    assert len(sequences) <= ceil(tokens / 256) + 2
    empty = packing.pack_documents(frame.where("false"), tokenizer_path())
    assert empty.collect() == [] and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
