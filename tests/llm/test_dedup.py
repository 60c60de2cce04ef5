"""Line deduplication and SimHash groups against brute force."""

import random

import xxhash

from scribegauge.llm import line_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], DOCS)


def later_lines(rows):
    lines = sorted({(i, k, tuple(x.split())) for i, t in rows if i is not None for k, x in enumerate((t or "").encode().lower().split(b"\n"))})
    lines = [(i, k, frozenset(w)) for i, k, w in lines if len(w) >= line_dedup.MIN_WORDS]
    gone = {}
    for n, (i, k, s) in enumerate(lines):
        match = next(((a, b) for a, b, t in lines[:n] if 5 * len(s & t) >= 4 * len(s | t)), None)
        if match:
            gone[i, k] = match
    return gone


def make_lines(rng, n):
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 24))) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice("klmnop") * rng.randint(1, 4)
            lines.append("  ".join(words))
        rows.append((i * 3, "\n".join(lines)))
    return rows


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    rows = make_lines(rng, 150) + [(1000, None), (1001, ""), (1002, "\n\n"), (None, rows_text()), (1003, rows_text()), (1003, rows_text()), (1004, rows_text().upper())]
    expected = later_lines(rows)
    for short, long in ((64, 4096), (2, 20), (2, 3)):
        found = line_dedup.find_later_matches(frame(spark, rows), short_run=short, long_run=long).collect()
        got = {(r["doc_id"], r["line_no"]): (r["match_doc_id"], r["match_line_no"]) for r in found}
        assert got == expected and len(expected) > 50


def rows_text():
    return "one two three four five\nshort line\nsix seven eight nine ten eleven"


def test_removed_lines_and_documents(spark):
    text = rows_text()
    rows = [(1, text), (2, text + "\nsomething new"), (3, text), (4, None), (5, ""), (6, "short line"), (7, "One two three four five")]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.remove_later_lines(frame(spark, rows)).collect()}
    assert kept == {1: text, 2: "short line\nsomething new", 3: "short line", 4: None, 5: "", 6: "short line"}
    report = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.line_report(frame(spark, rows)).collect()}
    assert report[2] == (4, 2) and report[1] == (3, 0) and report[4] == (1, 0)
    assert line_dedup.remove_later_lines(frame(spark, [])).isEmpty()


def test_long_line(spark):
    words = [f"w{i}" for i in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[: len(words) // 2]))]
    assert {(r["doc_id"], r["match_doc_id"]) for r in line_dedup.find_later_matches(frame(spark, rows)).collect()} == {(2, 1)}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "A b", "a B c d", "x " * 70_000, "é É\u00a0b c\x0bd", "a a a a"):
        assert simhash.fingerprint((text or "").encode()) & (2**64 - 1) == fingerprint(text)


def test_links_match_brute_force(spark):
    rng = random.Random(9)
    points = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63}
    for p in list(points)[:120]:
        for _ in range(4):
            q = p
            for _ in range(rng.randint(1, 5)):
                q ^= 1 << rng.randrange(64)
            points.add(q)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in points}
    df = spark.createDataFrame([(i, signed[p]) for i, p in enumerate(points)], "id long, fp long")
    ids = list(points)
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in simhash.links(df).collect())
    assert got == sorted((i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if (ids[i] ^ ids[j]).bit_count() <= 3)


def test_groups(spark):
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(900)]
    near = words[:450] + ["new"] + words[451:]
    rows = [(5, " ".join(words)), (3, " ".join(words).upper()), (9, " ".join(near)), (1, None), (2, ""), (None, " ".join(words)), (7, "a b"), (7, "a b")]
    marks = {i: fingerprint(t) for i, t in rows}
    got = [(r["doc_id"], r["component_id"]) for r in simhash.group_documents(frame(spark, rows)).collect()]
    linked = (marks[5] ^ marks[9]).bit_count() <= 3
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3 if linked else 9), (1, 1), (2, 1), (None, None), (7, 7), (7, 7)], key=str)
    kept = sorted((r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([3, 1, None, 7, 7] + [9] * (not linked), key=str)
    assert simhash.group_documents(frame(spark, [])).isEmpty()
