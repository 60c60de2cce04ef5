"""Line deduplication of every line, by the registered query and the pipeline stage."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import line_dedup_stage
from scribegauge.llm import line_dedup
from scribegauge.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def every_later_line(rows):
    lines = sorted((i, k, frozenset(x.split())) for i, t in rows for k, x in enumerate(t.lower().split("\n")) if x.split())
    gone = {}
    for n, (i, k, s) in enumerate(lines):
        match = next(((a, b) for a, b, t in lines[:n] if 5 * len(s & t) >= 4 * len(s | t)), None)
        if match:
            gone[i, k] = match
    return gone


def test_every_line_is_judged(spark, tmp_path):
    rng = random.Random(7)
    short = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = [(i, "\n".join(rng.choices(short, k=4))) for i in range(60)]
    # Four of five words are just similar enough.
    rows += [(100, "z y x w"), (101, "w x y z v"), (102, "short line\none two three four five six"), (103, "short line\none two three four five six")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    report = QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()
    got = {(r["doc_id"], x["line_no"]): (x["match_doc_id"], x["match_line_no"]) for r in report for x in r["removed"] or ()}
    assert got == every_later_line(rows) and got[101, 0] == (100, 0) and got[103, 0] == (102, 0)
    left = {r["doc_id"] for r in line_dedup_stage(spark, frame(spark, rows), "").collect()}
    assert left == {i for i, t in rows if any((i, k) not in got for k in range(len(t.split("\n"))))} and 103 not in left


def near_copies(rng, n):
    """Lines of one group whose changed words share two bits of the bitmap, so that many wrong lines pass it."""
    words = [w for w in (f"w{i}" for i in range(4000)) if line_dedup.hash_words(w.encode())[0][0] & 63 < 2]
    base, other = words[:14], words[14:24]
    rows = []
    for i in range(n):
        line = list(base)
        for _ in range(rng.randint(1, 4)):
            line[rng.randrange(len(line))] = rng.choice(other)
        rows.append((i, " ".join(line)))
    return rows


def test_candidates_of_long_lists_before_a_failed_one(spark):
    rows = near_copies(random.Random(3), 150)
    expected = every_later_line(rows)
    for long in (12, 30):
        found = line_dedup.find_later_matches(frame(spark, rows), long_run=long).collect()
        assert {(r["doc_id"], r["line_no"]): (r["match_doc_id"], r["match_line_no"]) for r in found} == expected


def test_scan_leaves_every_long_list(spark):
    rows = [(w, i) for w in range(6) for i in range(3 + 4 * (w % 2))]
    word, doc = (np.array(x) for x in zip(*rows))
    same = {x: np.zeros(len(word), np.int64) for x in ("key", "line", "at", "bits")}
    block = line_dedup.pack({"word": word, "doc": doc, "n": np.full(len(word), 10)} | same, line_dedup.POSTING)
    posted = spark.createDataFrame([(0, len(word), bytearray(block))], "bucket int, n long, block binary")
    for most, left, kept in ((1000, {1, 3, 5}, {0, 2, 4}), (10, set(range(6)), set())):
        found = line_dedup.scan_blocks(posted, 0.8, short_run=2, long_run=5, most=most).collect()
        words = {k: {w for r in found if r["kind"] == k for w in line_dedup.unpack(r["block"], line_dedup.POSTING)["word"].tolist()} for k in (line_dedup.LEFT_OUT, line_dedup.SCANNED)}
        assert words == {line_dedup.LEFT_OUT: left, line_dedup.SCANNED: kept}
        pairs = {(r["b_doc"], r["a_doc"]) for r in found if r["kind"] == line_dedup.CANDIDATE and r["a_doc"] is not None}
        assert pairs == ({(1, 0), (2, 0)} if kept else set())


def test_rows_with_one_id_and_other_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (None, a)]
    left = line_dedup.remove_later_lines(frame(spark, rows).withColumn("_ld_key", F.lit("x")), min_words=1).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["_ld_key"]) for r in left) == [(0, a, "x"), (1, a, "x"), (2, b, "x"), (2, b, "x")]
    report = [(r["doc_id"], r["n_removed"]) for r in line_dedup.line_report(frame(spark, rows)).collect() if r["doc_id"]]
    assert sorted(report) == [(1, 0), (2, 0), (2, 0), (2, 1), (3, 1)]


def test_words_of_any_length():
    words = ["a", "é", "abcdefgh", "abcdefghi", "x" * 17, "y" * 1024, "z" * 1025, "z" * 1026, "A"]
    hashes, line = line_dedup.hash_words(("\n \x0b".join(words) + "\n").encode())
    assert len(set(hashes.tolist())) == len(words) - 1 and hashes[0] == hashes[-1] and line.tolist() == list(range(len(words)))
    assert len(line_dedup.hash_words(b" \n\t")[0]) == 0
