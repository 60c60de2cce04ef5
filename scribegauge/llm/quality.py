"""Quality rules: fixed base rules and a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and words in repeated 5-word
windows.  The method then compares two multinomials over hashed character
n-grams: a trusted target (documents labelled good) and the raw corpus (all
documents).  A document's score is the mean log ratio of its n-grams, so it
does not depend on length, and one threshold decides on every document.

The target counts and the threshold cover every labelled document, the raw
counts all rows.  What a task sends on is at most one row per bucket; labelled
ids are broadcast if their measured size allows it and joined by a shuffle
otherwise.

Defined results: a null text has no words and fails the base rules; a text
shorter than one n-gram scores 0; repeated rows are judged alike and counted
each; with no labelled good documents every score is 0 and the method keeps
all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, free, map_rows, saved

BITS = 16
GRAM = 4
#: Share of trusted documents above their low end, and of bad ones below their high end.
KEEP_TRUSTED = 0.995
ASIDE, LEAST_ASIDE = 5, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 5
#: How far around a quantile, as a share of the rows, its value is looked for.
BRACKET = 0.001


def gram_buckets(data: bytes) -> np.ndarray:
    """Bucket of each 4-byte n-gram of a text."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(raw) < GRAM:
        return np.empty(0, dtype=np.uint32)
    word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    return (word * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur at least twice, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = (mixed ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    starts = np.flatnonzero(maybe).tolist()
    keys = [tuple(words[i : i + window]) for i in starts]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, key in zip(starts, keys):
        if seen[key] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    words = data.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(SPACES.encode())]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``bucket, target, n``: n-grams of the rows, by bucket and the flag ``target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1)):
                got = gram_buckets((text.as_py() or "").encode())
                one = np.bincount(got, minlength=1 << BITS)
                total[0] += one
                if target.as_py():
                    total[1] += one
        for flag in (0, 1):
            at = np.flatnonzero(total[flag])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(np.full(len(at), bool(flag))), pa.array(total[flag][at], pa.int64())],
                    names=["bucket", "target", "n"],
                )

    counted = docs.select("text", "target").mapInArrow(run, "bucket int, target boolean, n long")
    return counted.groupBy("bucket", "target").agg(F.sum("n").alias("n"))


def labelled_ids(labels: DataFrame, quality: int) -> DataFrame:
    """All ids with this label."""
    return labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def quantile(scores: DataFrame, q: float) -> float | None:
    """Exact quantile of ``score``, interpolated at ``(n - 1) q``; null if there are no rows.

    Approximate quantiles bracket it; only the distinct values between them, a
    small share of the rows, are counted one by one.
    """
    bracket = F.percentile_approx("score", [max(q - BRACKET, 0.0), min(q + BRACKET, 1.0)], 10_000)
    n, ends = scores.agg(F.count("score"), bracket).first()
    if not n:
        return None
    position = (n - 1) * q
    ranks = int(np.floor(position)), int(np.ceil(position))
    # Few rows may leave a rank outside, and then all are looked at.
    low, high = ends if n * BRACKET > 100 else (-np.inf, np.inf)
    below = scores.where(F.col("score") < low).count()
    counted = scores.where(F.col("score").between(low, high)).groupBy("score").count().orderBy("score").collect()
    upto = below + np.cumsum([r["count"] for r in counted])
    a, b = (counted[int(np.searchsorted(upto, rank, side="right"))]["score"] for rank in ranks)
    return a if ranks[0] == ranks[1] else (ranks[1] - position) * a + (position - ranks[0]) * b


def fit_ratio(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio per bucket and the threshold on the mean.

    One trusted document in ``ASIDE``, by hash, makes no part of the trusted
    multinomial and is judged for the threshold; with fewer trusted ones than
    ``LEAST_ASIDE`` all of them serve for both.
    The threshold lies half-way between the low end of trusted documents and
    the high end of those labelled bad, or, where the two overlap or no bad
    labels exist, at the low end of the trusted ones.
    """
    good = saved(labelled_ids(labels, 1).withColumn("target", F.lit(True)))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ASIDE)) == 0
    apart = good.count() >= LEAST_ASIDE
    trusted, judged = (good.where(~aside), good.where(aside)) if apart else (good, good)
    sample = saved(judged.unionByName(labelled_ids(labels, 0).withColumn("target", F.lit(False))))
    flagged = docs.select("doc_id", "text").join(broadcast_if_small(trusted), "doc_id", "left")
    counts = np.zeros((2, 1 << BITS))
    for row in bucket_counts(flagged).collect():  # at most two rows per bucket
        counts[int(row["target"]), row["bucket"]] = row["n"]
    raw, target = counts
    if not target.sum():
        free(good, sample)
        return np.zeros(1 << BITS), -np.inf
    smooth = 0.5
    p = (target + smooth) / (target.sum() + smooth * len(target))
    q = (raw + smooth) / (raw.sum() + smooth * len(raw))
    ratio = np.log(p) - np.log(q)
    known = docs.select("doc_id", "text").join(broadcast_if_small(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    scored = score_rows(known, ratio, -np.inf).where(~F.col("base_failed")).select("doc_id", "score")
    scored = saved(scored.join(broadcast_if_small(sample), "doc_id").select("target", "score"))
    low, high = quantile(scored.where("target"), 1 - KEEP_TRUSTED), quantile(scored.where(~F.col("target")), KEEP_TRUSTED)
    free(good, sample, scored)
    if low is None:
        return ratio, -np.inf
    return ratio, (low + high) / 2 if high is not None and high < low else low


ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def score_rows(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def setup():
        ratios = table.value

        def process(cols):
            out = []
            for doc_id, text in zip(*cols):
                text = text or ""
                data = text.encode()
                base = base_counts(text, data)
                grams = gram_buckets(data)
                score = float(ratios[grams].mean()) if len(grams) else 0.0
                failed = base_fails(base[0], base[4])
                out.append((doc_id, *base, failed, not failed and score >= threshold, score))
            return out

        return process

    return map_rows(docs, ["doc_id", "text"], SCHEMA, ARROW, setup)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, score and verdict for every row of ``docs``."""
    ratio, threshold = fit_ratio(docs, labels)
    return score_rows(docs, ratio, threshold)
