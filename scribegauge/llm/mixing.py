"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised.  The
exponent lies between 0 (all sources alike) and 1 (as they come); bisection
finds the one that meets a target entropy, or the smallest one that keeps every
source within a repetition limit.  With a token budget ``B`` a source of weight
``w`` and ``t`` tokens is repeated ``r = w B / t`` times: ``floor(r)`` whole
permutations of its documents, then one more that is cut where the rest of its
budget is spent.  Without a budget, ``B`` is the smallest that takes every
document at least once.

Permutations are by hash of row and epoch, so nothing is sorted as a whole.  A
cut permutation is a prefix of its order.  Where it ends is found by sums over
slices of the hash range, as many as the square root of the source's rows; only
the slice that holds the end is ordered row by row, so the result is the same
for any number of slices.  ``position`` interleaves the sources: ordering by it
gives each source its weight in every stretch of the output.

The sources' sums stay a table: the exponent is sought by evaluating many at
once over it, and the plan made from it by expressions, so their number has no
bound; the plan is broadcast if its measured size is small, else joined.

Defined results: a null source is a source of its own; null and empty texts
have no tokens and come with every epoch, the cut one included if they lie
before the cut; repeated rows are taken each and tie, which cannot change the
result as they are equal; sources without tokens are taken once; an empty table
gives no rows; columns ``n_tokens, epoch, position`` of the input are replaced,
other columns pass through, and names that start with ``_mx_`` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, saved

MAX_REPETITION = 2.0
SEED = 20
#: Bits of the hash that orders rows.
ORDER_BITS = 53
#: Exponents evaluated in one pass over the sources, and passes.
WAYS, PASSES = 64, 10


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def weights(tokens: Sequence[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [x / sum(raw) for x in raw]


def entropy(shares: Sequence[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def repetitions(tokens: Sequence[int], shares: Sequence[float], budget: float | None) -> list[float]:
    """Times each source is taken; without a budget, just enough for once each."""
    rates = [w / t if t else 0.0 for w, t in zip(shares, tokens)]
    budget = budget if budget is not None else 1 / min(r for r in rates if r)
    return [r * budget for r in rates]


def _search(too_flat: Callable[[list[float]], list[bool]], ways: int, passes: int) -> float:
    """The least exponent in [0, 1] that is not too flat, narrowed to one of ``ways`` parts in each pass."""
    low, high = 0.0, 1.0
    if not too_flat([0.0])[0]:
        return 0.0
    for _ in range(passes):
        inner = [low + (high - low) * i / ways for i in range(1, ways)]
        flat = too_flat(inner)
        edges = [low, *inner, high]
        first = next((i for i, bad in enumerate(flat) if not bad), len(flat))
        low, high = edges[first], edges[first + 1]
    return high


def _one_target(target_entropy: float | None, max_repetition: float | None) -> None:
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give a target entropy or a repetition limit")


def solve_exponent(
    tokens: Sequence[int],
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
    steps: int = 60,
) -> float:
    """Exponent in [0, 1] by bisection, for a list of sources.

    Entropy falls and the least repetition spread shrinks as the exponent
    grows, so both targets have one crossing.  A target beyond either end gives
    that end.
    """
    _one_target(target_entropy, max_repetition)

    def too_flat(exponents: list[float]) -> list[bool]:
        shares = [weights(tokens, e) for e in exponents]
        if target_entropy is not None:
            return [entropy(s) > target_entropy for s in shares]
        return [max(repetitions(tokens, s, budget)) > max_repetition for s in shares]

    return _search(too_flat, 2, steps)


def _evaluated(stats: DataFrame, exponents: list[float]) -> list[dict]:
    """For each exponent, over sources ``t`` and logarithms of shares ``x``: the sum of powers, the entropy, and the least and largest power for each token."""
    each = stats.select("t", "x", F.explode(F.array(*map(F.lit, exponents))).alias("e"))
    power = F.exp(F.col("e") * F.col("x"))
    found = each.groupBy("e").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("x")).alias("y"),
        F.min(power / F.col("t")).alias("least"), F.max(power / F.col("t")).alias("most"),
    )
    by_exponent = {r["e"]: r.asDict() for r in found.collect()}
    return [by_exponent[e] | {"entropy": math.log(by_exponent[e]["z"]) - e * by_exponent[e]["y"] / by_exponent[e]["z"]} for e in exponents]


def slice_bits(rows: Column) -> Column:
    """Logarithm of the number of slices of a source."""
    return F.ceil(F.log2(F.greatest(rows, F.lit(1))) / 2).cast("int")


def _plan(sized: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> DataFrame:
    """``source, whole epochs, token budget of the cut epoch, repetitions, slices`` by source."""
    stats = saved(sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")))
    total = stats.agg(F.sum("t")).first()[0] or 0
    with_tokens = stats.where("t > 0").select("t", F.log(F.col("t") / F.lit(float(total or 1))).alias("x"))
    times = F.lit(1.0)
    if total:

        def too_flat(exponents: list[float]) -> list[bool]:
            found = _evaluated(with_tokens, exponents)
            if target_entropy is not None:
                return [r["entropy"] > target_entropy for r in found]
            most = [r["most"] / r["least"] if budget is None else budget * r["most"] / r["z"] for r in found]
            return [m > max_repetition for m in most]

        exponent = _search(too_flat, WAYS, PASSES)
        at = _evaluated(with_tokens, [exponent])[0]
        scale = 1 / at["least"] if budget is None else budget / at["z"]
        power = F.exp(F.lit(exponent) * F.log(F.col("t") / F.lit(float(total)))) / F.col("t")
        times = F.when(F.col("t") > 0, power * F.lit(scale)).otherwise(1.0)
    planned = stats.withColumn("_mx_times", times).withColumn("_mx_whole", F.floor(F.col("_mx_times") + 1e-9))
    rest = F.greatest(F.lit(0.0), F.col("_mx_times") - F.col("_mx_whole")) * F.col("t")
    return planned.select(
        F.col("source").alias("_mx_source"), "_mx_whole", F.floor(rest + 1e-6).alias("_mx_cut"), "_mx_times", slice_bits(F.col("n")).alias("_mx_bits")
    )


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget_tokens: float | None = None,
) -> DataFrame:
    """The rows of ``docs`` as they are taken, with ``n_tokens, epoch, position``.

    One of ``target_entropy`` (nats) and ``max_repetition`` must be given.
    """
    _one_target(target_entropy, max_repetition)
    sized = docs.select("source", token_count(F.col("text")).alias("n_tokens"))
    plan = broadcast_if_small(saved(_plan(sized, target_entropy, max_repetition, budget_tokens)))
    names = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch", "position")]
    counted = docs.select(*(F.col(f"`{c}`") for c in names), token_count(F.col("text")).alias("n_tokens"))
    joined = counted.join(plan, F.col("source").eqNullSafe(F.col("_mx_source")))
    placed = joined.withColumn("_mx_hash", _order("doc_id", "text", F.col("_mx_whole")))
    placed = placed.withColumn("_mx_slice", F.expr(f"shiftright(_mx_hash, {ORDER_BITS} - _mx_bits)"))
    partial = placed.where("_mx_cut > 0").groupBy("_mx_source", "_mx_slice").agg(F.sum("n_tokens").alias("t"), F.first("_mx_cut").alias("cut"))
    upto = Window.partitionBy("_mx_source").orderBy("_mx_slice")
    sums = partial.withColumn("upto", F.sum("t").over(upto))
    # The slice of the cut is the first whose running sum exceeds the budget.
    cuts = sums.where("upto > cut").groupBy("_mx_source").agg(
        F.min("_mx_slice").alias("_mx_edge"), (F.min("upto") - F.min_by("t", "_mx_slice")).alias("_mx_before")
    )
    edges = broadcast_if_small(saved(cuts.select(F.col("_mx_source").alias("_mx_edge_source"), "_mx_edge", "_mx_before")))
    marked = placed.join(edges, F.col("_mx_source").eqNullSafe(F.col("_mx_edge_source")), "left")
    inside = F.col("_mx_cut") > 0
    at_edge = F.coalesce(inside & (F.col("_mx_slice") == F.col("_mx_edge")), F.lit(False))
    clear = marked.where(~at_edge).withColumn(
        "_mx_taken", inside & (F.col("_mx_edge").isNull() | (F.col("_mx_slice") < F.col("_mx_edge")))
    )
    running = Window.partitionBy("_mx_source").orderBy("_mx_hash", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.where(at_edge).withColumn("_mx_taken", F.sum("n_tokens").over(running) + F.col("_mx_before") <= F.col("_mx_cut"))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("_mx_whole") + F.when(F.col("_mx_taken"), 0).otherwise(-1))
    some = (F.col("_mx_whole") > 0) | F.col("_mx_taken")
    drawn = clear.unionByName(edge).where(some).withColumn("epoch", F.explode(epochs))
    unit = _order("doc_id", "text", F.col("epoch")) / F.lit(float(1 << ORDER_BITS))
    position = (F.col("epoch") + unit) / F.greatest(F.col("_mx_times"), F.col("_mx_whole").cast("double"), F.lit(1e-9))
    return drawn.withColumn("position", position).select(*(F.col(f"`{c}`") for c in names), "n_tokens", "epoch", "position")


def _order(doc_id: str, text: str, epoch: Column) -> Column:
    """Number of ``ORDER_BITS`` bits that orders the rows of a source within an epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text), epoch), 64 - ORDER_BITS)
