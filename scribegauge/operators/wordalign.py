"""Word alignment of token arrays.

The full alignment (with its tie-break) is an Arrow function without a shuffle,
as steps (:func:`with_alignment`) or as links for scoring (:func:`linked`).
Counts alone come from :func:`edit_distance`, a fold of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

EQUAL, SUBSTITUTE, DELETE, INSERT = "equal", "substitute", "delete", "insert"


@dataclass(frozen=True)
class Alignment:
    """Steps ``(reference index, hypothesis index, operation, reference boundary)`` in order."""

    steps: list[tuple[int | None, int | None, str, int]]
    ref_to_hyp: list[int | None]
    hyp_to_ref: list[int | None]

    def count(self, operation: str) -> int:
        return sum(step[2] == operation for step in self.steps)

    def project(self, start: int, end: int) -> tuple[int, int] | None:
        """Hypothesis span of a reference span; insertions count only strictly inside.

        A wholly deleted span has none.
        """
        if not 0 <= start < end <= len(self.ref_to_hyp):
            raise ValueError(f"invalid reference span [{start}, {end})")
        found = [h for h in self.ref_to_hyp[start:end] if h is not None]
        found += [h for _, h, op, at in self.steps if op == INSERT and start < at < end]
        return (min(found), max(found) + 1) if found else None


def align_tokens(ref: Sequence[str], hyp: Sequence[str]) -> Alignment:
    """Minimum-edit alignment with unit costs.

    Common ends are matched first.  Ties go, read from the end, to a deletion,
    then to an insertion, then to the diagonal.  Memory is two bits for each
    cell of the differing middle.
    """
    head = next((i for i, (a, b) in enumerate(zip(ref, hyp)) if a != b), min(len(ref), len(hyp)))
    rest = min(len(ref), len(hyp)) - head
    tail = next((i for i in range(rest) if ref[-1 - i] != hyp[-1 - i]), rest)
    moves = [*[EQUAL] * head, *_middle(ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]), *[EQUAL] * tail]
    steps, to_hyp, to_ref = [], [], []
    for move in moves:
        i, j = len(to_hyp), len(to_ref)
        steps.append((None if move == INSERT else i, None if move == DELETE else j, move, i))
        if move != INSERT:
            to_hyp.append(None if move == DELETE else j)
        if move != DELETE:
            to_ref.append(None if move == INSERT else i)
    return Alignment(steps, to_hyp, to_ref)


def _middle(ref: Sequence[str], hyp: Sequence[str]) -> list[str]:
    """Moves between sequences that differ at both ends.

    The table of distances is kept as two bit vectors for each hypothesis token:
    where its column rises, and where it falls, from one reference token to the
    next.  They follow from the column before by word-parallel addition.
    """
    where: dict[str, int] = {}
    for i, token in enumerate(ref):
        where[token] = where.get(token, 0) | 1 << i
    every = (1 << len(ref)) - 1
    rises, falls = [every], [0]
    for token in hyp:
        rise, fall, same = rises[-1], falls[-1], where.get(token, 0)
        level = ((same & rise) + rise ^ rise) | same | fall  # no dearer than the diagonal
        right_up = (fall | every & ~(level | rise)) << 1 | 1
        right_down = (level & rise) << 1
        rises.append((right_down | ~(level | right_up)) & every)
        falls.append(right_up & level & every)
    moves, i, j = [], len(ref), len(hyp)
    while i and j:
        if rises[j] >> i - 1 & 1:
            i -= 1
            moves.append(DELETE)
        elif falls[j - 1] >> i - 1 & 1:
            j -= 1
            moves.append(INSERT)
        else:
            i, j = i - 1, j - 1
            moves.append(EQUAL if ref[i] == hyp[j] else SUBSTITUTE)
    return [*[DELETE] * i, *[INSERT] * j, *moves[::-1]]


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two token arrays by nested folds, without Python.

    The state is one row of the distance table.  Both arguments should be plain
    columns, as the folds refer to them once for each token.
    """
    first = F.sequence(F.lit(0), F.size(hyp))

    def next_row(row: Column, token: Column) -> Column:
        start = F.array(F.get(row, F.lit(0)) + 1)
        places = F.transform(hyp, lambda h, j: F.struct(h.alias("h"), j.alias("j")))
        return F.aggregate(
            places,
            start,
            lambda made, p: F.concat(
                made,
                F.array(
                    F.least(
                        F.get(row, p["j"] + 1) + 1,
                        F.element_at(made, -1) + 1,
                        F.get(row, p["j"]) + F.when(p["h"] == token, 0).otherwise(1),
                    )
                ),
            ),
        )

    return F.element_at(F.aggregate(ref, first, next_row), -1)


STEP_TYPE = pa.struct([("ref_index", pa.int32()), ("hyp_index", pa.int32()), ("operation", pa.string()), ("ref_boundary", pa.int32())])


def step_rows(alignment: Alignment) -> list[dict]:
    return [dict(zip(("ref_index", "hyp_index", "operation", "ref_boundary"), s)) for s in alignment.steps]


@F.arrow_udf(from_arrow_type(pa.list_(STEP_TYPE)))
def _aligned(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    pairs = zip(ref.to_pylist(), hyp.to_pylist())
    return pa.array([None if a is None or b is None else step_rows(align_tokens(a, b)) for a, b in pairs], pa.list_(STEP_TYPE))


LINKS = pa.struct([
    ("to_hyp", pa.list_(pa.int32())), ("to_ref", pa.list_(pa.int32())), ("changed", pa.list_(pa.int32())), ("deleted", pa.list_(pa.int32())),
    ("inserted", pa.list_(pa.struct([("hyp", pa.int32()), ("boundary", pa.int32())]))),
])


def _link_row(ref: list[str] | None, hyp: list[str] | None) -> dict | None:
    if ref is None or hyp is None:
        return None
    found = align_tokens(ref, hyp)
    return {
        "to_hyp": found.ref_to_hyp, "to_ref": found.hyp_to_ref, "changed": [i for i, _, move, _ in found.steps if move == SUBSTITUTE],
        "deleted": [i for i, _, move, _ in found.steps if move == DELETE],
        "inserted": [{"hyp": h, "boundary": at} for _, h, move, at in found.steps if move == INSERT],
    }


@F.arrow_udf(from_arrow_type(LINKS))
def linked(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The alignment as links: the counterpart of each token, and the places of the edits."""
    return pa.array([_link_row(a, b) for a, b in zip(ref.to_pylist(), hyp.to_pylist())], LINKS)


def with_alignment(df: DataFrame, ref: str = "ref_tokens", hyp: str = "hyp_tokens", out: str = "alignment") -> DataFrame:
    """Add the alignment of two token columns, which alone cross to Python; null tokens give a null alignment."""
    return df.withColumn(out, _aligned(F.col(ref), F.col(hyp)))


def operation_count(alignment: Column, operation: str) -> Column:
    return F.size(F.filter(alignment, lambda s: s["operation"] == operation)).cast("long")


def with_edit_counts(df: DataFrame, alignment: str = "alignment") -> DataFrame:
    """Substitutions, deletions, insertions, hits and reference words from an alignment."""
    a = F.col(alignment)
    named = (("substitutions", SUBSTITUTE), ("deletions", DELETE), ("insertions", INSERT), ("hits", EQUAL))
    out = df.withColumns({name: operation_count(a, op) for name, op in named})
    return out.withColumn("reference_word_count", F.col("substitutions") + F.col("deletions") + F.col("hits"))


def project_span(alignment: Column, start: Column, end: Column) -> Column:
    """``struct<hyp_start, hyp_end>`` of a reference span, by filters on the alignment array."""
    def belongs(s: Column) -> Column:
        inside = (s["ref_index"] >= start) & (s["ref_index"] < end)
        inner = (s["operation"] == INSERT) & (s["ref_boundary"] > start) & (s["ref_boundary"] < end)
        return s["hyp_index"].isNotNull() & (F.coalesce(inside, F.lit(False)) | inner)

    at = F.transform(F.filter(alignment, belongs), lambda s: s["hyp_index"])
    return F.struct(F.array_min(at).alias("hyp_start"), (F.array_max(at) + 1).alias("hyp_end"))
