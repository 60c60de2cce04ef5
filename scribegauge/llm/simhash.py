"""SimHash near-duplicates by a segment-popcount embedding.

Each document gets a 64-bit fingerprint; fingerprints link when at most three
bits differ.  A fingerprint is embedded as the bit counts of its 32 two-bit
segments, packed in one long.  A flipped bit changes one count by one, so the
Manhattan distance of two embeddings never exceeds the Hamming distance, and
linked embeddings are within Manhattan distance three.

The range join runs on a grid: the 32 dimensions form six blocks, and among
points within distance three at least three blocks are equal.  Every choice of
three blocks is a grid whose cell is the counts in those blocks.  Points that
share a cell are compared inside the join condition, first by Manhattan
distance, then exactly by Hamming distance, and a pair that shares several
cells is only made in the first of them.  All of it works on distinct
fingerprints, so copies are never paired.

Defined results: null and empty texts have fingerprint zero, which links like
any other; a null ``doc_id`` keeps its fingerprint but links nothing and has a
null component; repeated rows and repeated ids are one row out for each row
in; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .runtime import checkpointed, map_rows

SEED = 42
WORDS = 3
RADIUS = 3
#: Bits of each block: first and one past last, at segment boundaries.
BLOCKS = ((0, 12), (12, 22), (22, 32), (32, 44), (44, 54), (54, 64))
EVEN = 0x5555555555555555
CHUNK = 1 << 15

ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(data: bytes, size: int = WORDS) -> int:
    """Fingerprint as a signed 64-bit number; ``bytes.lower`` and ``split`` touch ASCII only."""
    words = data.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[start : start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``."""

    def setup():
        return lambda cols: [(i, fingerprint(t or b"")) for i, t in zip(*cols)]

    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(raw, ["doc_id", "text"], "doc_id long, fp long", ARROW, setup)


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _mask(block: tuple[int, int]) -> int:
    return (1 << block[1]) - (1 << block[0])


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in its own two bits."""
    high = F.shiftrightunsigned(fp, 1)
    both = F.shiftleft(high.bitwiseAND(fp).bitwiseAND(_signed(EVEN)), 1)
    return both.bitwiseOR(high.bitwiseXOR(fp).bitwiseAND(_signed(EVEN)))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed embeddings; fields hold 0, 1 or 2."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(_signed(EVEN))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(_signed(EVEN))
    return F.bit_count(low) + F.lit(2) * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def _first_cell(a: Column, b: Column) -> Column:
    """Bit set of the first three blocks in which two embeddings agree."""
    x = a.bitwiseXOR(b)
    same = F.lit(0)
    for i, block in enumerate(BLOCKS):
        same = same + F.when(x.bitwiseAND(_signed(_mask(block))) == 0, F.lit(1 << i)).otherwise(F.lit(0))
    rest, out = same, F.lit(0)
    for _ in range(len(BLOCKS) - RADIUS):
        out = out.bitwiseOR(rest.bitwiseAND(-rest))
        rest = rest.bitwiseAND(rest - 1)
    return out


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: ids of linked points, each pair once; expects distinct ``fp`` and ``id``."""
    cells = []
    for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - radius):
        mask = sum(_mask(BLOCKS[i]) for i in chosen)
        cells.append(
            F.struct(
                F.lit(sum(1 << i for i in chosen)).alias("grid"),
                F.col("counts").bitwiseAND(_signed(mask)).alias("cell"),
            )
        )
    placed = points.select("id", "fp", segment_counts(F.col("fp")).alias("counts")).select(
        "id", "fp", "counts", F.inline(F.array(*cells))
    )
    left, right = placed.alias("l"), placed.alias("r")
    c = F.col
    near = (
        (c("l.grid") == c("r.grid"))
        & (c("l.cell") == c("r.cell"))
        & (c("l.fp") < c("r.fp"))
        & (manhattan(c("l.counts"), c("r.counts")) <= radius)
        & (F.bit_count(c("l.fp").bitwiseXOR(c("r.fp"))) <= radius)
        & (_first_cell(c("l.counts"), c("r.counts")) == c("l.grid"))
    )
    return left.join(right, near).select(c("l.id").alias("a"), c("r.id").alias("b"))


def group_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the component is its smallest ``doc_id``."""
    marked = checkpointed(fingerprints(docs))
    classes = checkpointed(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    labels = connected_components(links(classes), "a", "b").withColumnRenamed("node", "id")
    of_class = classes.join(labels, "id", "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("label", "id").alias("component_id")
    )
    joined = marked.join(of_class, marked["fp"] == of_class["class_fp"], "left")
    return joined.select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component.

    Rows without an id stay, as they link nothing.
    """
    gone = group_documents(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
