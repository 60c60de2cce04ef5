"""Centroid clustering with kd-tree filtering.

Vectors become integers, so sums, means and comparisons are exact and a result
does not depend on how rows are spread over tasks.  Each task packs its vectors
into blocks of bounded size and builds a kd-tree over each block: every node
knows its rows (a slice of the block), their componentwise sum and their
bounding box.  The blocks are written once and read by every round.

In a round a node keeps the centroids that may be nearest to some point of its
box.  The candidate nearest to the middle of the box dominates another one
strictly if no corner of the box is as near to that other; the excess of the
squared distance is linear in the point, so one corner decides.  A node with a
single candidate is assigned whole, by its count and sum; other nodes hand
their candidates to their children, and what reaches a leaf is compared row by
row.  A task sends one partial sum for each cluster, and the driver sees no more
than ``k * (dimension + 1)`` numbers.

Defined results: vectors of another length, and those with a null, NaN or
infinite component, are left out; a null id is kept and assigned but starts no
centroid; repeated rows count each, and may start a centroid each; with fewer
vectors than centroids every vector starts one; ties go to the smaller cluster
number; an empty table gives no rows; other columns are ignored.  Components
beyond ``MOST_COMPONENT`` after scaling are an error, as squared distances would
not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import saved

#: Rows of a block, and rows up to which a node is a leaf.
BLOCK_ROWS, LEAF_ROWS = 4096, 32
MOST_COMPONENT = 1 << 26
#: Numbers of a node-by-centroid-by-component table that are held at once.
TABLE_NUMBERS = 1 << 21
#: Whole numbers below it are exact as doubles.
EXACT = 1 << 53


class Block(NamedTuple):
    """Points in tree order and their nodes in level order; ``child`` is the first of two children, or -1."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


BLOCK_DDL = "ids array<long>, points binary, start array<int>, end array<int>, child array<int>, low binary, high binary, total binary"


def integer_vectors(embeddings: DataFrame, dimension: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, v``: the usable vectors as ``floor(scale * x)``."""
    x = F.col("embedding")

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    def whole(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * scale)
        return F.when(F.abs(scaled) <= MOST_COMPONENT, scaled).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")).cast("int")

    kept = embeddings.where((F.size(x) == dimension) & F.forall(x, usable))
    return kept.select("vec_id", F.transform(x, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def build(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, Block]:
    """Row order and kd-tree of one block: nodes are halved at the median of their widest component."""
    order = np.arange(len(points))
    start, end, child, low, high, total = [0], [len(points)], [], [], [], []
    for node in range(2 * len(points)):
        if node == len(start):
            break
        rows = order[start[node] : end[node]]
        part = points[rows]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        total.append(part.sum(axis=0, dtype=np.int64))
        width = high[-1].astype(np.int64) - low[-1]
        if len(rows) <= leaf_rows or not width.any():
            child.append(-1)
            continue
        half = len(rows) // 2
        order[start[node] : end[node]] = rows[np.argpartition(part[:, width.argmax()], half)]
        child.append(len(start))
        start += [start[node], start[node] + half]
        end += [start[node] + half, end[node]]
    numbers = (np.array(x, dtype=np.int32) for x in (start, end, child))
    return order, Block(points[order], *numbers, np.array(low, dtype=np.int64), np.array(high, dtype=np.int64), np.array(total))


def _undominated(low: np.ndarray, high: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which of the live centroids of each box no other one beats everywhere in it."""
    norms = (centroids * centroids).sum(axis=1)
    gaps = 2 * centroids[None] - (low + high)[:, None]
    far = np.where(alive, (gaps * gaps).sum(axis=2), np.iinfo(np.int64).max)
    best = far.argmin(axis=1)
    step = centroids[None] - centroids[best][:, None]
    reach = np.maximum(step * low[:, None], step * high[:, None]).sum(axis=2)
    return alive & (norms[None] - norms[best][:, None] <= 2 * reach)


def settle(block: Block, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of every row of a block, and count and sum of every cluster in it."""
    k = len(centroids)
    labels = np.zeros(len(block.points), dtype=np.int32)
    counts, totals = np.zeros(k, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    most = max(np.abs(centroids).max(initial=1), np.abs(block.points).max(initial=1))
    kind = np.float64 if 4 * centroids.shape[1] * int(most) ** 2 < EXACT else np.int64
    values, rows = centroids.astype(kind), block.points.astype(kind)
    norms = (values * values).sum(axis=1)
    nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    at_once = max(1, TABLE_NUMBERS // centroids.size)
    while len(nodes):
        parts = [slice(i, i + at_once) for i in range(0, len(nodes), at_once)]
        alive = np.concatenate([_undominated(block.low[nodes[p]], block.high[nodes[p]], alive[p], centroids) for p in parts])
        single = alive.sum(axis=1) == 1
        for node, cluster in zip(nodes[single], alive[single].argmax(axis=1)):
            labels[block.start[node] : block.end[node]] = cluster
            counts[cluster] += block.end[node] - block.start[node]
            totals[cluster] += block.total[node]
        leaf = ~single & (block.child[nodes] < 0)
        for node, near in zip(nodes[leaf], alive[leaf]):
            part, candidates = slice(block.start[node], block.end[node]), np.flatnonzero(near)
            nearest = (norms[candidates] - 2 * (rows[part] @ values[candidates].T)).argmin(axis=1)
            labels[part] = candidates[nearest]
            np.add.at(counts, labels[part], 1)
            np.add.at(totals, labels[part], block.points[part])
        inner = ~single & ~leaf
        first = block.child[nodes[inner]].astype(np.int64)
        nodes, alive = np.concatenate([first, first + 1]), np.tile(alive[inner], (2, 1))
    return labels, counts, totals


def _as_row(ids: pa.Array, points: np.ndarray) -> dict:
    order, block = build(points)
    arrays = {name: getattr(block, name).tolist() for name in ("start", "end", "child")}
    blobs = {"points": block.points.astype("<i4"), "low": block.low.astype("<i4"), "high": block.high.astype("<i4"), "total": block.total.astype("<i8")}
    return {"ids": ids.take(pa.array(order)).to_pylist()} | arrays | {name: value.tobytes() for name, value in blobs.items()}


def _as_block(batch: pa.RecordBatch, row: int, dimension: int) -> Block:
    def numbers(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_py(), dtype=kind).astype(np.int64).reshape(-1, dimension)

    lists = (batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("start", "end", "child"))
    return Block(numbers("points", "<i4"), *lists, numbers("low", "<i4"), numbers("high", "<i4"), numbers("total", "<i8"))


_BLOCK_ARROW = pa.schema(
    [("ids", pa.list_(pa.int64())), ("points", pa.binary())]
    + [(name, pa.list_(pa.int32())) for name in ("start", "end", "child")]
    + [(name, pa.binary()) for name in ("low", "high", "total")]
)


def blocks_of(vectors: DataFrame, dimension: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the rows of each partition, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_as_row(pa.concat_arrays(ids), np.concatenate(points))], schema=_BLOCK_ARROW)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - held)
                ids.append(part.column(0))
                points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
                held, at = held + part.num_rows, at + part.num_rows
                if held == block_rows:
                    yield block()
                    ids, points, held = [], [], 0
        if held:
            yield block()

    return vectors.mapInArrow(run, BLOCK_DDL)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors, or the old place of those without any."""
    k, dimension = centroids.shape
    arrow = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                _, n, t = settle(_as_block(batch, row, dimension), centroids)
                counts, totals = counts + n, totals + t
        table = np.concatenate([counts[:, None], totals], axis=1)[counts > 0]
        clusters = np.repeat(np.flatnonzero(counts).astype(np.int32), dimension + 1)
        components = np.tile(np.arange(-1, dimension, dtype=np.int32), len(table))
        yield pa.RecordBatch.from_arrays([pa.array(clusters), pa.array(components), pa.array(table.ravel())], schema=arrow)

    partial = blocks.drop("ids").mapInArrow(run, "cluster int, component int, total long")
    rows = partial.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()
    found = {(r["cluster"], r["component"]): r["total"] for r in rows}
    out = centroids.copy()
    for (cluster, component), total in found.items():
        if component >= 0:
            out[cluster, component] = total // found[cluster, -1]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    arrow = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _as_block(batch, row, centroids.shape[1])
                labels, _, _ = settle(block, centroids)
                gaps = block.points - centroids[labels]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, pa.array(labels), pa.array((gaps * gaps).sum(axis=1))], schema=arrow
                )

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every usable row of ``embeddings``."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, dimension, scale)
    centroids = first_centroids(vectors, k, seed)
    ddl = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        none = "cast(null as int) as cluster", "cast(null as long) as distance", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in ddl.split(", ")[1:])
        return vectors.where("false").selectExpr("cast(vec_id as long) as vec_id", *none)
    blocks = saved(blocks_of(vectors.select(F.col("vec_id").cast("long"), "v"), dimension))
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    labelled = saved(assigned(blocks, centroids))
    # One row for each cluster: at most k.
    sums = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    return labelled.join(F.broadcast(spark.createDataFrame(rows, ddl)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
