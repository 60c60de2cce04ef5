"""Centroid clustering against a plain version."""

import hashlib
import math
import random

import numpy as np

from scribegauge.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def plain(rows, k=16, rounds=3, dimension=64, scale=64):
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    return clustering.cluster_vectors(frame, **options)


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


def test_against_brute_force(spark):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(middles)]) for i in range(700)]
    rows += rows[:40] + [(None, rows[0][1]), (None, None), (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None])]
    rows += [(903, [0.5] * 63 + [float("nan")]), (904, [float("-inf")] * 64), (905, []), (906, [-0.01] * 64)]
    assert by_text(found(spark, rows).collect()) == by_text(plain(rows))


def test_ties_few_rows_and_none(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(300)]
    options = {"k": 7, "rounds": 2, "dimension": 3, "scale": 1}
    assert by_text(found(spark, rows, **options).collect()) == by_text(plain(rows, **options))
    same = [(i, [0.25] * 64) for i in range(40)]
    assert by_text(found(spark, same).collect()) == by_text(plain(same))
    assert by_text(found(spark, same[:3]).collect()) == by_text(plain(same[:3]))
    empty = found(spark, [])
    assert empty.columns == found(spark, same).columns and empty.collect() == []


def test_filtering_prunes_and_stays_exact():
    rng = np.random.default_rng(7)
    for spread, scale in ((1, 100), (30, 100), (5, 1 << 24)):
        middles = rng.integers(-scale, scale, (8, 6))
        points = middles[rng.integers(0, 8, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))
        order, block = clustering.build(points.astype(np.int32))
        assert sorted(order.tolist()) == list(range(3000)) and (block.points == points[order]).all()
        centroids = np.concatenate([middles[:5], middles[:2]]).astype(np.int64)
        gaps = block.points[:, None].astype(object) - centroids[None].astype(object)
        want = np.array([min(range(7), key=lambda j, row=row: (row[j], j)) for row in (gaps * gaps).sum(axis=2).tolist()])
        labels, counts, totals = clustering.settle(block, centroids)
        assert (labels == want).all() and (counts == np.bincount(want, minlength=7)).all()
        assert all((totals[j] == block.points[want == j].sum(axis=0)).all() for j in range(7))
    alive = clustering._undominated(np.array([[0, 0]]), np.array([[1, 1]]), np.ones((1, 3), dtype=bool), np.array([[0, 0], [9, 9], [0, 0]]))
    assert alive.tolist() == [[True, False, True]]
