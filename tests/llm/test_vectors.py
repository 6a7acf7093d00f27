"""Search, hard negatives and clustering of vectors against brute force, with odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from wardhall.llm import lloyd, negatives, vafile, vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("z", "h", "cid", "score", "n", "leaf", "x", "cluster")]])


def make(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], SCHEMA)


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [min(max(math.floor(scale * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in v]


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)


def order(score, i):
    return (-score, i is None, i or 0)


def brute_search(rows, every, top):
    kept = [(i, whole(v, 256)) for i, v, _ in rows if whole(v, 256) is not None]
    out = []
    for at, (i, z) in enumerate(kept):
        if i is None or i % every:
            continue
        best = sorted((order(dot(z, w), j) for b, (j, w) in enumerate(kept) if b != at))[:top]
        out += [(i, n, None if gone else j, -s) for n, (s, gone, j) in enumerate(best, 1)]
    return Counter(out)


def brute_negatives(rows, every, positives, k, low=50, high=95):
    kept = [(i, whole(v, 256), label) for i, v, label in rows if whole(v, 256) is not None and label is not None]
    out = []
    for at, (i, z, label) in enumerate(kept):
        if i is None or i % every:
            continue
        near = sorted(order(dot(z, w), j) for b, (j, w, other) in enumerate(kept) if b != at and other == label)[:positives]
        for s, gone, j in near:
            p = -s
            some = sorted(order(dot(z, w), m) for m, w, other in kept if other != label and low * p <= 100 * dot(z, w) <= high * p)[:k]
            out += [(i, None if gone else j, n, None if lost else m, p, -t) for n, (t, lost, m) in enumerate(some, 1)]
    return Counter(out)


def brute_clusters(rows, clusters, rounds, width):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if whole(v, 64) is not None and len(v) == width]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), z) for i, z in kept if i is not None)
    centroids = [z for _, z in named[:clusters]]
    if not centroids:
        return Counter()
    near = lambda z: min((sum((a - b) ** 2 for a, b in zip(z, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, z in kept:
            own.setdefault(near(z)[1], []).append(z)
        for n, some in own.items():
            centroids[n] = [sum(x) // len(some) for x in zip(*some)]
    found = [(i, *near(z)) for i, z in kept]
    total, by = sum(d for _, d, _ in found), Counter()
    for _, d, n in found:
        by[n] += d
    clip = lambda v: min(v, 2**63 - 1)
    return Counter((i, n, clip(d), clip(by[n]), clip(total), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found)


def odd_rows(width=8, n=260, seed=5):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 0.4) for _ in range(width)], rnd.randrange(3)) for i in range(n)]
    hot = [rnd.gauss(0, 0.4) for _ in range(width)]
    rows += [(1000 + i, hot, i % 2) for i in range(130)]  # a third of all rows
    rows += [(2000 + i, [x + rnd.gauss(0, 0.001) for x in hot], 2) for i in range(40)]
    rows += [rows[0], rows[0], rows[50], (50, hot, 1), (None, hot, 0), (None, [0.1] * width, 1), (None, None, 1)]
    rows += [(3000, None, 0), (3050, [], 1), (3051, [], 2), (3052, [None] * width, 0), (3100, [float("nan")] * width, 0), (3150, [float("inf"), *[0.0] * (width - 1)], 1), (3200, [0.5] * width, None), (3250, [0.3] * (width - 3), 1), (3251, [0.3] * (width + 5), 2), (3300, [0.0] * width, 0)]
    return rows


HUGE = [(0, [1e30] * 8, 0), (50, [-1e30] * 8, 1), (1, [3e38, *[0.0] * 7], 1), (100, [0.25] * 8, 0), (2, [0.5] * 8, 0), (3, [0.125] * 8, 1)]


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rows", [odd_rows(), HUGE, odd_rows()[:6]], ids=["odd", "huge", "few"])
def test_search(spark, rows):
    out = vafile.nearest(make(spark, rows).repartition(5))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert got(out) == brute_search(rows, 50, 5)


def test_search_reads_in_two_waves(spark, monkeypatch):
    """With coarse cells many vectors survive the scan, and those beyond the first wave are read when their bound still reaches the k-th score."""
    monkeypatch.setattr(vafile, "CELLS", 4)
    monkeypatch.setattr(vafile, "WAVE", 3)
    monkeypatch.setattr(vafile, "ROWS", 50)
    rows = odd_rows(n=400)
    assert got(vafile.nearest(make(spark, rows), every=10)) == brute_search(rows, 10, 5)


def test_cells_bound_every_score():
    rnd = np.random.default_rng(3)
    m, q = rnd.integers(-200, 200, (300, 12)), rnd.integers(-200, 200, (20, 12))
    cells, low, high = vafile._cells(m)
    at = cells + np.arange(12) * vafile.CELLS
    assert (low[at] <= m).all() and (m <= high[at]).all() and cells.max() < vafile.CELLS
    assert (vectors.exact(q, m) == q @ m.T).all()


@pytest.mark.parametrize("rows", [odd_rows(), HUGE, odd_rows()[:6]], ids=["odd", "huge", "few"])
def test_hard_negatives(spark, rows):
    out = negatives.hard_negatives(make(spark, rows).repartition(5))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(out) == brute_negatives(rows, 50, 5, 3)


def test_hard_negatives_through_upper_levels(spark, monkeypatch):
    """Small blocks and leaves: upper levels route, blocks are pruned, and nothing changes."""
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "ASKING", 4)
    rnd = random.Random(9)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = odd_rows(n=100) + [(4000 + i, [x + rnd.gauss(0, 0.02) for x in centres[i % 6]], i // 6 % 3) for i in range(300)]
    assert got(negatives.hard_negatives(make(spark, rows), every=20)) == brute_negatives(rows, 20, 5, 3)


def test_tree_intervals_hold_every_distance():
    rnd = np.random.default_rng(4)
    m, q = rnd.integers(-99, 99, (700, 6)), rnd.integers(-99, 99, (30, 6))
    radius2 = float((m**2).sum(axis=1).max())
    order, ends, points, near, far = negatives._tree(m, radius2)
    assert sorted(order) == list(range(700)) and np.diff(ends).max() <= negatives.LEAF
    d = negatives._apart(q, np.zeros(30), m, negatives._added(m, radius2))
    assert np.allclose(d**2, ((q**2).sum(axis=1) + radius2)[:, None] - 2 * (q @ m.T))
    least, most = negatives._reached(q, radius2, d[:, points], near, far)
    for j, part in enumerate(np.split(order, ends[:-1])):
        s = q @ m[part].T
        assert (s <= most[:, j, None]).all() and (s >= least[:, j, None]).all()


def test_upper_levels_route_as_they_were_fitted():
    rnd = np.random.default_rng(6)
    m = rnd.integers(-99, 99, (500, 5))
    upper = negatives.Upper.fit(m[:200], 3, float((m**2).sum(axis=1).max()))
    leaf, way = upper.route(m)
    assert leaf.min() >= 0 and leaf.max() < 8 and way.shape == (500, 3)
    for x in range(8):
        assert np.allclose(upper.distances(m)[leaf == x][:, upper.path(x)], way[leaf == x])


@pytest.mark.parametrize("rows", [odd_rows(), HUGE, odd_rows()[:6]], ids=["odd", "huge", "few"])
def test_clusters(spark, rows):
    out = lloyd.clustered(make(spark, rows).repartition(5), width=8)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(out) == brute_clusters(rows, 16, 3, 8)


def test_empty_tables(spark):
    none = make(spark, [])
    for out in (vafile.nearest(none), negatives.hard_negatives(none), lloyd.clustered(none), lloyd.clustered(make(spark, [(None, [0.5] * 64, 1)]))):
        assert out.count() == 0


def test_classes_keep_least_ids(spark):
    rows = vectors.usable(make(spark, odd_rows()), 256)
    found = vectors.classes(rows, ["z"], 4)
    hot = [r for r in found.collect() if len(r["ids"]) == 4 and r["ids"][0] == 50]
    assert hot and hot[0]["ids"] == [50, 1000, 1001, 1002]
    assert found.select("z").distinct().count() == found.count()
