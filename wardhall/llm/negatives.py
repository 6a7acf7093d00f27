"""Hard negatives: a vantage-point tree over norm-augmented vectors.

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest length, and every anchor a zero: then
|anchor - x|^2 = |anchor|^2 + M^2 - 2 score, so a window of scores is an annulus around the anchor, and a higher score is nearer.

The tree's upper levels are fitted on a bounded sample and route every vector to a leaf; each leaf's vectors are blocks of
bounded size with a tree of their own.  Blocks of anchors go only to leaves that one of their annuli may reach; there the
block's leaves are visited nearest first, inside the annulus, until the k-th find is nearer than anything left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import small_batches, table
from .shared import written
from .vectors import asked, by_length, classes, exact, gathered, packed, unpacked, usable

#: Query parameters: anchors are rows whose id is divisible by ``EVERY``; a negative's score is ``LOW`` to ``HIGH`` hundredths of the positive's.
SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
#: Vectors that the upper levels are fitted on, levels at most, vectors of a block and of a leaf of its own tree, anchors of a block.
SAMPLE, LEVELS, BLOCK, LEAF, ASKING = 4096, 8, 4096, 128, 512
#: Components of that sample at most.
SAMPLED = 1 << 22
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min

_TREE = "leaf int, salt int, n int, width int, keys binary, firsts binary, gone binary, labels binary, z binary, kind string, order binary, ends binary, points binary, near binary, far binary"
_ASK = "block long, n int, width int, windows int, keys binary, labels binary, z binary, kind string, low binary, high binary, leaves array<int>"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _row(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[f.split()[1]]) for v, f in zip(values, schema.split(", "), strict=True)], names=_names(schema))


def _added(m: np.ndarray, radius2: float) -> np.ndarray:
    """The component that norm augmentation adds."""
    return np.sqrt(np.maximum(0, radius2 - (m.astype(float) ** 2).sum(axis=1)))


def _apart(a: np.ndarray, added_a: np.ndarray, b: np.ndarray, added_b: np.ndarray) -> np.ndarray:
    """Distances between augmented vectors; shorter ones go on with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a.astype(float), b.astype(float)
    square = ((a**2).sum(axis=1) + added_a**2)[:, None] + ((b**2).sum(axis=1) + added_b**2) - 2 * (a[:, :width] @ b[:, :width].T + np.outer(added_a, added_b))
    return np.sqrt(np.maximum(0, square))


@dataclass
class Upper:
    """Upper levels: node i has a vantage point and a radius, and the children 2i + 1 (inside) and 2i + 2; 2^levels leaves."""

    points: np.ndarray
    radii: np.ndarray
    levels: int
    radius2: float

    @staticmethod
    def fit(sample: np.ndarray, levels: int, radius2: float) -> Upper:
        points, radii = np.zeros((2**levels - 1, sample.shape[1]), np.int64), np.zeros(2**levels - 1)
        parts = {0: np.arange(len(sample))}
        added = _added(sample, radius2)
        for i in range(2**levels - 1):
            at = parts.pop(i)
            inside = at
            if len(at):
                points[i] = sample[at[0]]
                d = _apart(sample[at], added[at], sample[at[:1]], added[at[:1]])[:, 0]
                radii[i] = np.median(d)
                inside, at = at[d <= radii[i]], at[d > radii[i]]
            parts[2 * i + 1], parts[2 * i + 2] = inside, at
        return Upper(points, radii, levels, radius2)

    def distances(self, m: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Of each vector to each vantage point."""
        return _apart(m, np.zeros(len(m)) if anchors else _added(m, self.radius2), self.points, _added(self.points, self.radius2))

    def path(self, leaf: int) -> list[int]:
        out, node = [], 0
        for bit in range(self.levels - 1, -1, -1):
            out.append(node)
            node = 2 * node + 1 + (leaf >> bit & 1)
        return out

    def route(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances to the vantage points on the way) of each vector."""
        all_d, node, way = self.distances(m), np.zeros(len(m), np.int64), np.zeros((len(m), self.levels))
        for level in range(self.levels):
            way[:, level] = all_d[np.arange(len(m)), node]
            node = 2 * node + np.where(way[:, level] <= self.radii[node], 1, 2)
        return node - (2**self.levels - 1), way


def _reached(q: np.ndarray, radius2: float, d: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each anchor can have in each leaf, from its distances to the leaf's vantage points and the leaf's intervals of them.

    ``d`` is anchors x leaves x levels, ``near`` and ``far`` leaves x levels.  A little wide, for distances are rounded.
    """
    base = ((q.astype(float) ** 2).sum(axis=1) + radius2)[:, None]
    if not d.shape[2]:
        return np.full(d.shape[:2], -np.inf), np.full(d.shape[:2], np.inf)
    low = np.maximum(0, np.maximum(d - far, near - d).max(axis=2))
    high = (d + far).min(axis=2)
    slack = 1e-6 * base + 1
    return (base - high**2) / 2 - slack, (base - low**2) / 2 + slack


def _tree(m: np.ndarray, radius2: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows by leaf, ends of leaves, vantage points by leaf and level, their least and greatest distances): halves until ``leaf`` rows."""
    added, parts = _added(m, radius2), [(np.arange(len(m)), [])]
    leaves = []
    while parts:
        at, way = parts.pop()
        if len(at) <= leaf:
            leaves.append((at, way))
            continue
        d = _apart(m[at], added[at], m[at[:1]], added[at[:1]])[:, 0]
        by = np.argsort(d, kind="stable")
        for half in (by[: len(by) // 2], by[len(by) // 2 :]):
            parts.append((at[half], [*way, (int(at[0]), d[half].min(), d[half].max())]))
    depth = max(len(w) for _, w in leaves)
    filled = [w + [w[-1]] * (depth - len(w)) if w else [] for _, w in leaves]
    points = np.array([[s[0] for s in w] for w in filled], np.int32).reshape(len(leaves), depth)
    near, far = (np.array([[s[i] for s in w] for w in filled], float).reshape(len(leaves), depth) for i in (1, 2))
    return np.concatenate([a for a, _ in leaves]).astype("<i4"), np.cumsum([len(a) for a, _ in leaves]).astype("<i4"), points, near, far


@dataclass
class Index:
    """Blocks of all classes, and how the upper levels lead to them."""

    upper: Upper
    blocks: DataFrame
    sizes: DataFrame
    leaves: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def build(found: DataFrame) -> Index:
        norm = F.aggregate("z", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        rows, radius2, longest = found.agg(F.count("*"), F.max(norm), F.max(F.size("z"))).first()
        sample = [r["z"] for r in found.select("h", "z").orderBy("h", "z").limit(max(1, min(SAMPLE, SAMPLED // max(1, longest or 0)))).collect()]
        width = max(map(len, sample), default=0)
        upper = Upper.fit(np.array([z + [0] * (width - len(z)) for z in sample], np.int64).reshape(len(sample), width), min(LEVELS, max(0, math.ceil(math.log2(max(1, rows) / BLOCK)))), float(radius2 or 0) * (1 + 1e-9))
        spark, small = found.sparkSession, LEAF

        def measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for _, m in by_length(batch.column("z")):
                    leaf, way = upper.route(m)
                    some = np.unique(leaf)
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([int((leaf == x).sum()) for x in some], pa.int64()), *[pa.array([f(way[leaf == x], axis=0).tolist() for x in some], pa.list_(pa.float64())) for f in (np.min, np.max)]], names=["leaf", "n", "near", "far"])

        levels = range(upper.levels)
        measures = found.select("z").mapInArrow(measured, "leaf int, n long, near array<double>, far array<double>")
        of = sorted(measures.groupBy("leaf").agg(F.sum("n").alias("n"), *[F.min(F.col("near")[i]).alias(f"near{i}") for i in levels], *[F.max(F.col("far")[i]).alias(f"far{i}") for i in levels]).collect(), key=lambda r: r["leaf"])
        parts = {r["leaf"]: -(-r["n"] // BLOCK) for r in of}
        sizes = spark.createDataFrame(sorted(parts.items()), "leaf int, parts int")

        def routed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                leaf = np.zeros(batch.num_rows, np.int32)
                for at, m in by_length(batch.column("z")):
                    leaf[at] = upper.route(m)[0]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

        def block(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            out = []
            for batch in rows.to_batches() or []:
                leaf, salt = batch.column("leaf")[0].as_py(), batch.column("salt")[0].as_py()
                for at, m in by_length(batch.column("z")):
                    own = batch.take(pa.array(at))
                    first = own.column("first")
                    (z, kind), (order, ends, points, near, far) = packed(m), _tree(m, upper.radius2, small)
                    out.append(_row(_TREE, [leaf, salt, len(at), m.shape[1], own.column("cid").to_numpy().astype("<i8").tobytes(), first.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), first.is_null().to_numpy(zero_copy_only=False).tobytes(), own.column("label").to_numpy().astype("<i8").tobytes(), z, kind, order.tobytes(), ends.tobytes(), points.astype("<i4").tobytes(), near.tobytes(), far.tobytes()]))
            return pa.Table.from_batches(out)

        some = found.select("cid", F.col("ids")[0].alias("first"), "label", "z")
        dealt = some.mapInArrow(routed, "leaf int, cid long, first long, label long, z array<long>").join(F.broadcast(sizes), "leaf").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts")
        blocks = written(dealt.groupBy("leaf", "salt").applyInArrow(block, _TREE))
        return Index(upper, blocks, sizes, np.array([r["leaf"] for r in of], np.int32), *[np.array([[r[f"{n}{i}"] for i in levels] for r in of], float).reshape(len(of), upper.levels) for n in ("near", "far")])

    def asking(self, queries: DataFrame, windows: Callable[[list[int]], list[tuple[int, int]]]) -> DataFrame:
        """Anchors (qid, label, z, scores) in blocks, with their windows of scores and the leaves that these may reach."""
        upper, leaves, near, far = self.upper, self.leaves, self.near, self.far
        paths = np.array([upper.path(int(x)) for x in leaves], np.int64).reshape(len(leaves), upper.levels)

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, (keys, labels, scores) in gathered(stream, ASKING, "qid", "label", "scores"):
                each = [windows([int(p) for p in s]) for s in scores]
                most = max(1, max(map(len, each)))
                low, high = (np.array([[w[i] for w in ws] + [(_MOST, _LEAST)[i]] * (most - len(ws)) for ws in each], np.int64) for i in (0, 1))
                least, best = _reached(m, upper.radius2, upper.distances(m, anchors=True)[:, paths], near, far)
                hit = [j for j in range(len(leaves)) if ((best[:, j, None] >= low) & (least[:, j, None] <= high) & (low <= high)).any()]
                z, kind = packed(m)
                yield _row(_ASK, [int(keys[0]), len(keys), m.shape[1], most, keys.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), z, kind, low.tobytes(), high.tobytes(), leaves[hit].tolist()])

        return written(queries.select("qid", "label", "z", "scores").mapInArrow(run, _ASK))

    def search(self, queries: DataFrame, windows: Callable[[list[int]], list[tuple[int, int]]], same: bool, k: int) -> DataFrame:
        """(qid, window, cid, score): of each anchor and window the k best classes of the same label, or of others."""
        blocks = self.asking(queries, windows)
        reach = blocks.select("block", F.explode("leaves").alias("leaf")).join(F.broadcast(self.sizes), "leaf").select("block", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        at = ["block", "leaf", "salt"]
        left = reach.join(blocks.drop("leaves"), "block").groupBy(*at)
        right = reach.join(self.blocks, ["leaf", "salt"]).withColumnsRenamed({n: f"to_{n}" for n in at}).groupBy(*[f"to_{n}" for n in at])
        radius2 = self.upper.radius2

        def run(asking: pa.Table, trees: pa.Table) -> pa.Table:
            out = [part for a in asking.to_pylist() for t in trees.to_pylist() for part in [_walk(a, t, radius2, same, k)] if part is not None]
            return pa.concat_tables(out) if out else pa.schema([("qid", pa.int64()), ("window", pa.int32()), ("cid", pa.int64()), ("score", pa.int64()), ("first", pa.int64())]).empty_table()

        hits = left.cogroup(right).applyInArrow(run, "qid long, window int, cid long, score long, first long")
        rank = Window.partitionBy("qid", "window").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last())
        return written(hits.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k).drop("n", "first"))


def _walk(a: dict, t: dict, radius2: float, same: bool, k: int) -> pa.Table | None:
    """Nearest-first through one block's tree for one block of anchors, all anchors a leaf at a time."""
    q, x = unpacked(a["z"], a["kind"], a["width"], a["n"]), unpacked(t["z"], t["kind"], t["width"], t["n"])
    low, high = (np.frombuffer(a[n], "<i8").reshape(a["n"], a["windows"]) for n in ("low", "high"))
    own, labels = np.frombuffer(a["labels"], "<i8"), np.frombuffer(t["labels"], "<i8")
    firsts, gone = np.frombuffer(t["firsts"], "<i8"), np.frombuffer(t["gone"], bool)
    by_id = np.lexsort((firsts, gone))
    place = np.empty(len(x), np.int64)
    place[by_id] = len(x) - 1 - np.arange(len(x))  # the smaller the id, the greater
    order, ends = np.frombuffer(t["order"], "<i4"), np.frombuffer(t["ends"], "<i4")
    starts = np.concatenate([[0], ends[:-1]])
    points, near, far = (np.frombuffer(t[n], kind).reshape(len(ends), -1) for n, kind in (("points", "<i4"), ("near", "<f8"), ("far", "<f8")))
    best = np.full((a["n"], a["windows"], k), _LEAST)  # of each window, ascending: score * rows + place
    reach = min(a["width"], t["width"]) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0))
    scores_of = None
    if reach * len(x) >= 2.0**62:  # numbers too large to carry their row: all scores at once, by rank
        scores_of, rank = np.unique(exact(q, x), return_inverse=True)
        _take(best, np.arange(a["n"]), rank.reshape(a["n"], -1) * len(x) + place, exact(q, x), own, labels, low, high, same)
    else:
        used, at = np.unique(points, return_inverse=True)
        d = _apart(q, np.zeros(len(q)), x[used], _added(x[used], radius2))[:, at.reshape(points.shape)] if used.size else np.zeros((len(q), *points.shape))
        least, most = _reached(q, radius2, d, near, far)
        nearest = np.argsort(-most, axis=1, kind="stable")
        for step in range(len(ends)):
            leaf = nearest[:, step]
            here, there = most[np.arange(len(q)), leaf], least[np.arange(len(q)), leaf]
            floor = np.maximum(low, np.where(best[:, :, 0] == _LEAST, _LEAST, best[:, :, 0] // len(x)))
            open_windows = (low <= high) & (here[:, None] >= floor)  # those that a later leaf could still serve
            if not open_windows.any():
                break
            going = np.flatnonzero((open_windows & (there[:, None] <= high)).any(axis=1))
            going = going[np.argsort(leaf[going], kind="stable")]
            for part in np.split(going, np.flatnonzero(np.diff(leaf[going])) + 1) if len(going) else []:
                rows = order[starts[leaf[part[0]]] : ends[leaf[part[0]]]]
                s = exact(q[part], x[rows])
                _take(best, part, s * len(x) + place[rows], s, own[part], labels[rows], low[part], high[part], same)
    i, w, n = np.nonzero(best != _LEAST)
    if not len(i):
        return None
    value = best[i, w, n]
    row, score = by_id[len(x) - 1 - value % len(x)], value // len(x)
    score = score if scores_of is None else scores_of[score]
    return pa.table({"qid": np.frombuffer(a["keys"], "<i8")[i], "window": w.astype(np.int32), "cid": np.frombuffer(t["keys"], "<i8")[row], "score": score, "first": pa.array(firsts[row], mask=gone[row])})


def _take(best: np.ndarray, part: np.ndarray, value: np.ndarray, s: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> None:
    """Puts what a leaf has for some anchors among their best."""
    hit = ((own[:, None] == labels) == same)[:, None, :] & (s[:, None, :] >= low[:, :, None]) & (s[:, None, :] <= high[:, :, None]) & (value[:, None, :] > best[part][:, :, :1])
    a, w = np.nonzero(hit.any(axis=2))
    if len(a):
        k = best.shape[2]
        both = np.concatenate([best[part[a], w], np.where(hit[a, w], value[a], _LEAST)], axis=1)
        best[part[a], w] = np.sort(np.partition(both, -k, axis=1)[:, -k:], axis=1)


def _rows_of(hits: DataFrame, found: DataFrame, queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, r): the k best rows of the classes found, as (o, gone, id, score, own); own are copies of the anchor."""
    one = hits.join(found.select("cid", "ids", F.col("z").alias("other")), "cid").join(queries.select("qid", "z"), "qid")
    one = one.select(*by, "score", (F.col("other") == F.col("z")).alias("own"), F.explode("ids").alias("id"))
    ranks = F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("o"), F.col("id").isNull().alias("gone"), "id", "score", "own")))
    return one.groupBy(*by).agg(F.slice(ranks, 1, k).alias("r"))


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows whose id is divisible by ``every``.

    An anchor's positives are its best other rows of the same label; of each, the best rows of other labels come whose score
    is from ``low`` to ``high`` hundredths of the positive's.  Scores are inner products of floor(scale * x); ties go to the
    smaller id, null last.  Rows with a null label or vector, or with a component that is null or not finite, take no part;
    a shorter vector goes on with zeros; rows without an id are found but are no anchors.  A repeated row is an anchor as often
    as it occurs and a positive of its copies.  Positives without a negative give no row.
    """
    small_batches(rows)
    name = rows[label]
    code = name.cast("long") if isinstance(rows.schema[label].dataType, T.IntegralType) else F.xxhash64(name)
    whole = usable(rows.filter(name.isNotNull()), scale, key, vector, code.alias("label"))
    asking = whole.filter(F.col("vec_id") % every == 0)
    keys = ["z", "label"]
    found, queries = classes(whole, keys, max(positives + 1, negatives)), asked(asking, keys)
    index = Index.build(found)
    alike = index.search(queries.withColumn("scores", F.array(F.lit(0).cast("long"))), lambda _: [(int(_LEAST), int(_MOST))], True, positives + 1)
    best = written(_rows_of(alike, found, queries, ["qid"], positives + 1))
    ahead = queries.join(best.select("qid", F.array_distinct(F.transform("r", lambda s: s["score"])).alias("scores")), "qid")
    apart = index.search(ahead, lambda scores: [(-(-low * p // 100), high * p // 100) for p in scores], False, negatives)
    wrong = _rows_of(apart, found, queries, ["qid", "window"], negatives).join(ahead.select("qid", "scores"), "qid")
    by_score = wrong.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("scores")[F.col("window")], "r"))).alias("wrong"))
    answers = queries.join(best, "qid").join(by_score, "qid").select("h", *keys, "r", "wrong")
    joined = asking.withColumn("h", F.xxhash64(*keys)).join(answers, ["h", *keys])
    self_at = F.coalesce(F.array_position(F.transform("r", lambda s: s["own"] & (s["id"] == F.col("vec_id"))), True), F.lit(0))
    others = F.slice(F.filter("r", lambda s, i: self_at != i + 1), 1, positives)
    pairs = joined.select(F.col("vec_id").alias("anchor_id"), "wrong", F.explode(others).alias("p"))
    out = pairs.select("anchor_id", "p", F.posexplode(F.col("wrong")[F.col("p.score")]).alias("at", "s"))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("s.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("s.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``; where vec_id is divisible by 7, the label moves on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved: Column = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP12_SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS z FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.z, c.z)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
