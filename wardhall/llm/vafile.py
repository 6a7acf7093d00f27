"""Exact top-k search by inner product: vector-approximation files.

Blocks of vectors are quantised: each component becomes the number of its cell, and a block keeps the least and the greatest
value of each cell.  A scan of cells bounds every score from above and below; only vectors whose upper bound reaches the
k-th lower bound go on, and their exact components are read in the order of the bounds until nothing left can be better.
(For a distance the bounds change sides: a score's upper bound is the distance's lower bound.)

Queries grow with the table, so they meet it in blocks of both: each pair of blocks is a group of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import small_batches, table
from .shared import written
from .vectors import asked, by_length, classes, gathered, packed, scored, unpacked, usable

#: Query parameters: every vector whose id is divisible by ``EVERY`` asks for its ``TOP`` best.
SCALE, EVERY, TOP = 256, 50, 5
#: Cells of a component in a block; vectors and queries of a block; vectors read in the first wave for each query.
CELLS, ROWS, ASKING, WAVE = 64, 4096, 512, 16

_BLOCK = "block long, n int, width int, keys binary, cells binary, low binary, high binary, low_kind string, high_kind string"
_QUERIES = "block long, n int, width int, keys binary, z binary, kind string"


def _cells(m: np.ndarray, cells_each: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each component, least value of each cell of each component, greatest value)."""
    wide = m.astype(float)
    low, span = wide.min(axis=0), wide.max(axis=0) - wide.min(axis=0) + 1
    cells = np.clip((wide - low) / span * cells_each, 0, cells_each - 1).astype(np.uint8)
    flat = (cells + np.arange(m.shape[1]) * cells_each).ravel()
    least, most = (np.full(m.shape[1] * cells_each, v, np.int64) for v in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
    np.minimum.at(least, flat, m.ravel())
    np.maximum.at(most, flat, m.ravel())
    unused = least > most
    least[unused] = most[unused] = 0
    return cells, least, most


def approximations(found: DataFrame) -> DataFrame:
    """Classes (cid, z) as blocks of cells."""
    cells_each, rows = CELLS, ROWS

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, (keys,) in gathered(stream, rows, "cid"):
            cells, low, high = _cells(m, cells_each)
            (low, low_kind), (high, high_kind) = packed(low), packed(high)
            values = [int(keys[0]), len(keys), m.shape[1], keys.astype("<i8").tobytes(), cells.tobytes(), low, high, low_kind, high_kind]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.string(), pa.string()], strict=True)], names=[f.split()[0] for f in _BLOCK.split(", ")])

    return written(found.select("cid", "z").mapInArrow(run, _BLOCK))


def query_blocks(queries: DataFrame) -> DataFrame:
    """Queries (qid, z) in blocks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, (keys,) in gathered(stream, ASKING, "qid"):
            z, kind = packed(m)
            values = [int(keys[0]), len(keys), m.shape[1], keys.astype("<i8").tobytes(), z, kind]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()], strict=True)], names=[f.split()[0] for f in _QUERIES.split(", ")])

    return written(queries.select("qid", "z").mapInArrow(run, _QUERIES))


def _scan(k: int):
    """For a pair of groups of blocks: (qid, cid, ub, lb) of all vectors that may be among a query's k best of the group."""
    cells_each = CELLS

    def run(asking: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a in asking.to_pylist():
            qids, q = np.frombuffer(a["keys"], "<i8"), unpacked(a["z"], a["kind"], a["width"], a["n"]).astype(float)
            best = np.full((len(q), k), -np.inf)
            for b in blocks.to_pylist():
                cids, width = np.frombuffer(b["keys"], "<i8"), b["width"]
                cells = np.frombuffer(b["cells"], np.uint8).reshape(b["n"], width) + np.arange(width) * cells_each
                low, high = (unpacked(b[n], b[f"{n}_kind"], width, cells_each).astype(float).ravel()[cells[:, : q.shape[1]]] for n in ("low", "high"))
                mine = q[:, :width]
                middle, reach = mine @ (low + high).T / 2, np.abs(mine) @ (high - low).T / 2
                size = np.abs(mine) @ np.maximum(np.abs(low), np.abs(high)).T
                reach += np.where(size < 2.0**50, 0, size * 1e-12)  # sums of whole numbers are exact up to there
                upper, lower = middle + reach, middle - reach
                both = np.concatenate([best, lower], axis=1)
                best = -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
                at, to = np.nonzero(upper >= best.min(axis=1)[:, None])
                for part, value in zip(out, (qids[at], cids[to], upper[at, to], lower[at, to]), strict=True):
                    part.append(value)
        return pa.table({n: np.concatenate(p) if p else np.zeros(0, t) for n, p, t in zip(("qid", "cid", "ub", "lb"), out, ("<i8", "<i8", float, float), strict=True)})

    return run


def bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, cid, ub, lb): of each query, no vector of its k best is missing."""
    left, right = query_blocks(queries), approximations(found)
    n, m = max(1, left.count()), max(1, right.count())
    lane = lambda count: F.pmod(F.xxhash64("block"), F.lit(count))
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = left.withColumn("row_lane", lane(n)).withColumn("column_lane", numbers(m))
    right = right.withColumn("row_lane", numbers(n)).withColumn("column_lane", lane(m))
    pairs = left.groupBy("row_lane", "column_lane").cogroup(right.groupBy("row_lane", "column_lane"))
    some = written(pairs.applyInArrow(_scan(k), "qid long, cid long, ub double, lb double"))
    order = Window.partitionBy("qid").orderBy(F.col("lb").desc())
    least = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("lb")).alias("least"))
    return some.join(least, "qid").filter(F.col("least").isNull() | (F.col("ub") >= F.col("least"))).drop("least")


def best_classes(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, cid, score, ids) of each query's k best classes, ties to the class with the smaller least id, null last.

    Vectors are read in two waves in the order of their upper bounds: the first ``WAVE`` of each query, then those whose
    bound still reaches the k-th exact score.  What isn't read is certain to be worse.
    """
    some = written(bounded(queries, found, k))
    order = F.struct("ub", -F.col("cid"))
    first = some.withColumn("at", order).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("at").desc()))).filter(F.col("n") <= max(k, WAVE))
    read = written(scored(first, queries, found))
    edge = first.groupBy("qid").agg(F.min("at").alias("edge"))
    kth = read.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))).filter(F.col("n") <= k).groupBy("qid").agg(F.min("score").alias("kth"))
    rest = some.withColumn("at", order).join(edge, "qid").join(kth, "qid").filter((F.col("at") < F.col("edge")) & (F.col("ub") >= F.col("kth"))).select("qid", "cid")
    both = read.unionByName(scored(rest, queries, found)).join(found.select("cid", "ids"), "cid")
    rank = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("ids")[0].asc_nulls_last())
    return both.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k).drop("n")


def nearest(rows: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best rows of each row whose id is divisible by ``every``.

    Scores are inner products of floor(scale * x); ties go to the smaller id, null last.  Vectors that are null or hold a
    null or a component that isn't finite take no part; a shorter vector goes on with zeros.  Rows without an id are found
    but don't ask.  A repeated row asks as often as it occurs, and finds its other copies, under their own id as well.
    Equal vectors are searched once, by their least ids, however many copies there are.
    """
    small_batches(rows)
    whole = usable(rows, scale, key, vector)
    asking = whole.filter(F.col("vec_id") % every == 0)
    found, queries = classes(whole, ["z"], top + 1), asked(asking, ["z"])
    best = best_classes(queries, found, top + 1)
    listed = best.join(queries.select("qid", F.col("h").alias("own_h"), F.col("z").alias("own_z")), "qid").join(found.select("cid", "h", "z"), "cid")
    one = listed.select("qid", "own_h", "own_z", "score", ((F.col("h") == F.col("own_h")) & (F.col("z") == F.col("own_z"))).alias("own"), F.explode("ids").alias("id"))
    ranks = F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("o"), F.col("id").isNull().alias("gone"), "id", "score", "own")))
    answers = one.groupBy("qid").agg(F.first("own_h").alias("h"), F.first("own_z").alias("z"), F.slice(ranks, 1, top + 1).alias("r"))
    joined = asking.withColumn("h", F.xxhash64("z")).join(answers, ["h", "z"])
    self_at = F.array_position(F.transform("r", lambda s: s["own"] & (s["id"] == F.col("vec_id"))), True)
    others = F.slice(F.filter("r", lambda s, i: F.coalesce(self_at, F.lit(0)) != i + 1), 1, top)
    out = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "s"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of ``embeddings`` for every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS z FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}"""
