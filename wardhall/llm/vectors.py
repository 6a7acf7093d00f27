"""Vectors as whole numbers: usable rows, classes of equal ones, and packed blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Components of a block at most, unless one vector has more: what a task holds of each side.
COMPONENTS = 1 << 18


def usable(rows: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding", *more: Column) -> DataFrame:
    """(vec_id, z): floor(scale * x) of each component x as double, saturated at the ends of long.

    Vectors that are null or hold a null or a component that isn't finite are left out.
    """
    x = rows[vector]
    good = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    z = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return rows.filter(good).select(rows[key].cast("long").alias("vec_id"), z.alias("z"), *more)


def classes(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """A written row for each different value of ``keys``: cid, h (a hash of the keys), the keys, ids (its ``keep`` least ids, null last; repeated ids are repeated).

    However many copies a vector has, a task sends on at most ``keep`` of them.
    """
    order = Window.partitionBy("h", *keys).orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("h", F.xxhash64(*keys)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("n", "vec_id"))), lambda s: s["vec_id"])
    return written(few.groupBy("h", *keys).agg(ids.alias("ids")).withColumn("cid", F.monotonically_increasing_id()))


def asked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A written row for each different value of ``keys`` among the rows that ask: qid, h, the keys."""
    return written(rows.withColumn("h", F.xxhash64(*keys)).select("h", *keys).distinct().withColumn("qid", F.monotonically_increasing_id()))


def packed(m: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers in as few bytes each as their range takes, and the type's name."""
    low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return m.astype(kind).tobytes(), kind


def unpacked(data: bytes, kind: str, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, width)


def by_length(z: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length that vectors of a batch have."""
    lengths = z.value_lengths().to_numpy(zero_copy_only=False)
    values = z.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield at, values[starts[at][:, None] + np.arange(width)].astype(np.int64)


def gathered(stream: Iterator[pa.RecordBatch], most: int, *names: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(matrix, other columns) in blocks of vectors of one length, ``most`` rows at most, from a partition's batches."""
    open_blocks: dict[int, list] = {}

    def close(width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        parts = open_blocks.pop(width)
        return np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][i] for p in parts]) for i in range(len(names))]

    for batch in stream:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        for at, m in by_length(batch.column("z")):
            width, room = m.shape[1], max(1, min(most, COMPONENTS // max(1, m.shape[1])))
            for i in range(0, len(at), room):
                open_blocks.setdefault(width, []).append((m[i : i + room], [c[at[i : i + room]] for c in columns]))
                if sum(len(p[0]) for p in open_blocks[width]) >= room:
                    yield close(width)
    for width in list(open_blocks):
        yield close(width)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b`` (a matrix), saturated at the ends of long; shorter vectors go on with zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    size = width * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if size < 2.0**52:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    wide = np.array(a.tolist(), dtype=object).reshape(a.shape) @ np.array(b.tolist(), dtype=object).reshape(b.shape).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def scored(pairs: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, cid, score) of pairs (qid, cid), from the exact vectors of both sides."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = np.zeros(batch.num_rows, np.int64)
            other = batch.column("other")
            for at, q in by_length(batch.column("z")):
                for inner, c in by_length(other.take(pa.array(at))):
                    out[at[inner]] = _rowwise(q[inner], c)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("cid"), pa.array(out)], names=["qid", "cid", "score"])

    both = pairs.join(queries.select("qid", "z"), "qid").join(found.select("cid", F.col("z").alias("other")), "cid")
    return both.select("qid", "cid", "z", "other").mapInArrow(run, "qid long, cid long, score long")


def _rowwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) < 2.0**62:
        return (a * b).sum(axis=1)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(r, s, strict=True)), -(2**63)), 2**63 - 1) for r, s in zip(a, b, strict=True)], dtype=np.int64)
