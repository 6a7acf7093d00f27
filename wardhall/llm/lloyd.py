"""Centroid clustering: Lloyd's rounds over whole numbers.

Centroids go to all tasks; each task takes squared differences to every centroid in NumPy and adds up its own vectors by
cluster, so a round sends 16 rows of sums for each partition, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import small_batches, table
from .shared import written

#: Query parameters.
CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 16, 3, 64, 64, 1
_LONG = 2**63 - 1


def _kept(x: Column, width: int) -> Column:
    return F.coalesce((F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf")))), F.lit(False))


def _whole(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) as long, saturated."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * np.stack(vectors.to_numpy()).astype(np.float64))
    return np.where(x >= 2.0**63, _LONG, np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64))


def _squared(z: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid; whole, saturated at long's end."""
    reach = max((int(np.abs(m.astype(float)).max(initial=0)) for m in (z, centroids)), default=0)
    if z.shape[1] * (2 * reach) ** 2 < 2**62:
        return np.stack([((z - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    wide = np.array(z.tolist(), dtype=object)
    return np.stack([np.array([min(int(v), _LONG) for v in ((wide - np.array(c.tolist(), dtype=object)) ** 2).sum(axis=1)], dtype=np.int64) for c in centroids], axis=1)


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sums of each cluster that has any: clusters * width numbers reach the driver."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, dtype=object), [0] * len(centroids)
        for part in stream:
            if not len(part):
                continue
            z = _whole(part["x"], scale)
            near = _squared(z, centroids).argmin(axis=1)
            small = float(np.abs(z.astype(float)).max()) * len(z) < 2.0**62
            for c in np.unique(near):
                own = z[near == c]
                total[c] += (own.sum(axis=0) if small else np.array(own.tolist(), dtype=object).sum(axis=0)).astype(object)
                count[c] += len(own)
        some = [c for c, n in enumerate(count) if n]
        if some:
            yield pd.DataFrame({"cluster": some, "n": [count[c] for c in some], "total": [[Decimal(int(v)) for v in total[c]] for c in some]})

    parts = rows.select("x").mapInPandas(run, "cluster int, n long, total array<decimal(38,0)>")
    summed = parts.select("cluster", "n", F.posexplode("total").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v").cast("decimal(38,0)").alias("v"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(summed.collect(), key=lambda r: (r["cluster"], r["at"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["v"]))
    return out


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``width`` finite components.

    Vectors that are null, of another width, or hold a null or a component that isn't finite are left out.  Centroids start
    as the vectors with the least SHA-256 of ``seed:id`` (equal ids: by components); rows without an id are assigned, but
    start none.  With fewer such vectors there are fewer centroids, and none at all leave no rows.  Repeated rows count as
    often as they occur.  Sums are whole whatever their size; distances and inertias beyond long stay at its end.
    """
    x = rows[vector]
    kept = small_batches(rows.filter(_kept(x, width)).select(rows[key].alias("vec_id"), x.alias("x")))
    named = kept.filter(F.col("vec_id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    first = named.orderBy("hash", "x").limit(clusters).collect()
    result = "vec_id " + dict(kept.dtypes)["vec_id"] + ", cluster int, distance long"
    final = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = rows.sparkSession
    if not first:
        return spark.createDataFrame([], f"{result}, {final.removeprefix('cluster int, ')}")
    centroids = _whole(pd.Series([r["x"] for r in first]), scale)
    for _ in range(rounds):
        for c, (n, total) in _sums(kept, centroids, scale).items():
            centroids[c] = [v // n for v in total]

    def assign(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            if len(part):
                far = _squared(_whole(part["x"], scale), centroids)
                near = far.argmin(axis=1)
                yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": near.astype(np.int32), "distance": far[np.arange(len(near)), near]})

    out = written(kept.mapInPandas(assign, result))
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), _LONG)
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, min(s, _LONG), whole, digest[c]) for c, s in sorted(sums.items())], final)
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of ``embeddings``."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds one after another, as SQL over rows of (vector, component)."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS z FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), z) - 1 AS c, z FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(list_zip(v.z, c{k}.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < ROUNDS:
            steps.append(f"m{k} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS z FROM (SELECT c, i, (sum(z[i]) - (((sum(z[i]) % count(*)) + count(*)) % count(*))) // count(*) AS m FROM v JOIN d{k} USING (r), unnest(range(1, {WIDTH + 1})) AS t(i) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.z, c{k}.z)::BIGINT[] AS z FROM c{k} LEFT JOIN m{k} USING (c))")
    last = f"d{ROUNDS}"
    return f"WITH {', '.join(steps)}\nSELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.z, ',')) AS centroid_sha256 FROM v JOIN {last} USING (r) JOIN c{ROUNDS} USING (c)"


OP13_SQL = _oracle()
