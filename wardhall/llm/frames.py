"""What the operators of this subpackage share: reading, batches of Arrow columns, the fit split, broadcasts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts are long, and a worker holds a batch and its results.
ROWS = 250


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Python workers find this package where it lies, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only, so any file system does."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys_and_text(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """Only what an operator reads, under fixed names, whatever else the table holds."""
    return docs.select(docs[key].alias("doc_id"), docs[text].cast("binary").alias("text"), *more)


def small_batches(df: DataFrame) -> DataFrame:
    """Has the session send no more rows at once than a worker's memory is laid out for: whole texts may be long."""
    importable(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """``work`` on each Arrow batch; it returns a column of values for each name in ``schema``."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                found = work(batch.slice(at, ROWS))
                yield pa.RecordBatch.from_arrays([found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], type=f.type) for f in out], schema=out)

    return small_batches(df).mapInArrow(run, fields)


def held_out(key: str | Column) -> Column:
    """Rows that no model learns from: crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, spread by a hash of the id; rows held out or without id or label are left out."""
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), min(1_000_000, -(-per_label * 1_000_000 // n))).otherwise(share)
    spread = F.xxhash64("doc_id")
    return rows.filter(F.pmod(spread, F.lit(1_000_000)) < share).orderBy(spread, *rows.columns).limit(2 * per_label * max(1, len(sizes)))


def fit_sample(rows: DataFrame, label: str, per_label: int, max_chars: int) -> list:
    """A bounded sample to fit on, of rows with the columns doc_id, text and ``label``.

    Rows come in one order, however the table is split.  Texts that are null or longer than ``max_chars`` are left out before rows are drawn; a label with longer texts only
    gives their first ``max_chars`` characters.  So the driver gets at most 2 * per_label * labels * max_chars characters.
    """
    rows = rows.filter(F.col("text").isNotNull()).select("doc_id", "text", label)
    found = _spread(rows.filter(F.length("text") <= max_chars), label, per_label).collect()
    rest = rows.filter(~F.col(label).isin(sorted({r[label] for r in found}))).withColumn("text", F.substring("text", 1, max_chars))
    return sorted(found + _spread(rest, label, per_label).collect(), key=lambda r: (r["doc_id"], r["text"]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, max_chars: int) -> list:
    """The same with the labels in another table (doc_id, ``label``): ids are drawn first, so that texts don't move.

    The drawn ids are 2 * per_label * labels at most, which is what is broadcast.
    """
    drawn = _spread(labels, label, per_label).select("doc_id", label).collect()
    ids = labels.sparkSession.createDataFrame([tuple(r) for r in drawn], labels.select("doc_id", label).schema)
    short = docs.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    some = short.join(F.broadcast(ids), "doc_id").select("doc_id", "text", label)
    return sorted(some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(4 * per_label).collect(), key=lambda r: (r["doc_id"], r["text"]))
