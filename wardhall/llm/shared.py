"""Tables between steps, in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this process only where that is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="wardhall-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs no earlier step.

    The folder stays until ``spent`` deletes it, for a result that is not read yet may need it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")  # nothing reads this step's shuffle files again
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_folder = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes the folders of ``written`` tables that nothing reads any more."""
    for table in tables:
        path = table._step_folder
        jvm = table.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    ``edges`` has the columns a and b.  Alternates the large star and the small star: each moves edges towards the
    least neighbour, and the number of rounds grows with the logarithm of the nodes.  Minima are aggregated before they
    are joined, so a node with very many neighbours is never one group of rows.  Raises if ``rounds`` don't settle them.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, now = now, written(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        spent(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(now.groupBy("v").agg(F.min("v")).join(now.select("u").distinct(), F.col("v") == F.col("u"), "left_anti"))
