"""Where steps of the engine keep what they write between jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_OWN: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this process only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="governed-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def confs(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for as long as a step runs; a double underscore stands for a dot."""
    names = {n.replace("__", "."): v for n, v in values.items()}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
