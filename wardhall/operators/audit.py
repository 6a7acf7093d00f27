"""The access log: which principal did what to which audited table."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AUDIT_LEVELS, Project

LOG, ROLE = "__wardhall__.access_log", "audit"
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("at", T.TimestampType()), ("principal", T.StringType()), ("action", T.StringType()), ("level", T.StringType()), ("table_name", T.StringType()), ("columns", T.ArrayType(T.StringType())), ("row_count", T.LongType()))])
_LEVEL = {"select": "read", "insert": "write", "update": "write", "delete": "write", "truncate": "write", "erase": "write", "sweep": "write", "attach": "ddl", "migrate": "ddl", "detach": "ddl"}


def merged_levels(before: Iterable[str], added: Iterable[str]) -> list[str]:
    """Levels of both, once each, in the fixed order: attaching never logs less."""
    both = set(before) | set(added)
    return [a for a in AUDIT_LEVELS if a in both and (a != "none" or len(both) == 1)]


def audited(project: Project, path: str, action: str) -> bool:
    """Whether an action on a table is logged."""
    return project.database.audit_enabled and project.table(path).audit_enabled and _LEVEL.get(action, "misc") in project.database.audit_logged


def entry(spark: SparkSession, at: dt.datetime, principal: str, action: str, path: str, columns: list[str] | None = None, row_count: int | None = None) -> DataFrame:
    return spark.createDataFrame([(at, principal, action, _LEVEL.get(action, "misc"), path, columns or [], row_count)], SCHEMA)


class Reads:
    """Counts what is read: rows of observed frames, each time that a plan with them runs to its end.

    A frame is observed under a name of its own; Spark reports the names that a finished query counted, with the numbers,
    and a query that never runs, or fails, reports nothing.  Reports come on Spark's own thread, where no job may be
    started, so they are kept here until ``taken``.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._known, self._named, self._ready, self._lock, self._sessions = spark, {}, {}, [], threading.Lock(), []
        ensure_callback_server_started(spark.sparkContext._gateway)
        self._listener = _Listener(self)

    def observed(self, df: DataFrame, counted: bool = True, **about: object) -> DataFrame:
        """The same rows; ``about`` is what ``taken`` says of each reading of them.

        A count has to see every row, so predicates that a caller adds are not moved below it.  Without one, the frame only
        has a name that Spark's plans keep until they are optimised.
        """
        session = df.sparkSession._jsparkSession
        if not any(session.equals(s) for s in self._sessions):
            session.listenerManager().register(self._listener)
            self._sessions.append(session)
        name = f"read-{uuid.uuid4().hex}"
        (self._known if counted else self._named)[name] = about
        return df.observe(name, F.count(F.lit(1)).alias("n")) if counted else df.alias(name)

    def report(self, execution: object) -> None:
        metrics = SparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(execution.observedMetrics())
        found = [(self._known[n], metrics[n].getLong(0)) for n in metrics if n in self._known]
        plan = execution.analyzed().toString() if self._named else ""
        found += [(about, None) for n, about in list(self._named.items()) if n in plan]
        with self._lock:
            self._ready += found

    def taken(self) -> list[tuple[dict, int | None]]:
        """(about, rows, if they were counted) of all readings that have ended since; waits until Spark has reported those that are over."""
        self._spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self._lock:
            out, self._ready = self._ready, []
        return out

    def close(self) -> None:
        for session in self._sessions:
            session.listenerManager().unregister(self._listener)


class _Listener:
    """What Spark calls when a query ends."""

    def __init__(self, reads: Reads):
        self._reads = reads

    def onSuccess(self, name: str, execution: object, nanos: int) -> None:  # noqa: N802
        self._reads.report(execution)

    def onFailure(self, name: str, execution: object, error: object) -> None:  # noqa: N802
        pass

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]
