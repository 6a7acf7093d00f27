"""Erasure file by file: only files that hold a subject, or a period that is over, are read and written again.

Tables with an expiry are written in folders by the day on which rows expire and by whether a legal hold keeps them, so a
sweep drops whole days by their folders' names and reads only the days around its moment.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EXPIRES, ON_EXPIRY, Table
from .erase import expired, swept

PERIOD, HELD = "__period__", "__held__"
_PLACE = re.compile(rf"/{PERIOD}=([^/]*)/{HELD}=(true|false)/")


def by_period(df: DataFrame) -> DataFrame:
    """Rows with the folder that they belong to, clustered by it; large days are several files, small ones are put together."""
    marked = df.withColumn(PERIOD, F.to_date(F.col(EXPIRES))).withColumn(HELD, ~F.coalesce(F.col(ON_EXPIRY), F.lit(False)))
    return marked.hint("rebalance", F.col(PERIOD), F.col(HELD))


@dataclass
class Sweep:
    """Files that go as they are, files that are read again, and what is left of those."""

    dropped: list[str]
    read: list[str]
    left: DataFrame | None
    rows: int

    @property
    def files(self) -> list[str]:
        return [*self.dropped, *self.read]


def sweep(store, name: str, table: Table, as_of: dt.datetime | str) -> Sweep:
    """What a sweep does to a table of a store.

    Days that ended a day or more before ``as_of``, whatever the session's time zone then and now, are dropped unread if
    rows are deleted; the days around it, and all days up to it if rows are changed, are read.  Days of held rows, and
    later ones, are not touched.  Files that lie in no day's folder are read.
    """
    moment = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    day, dropped, read = moment.date(), [], []
    for f in store.files(name):
        place = _PLACE.search(unquote(f))
        if place is None:
            read.append(f)
            continue
        if place[2] == "true" or not re.fullmatch(r"\d{4}-\d\d-\d\d", place[1]):
            continue  # held, or without an expiry
        of = dt.date.fromisoformat(place[1])
        if of > day + dt.timedelta(days=1):
            continue
        (dropped if table.erase_strategy == "delete" and of < day - dt.timedelta(days=1) else read).append(f)
    rows, left = store.rows_of(name, dropped).count() if dropped else 0, None
    if read:
        old = store.rows_of(name, read)
        n = old.filter(expired(old, as_of)).count()
        if n:
            rows, left = rows + n, swept(table, old, as_of)
        else:
            read = []
    return Sweep(dropped, read, left, rows)


def files_with(store, name: str, predicate: Col) -> list[str]:
    """Files of a table that hold a matching row; statistics, dictionaries and Bloom filters in their footers rule out most of the others."""
    return [r[0] for r in store.scan(name).filter(predicate).select(F.col("_metadata.file_path")).distinct().collect()]
