"""Row policies: predicates in Spark SQL, with the caller's name put in as a literal.

A policy may ask other tables of the specification, by schema and name, with ``IN`` and ``EXISTS``; it sees their stored rows.
Catalyst turns each such question into a semi join that keeps a flag, so policies of either kind are joined by OR.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Project, RowPolicy, Table

_CALLER = re.compile(r"\bcurrent_principal\s*\(\s*\)", re.IGNORECASE)
_QUOTED = re.compile(r"('(?:[^'\\]|\\.|'')*')", re.DOTALL)
_NOT_IN = re.compile(r"\bnot\s+in\s*\(\s*(select|with)\b", re.IGNORECASE)
PUBLIC = "PUBLIC"
Rename = Callable[[str], str]


def _same(text: str) -> str:
    return text


@contextmanager
def related(project: Project, table: Table, spark: SparkSession, read: Callable[[str], DataFrame]) -> Iterator[Rename]:
    """Other tables that a table's policies ask, as views under names of their own for as long as plans are made.

    Yields what puts these names into a policy's text; literals in quotes stay as they are.
    """
    texts = [t for p in table.rls_policies for t in (p.using_expr, p.check)] if table.rls_enabled else []
    names: list[tuple[re.Pattern, str]] = []
    try:
        for s, t in project.tables():
            pattern = re.compile(rf"(?<![\w.`]){re.escape(s.name)}\.{re.escape(t.name)}(?![\w`(])")
            if any(pattern.search(part) for text in texts for part in _QUOTED.split(text)[::2]):
                names.append((pattern, f"__asked_{uuid.uuid4().hex}__"))
                read(f"{s.name}.{t.name}").createOrReplaceTempView(names[-1][1])
        if names and any(_NOT_IN.search(t) for t in texts):
            warnings.warn(f"a policy of {table.name} uses NOT IN over a table, which is compared row by row; NOT EXISTS is a join", stacklevel=3)

        def rename(text: str) -> str:
            parts = _QUOTED.split(text)
            for pattern, view in names:
                parts[::2] = [pattern.sub(view, part) for part in parts[::2]]
            return "".join(parts)

        yield rename
    finally:
        for _, view in names:
            spark.catalog.dropTempView(view)


def predicate(text: str, principal: str, rename: Rename = _same) -> Col:
    quoted = "'" + principal.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(_CALLER.sub(lambda _: quoted, rename(text)))


def applicable(table: Table, roles: set[str]) -> list[RowPolicy]:
    return [p for p in table.rls_policies if PUBLIC in p.roles or roles & set(p.roles)]


def row_filter(table: Table, principal: str, roles: set[str], bypass: bool, rename: Rename = _same) -> Col | None:
    """Rows that a principal sees: none without a policy of its own, any of its policies otherwise; None is no filter."""
    if not table.rls_enabled or bypass:
        return None
    some = [predicate(p.using_expr, principal, rename) for p in applicable(table, roles)]
    return reduce(lambda a, b: a | b, some) if some else F.lit(False)


def row_check(table: Table, principal: str, roles: set[str], bypass: bool, rename: Rename = _same) -> Col | None:
    """Rows that a principal may write."""
    if not table.rls_enabled or bypass:
        return None
    some = [predicate(p.check, principal, rename) for p in applicable(table, roles)]
    return F.coalesce(reduce(lambda a, b: a | b, some), F.lit(False)) if some else F.lit(False)


def barrier(df: DataFrame) -> DataFrame:
    """The same rows behind a filter that callers' predicates don't cross.

    Catalyst moves no predicate below a filter that isn't deterministic, and this one, which holds for every row, only
    counts as such.  What stands below it, the policy, still reaches the scan.
    """
    return df.filter(F.spark_partition_id() >= 0)
