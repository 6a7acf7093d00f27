"""Writes as new rows of a table: insert, update, delete, history, checks.  Each takes and returns DataFrames."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EXPIRES, FOREVER, ON_EXPIRY, VALID_FROM, VALID_TO, ForeignKey, GovernanceError, Table


def moment(now: dt.datetime | str, kind: T.DataType) -> Col:
    """A point in time as a literal of a column's type, with or without zone."""
    text = now if isinstance(now, str) else now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast(kind)


def writable(table: Table) -> list[str]:
    return [c.name for c in table.columns if not c.generated_expression]


def fill_defaults(table: Table, rows: DataFrame) -> DataFrame:
    """Declared defaults where a value is null or the column is missing; a default's null can't be kept out."""
    for c in table.columns:
        if c.generated_expression or (c.default is None and c.name in rows.columns):
            continue
        given = F.col(c.name) if c.name in rows.columns else F.lit(None)
        rows = rows.withColumn(c.name, F.coalesce(given, F.expr(c.default)) if c.default is not None else given)
    return rows


def generated(table: Table, rows: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    for c in table.columns:
        if c.generated_expression and not c.virtual and c.name in kinds:
            rows = rows.withColumn(c.name, F.expr(c.generated_expression).cast(kinds[c.name]))
    return rows


def with_history(df: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Every row as a live version from ``now`` on."""
    return df.withColumn(VALID_FROM, moment(now, T.TimestampNTZType())).withColumn(VALID_TO, F.lit(FOREVER).cast("timestamp_ntz"))


def with_retention(df: DataFrame, days: int, inserted: Col, hold: Col | None = None) -> DataFrame:
    """Expiry ``days`` after ``inserted``; rows under a legal hold are not erased on expiry."""
    return df.withColumn(EXPIRES, inserted + F.expr(f"INTERVAL {int(days)} DAYS")).withColumn(ON_EXPIRY, F.lit(True) if hold is None else ~F.coalesce(hold, F.lit(False)))


def is_live() -> Col:
    return F.col(VALID_TO) == F.lit(FOREVER).cast("timestamp_ntz")


def inserted(table: Table, old: DataFrame, rows: DataFrame, now: dt.datetime | str) -> DataFrame:
    """The table with new rows: defaults filled, generated and system columns set."""
    kinds = {f.name: f.dataType for f in old.schema}
    new = generated(table, fill_defaults(table, rows), kinds)
    if VALID_TO in kinds:
        new = with_history(new, now)
    if EXPIRES in kinds:
        new = with_retention(new, table.retention_days or 0, moment(now, kinds[EXPIRES]))
    new = new.select(*[(F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    return old.unionByName(new)


def assigned(table: Table, changes: dict[str, Col | str], kinds: dict[str, T.DataType]) -> dict[str, Col]:
    known = set(writable(table))
    if unknown := set(changes) - known:
        raise GovernanceError(f"{table.name}: cannot assign {', '.join(sorted(unknown))}")
    return {n: (F.expr(e) if isinstance(e, str) else e).cast(kinds[n]) for n, e in changes.items()}


def changed_immutable(table: Table, df: DataFrame, match: Col, changes: dict[str, Col]) -> DataFrame:
    """Rows in which an update would change an immutable column; null and value differ."""
    frozen = [c.name for c in table.columns if c.immutable and c.name in changes]
    if not frozen:
        return df.limit(0)
    return df.filter(match & reduce(lambda a, b: a | b, [~F.col(n).eqNullSafe(changes[n]) for n in frozen]))


def updated(table: Table, old: DataFrame, match: Col, changes: dict[str, Col | str], now: dt.datetime | str) -> DataFrame:
    """The table with assigned columns changed where ``match`` holds.

    A versioned table keeps the old version, closed at ``now``, and gets a new one: one for each live row.  Versions
    that are closed already don't change.  Columns that are not assigned keep their values.
    """
    kinds = {f.name: f.dataType for f in old.schema}
    new = assigned(table, changes, kinds)
    match = F.coalesce(match, F.lit(False))
    if VALID_TO not in kinds:
        out = old.select(*[F.when(match, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns])
        return _regenerated(table, out, kinds)
    hit = match & is_live()
    at = moment(now, kinds[VALID_TO])
    # One scan for both versions: a hit row becomes two, any other stays one.
    marked = old.withColumn("__copy__", F.explode(F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2)))))
    copy = F.col("__copy__")
    values = {c: F.when(copy == 1, new[c]).otherwise(F.col(c)) if c in new else F.col(c) for c in old.columns}
    values[VALID_TO] = F.when(copy == 0, at).otherwise(F.col(VALID_TO))
    values[VALID_FROM] = F.when(copy == 1, at).otherwise(F.col(VALID_FROM))
    out = marked.select(*[v.alias(c) for c, v in values.items()], copy)
    return _regenerated(table, out, kinds).drop("__copy__")


def _regenerated(table: Table, df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """Generated columns follow their inputs."""
    for c in table.columns:
        if c.generated_expression and not c.virtual and c.name in kinds:
            df = df.withColumn(c.name, F.expr(c.generated_expression).cast(kinds[c.name]))
    return df


def deleted(table: Table, old: DataFrame, match: Col, now: dt.datetime | str) -> DataFrame:
    """The table without the matching rows; a versioned one closes their live versions instead."""
    match = F.coalesce(match, F.lit(False))
    if VALID_TO not in old.columns:
        return old.filter(~match)
    kind = old.schema[VALID_TO].dataType
    return old.withColumn(VALID_TO, F.when(match & is_live(), moment(now, kind)).otherwise(F.col(VALID_TO)))


def deleted_by_key(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The same for a table of keys, as an anti join."""
    return old.join(keys.select(*on).distinct(), on, "left_anti").select(*old.columns)


# --- constraints ----------------------------------------------------------------------------------------------


def duplicate_keys(table: Table, df: DataFrame) -> DataFrame:
    """Key values of more than one row, of live rows in a versioned table; n says how many."""
    if not table.key:
        raise GovernanceError(f"{table.name} has no primary key")
    rows = df.filter(is_live()) if VALID_TO in df.columns else df
    return rows.groupBy(*table.key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(fk: ForeignKey, df: DataFrame, referenced: DataFrame) -> DataFrame:
    """Rows whose reference isn't there; a null refers to nothing."""
    keys = referenced.select(F.col(fk.referenced_column).alias("__key__")).distinct()
    return df.filter(F.col(fk.column).isNotNull()).join(keys, F.col(fk.column) == F.col("__key__"), "left_anti")


def missing_values(table: Table, df: DataFrame) -> DataFrame:
    """Rows with a null in a required column."""
    needed = [c.name for c in table.columns if not c.nullable and c.name in df.columns]
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed])) if needed else df.limit(0)


def refuse(rows: DataFrame, why: str) -> None:
    """Raises if there is a row.  Says nothing of its values: the caller may not see them."""
    if rows.limit(1).count():
        raise GovernanceError(why)
