"""Data-subject erasure and retention, as rewrites of tables."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.erasure import nullified, obfuscated
from ..model import EXPIRES, ON_EXPIRY, SYSTEM_COLUMNS, GovernanceError, Project, Schema, Table
from .dml import moment


def subject_tables(project: Project) -> list[tuple[Schema, Table]]:
    return [(s, t) for s, t in project.tables() if t.identifiers and t.erase_strategy]


def subject_match(table: Table, df: DataFrame, columns: list[str], values: list[str]) -> Col | None:
    """Rows of a subject: every supplied column that is an identifier of this table agrees; None if none is."""
    found = subject_predicate(table, df, columns, values)
    return None if found is None else F.coalesce(found, F.lit(False))


def subject_predicate(table: Table, df: DataFrame, columns: list[str], values: list[str]) -> Col | None:
    """The same in a form that reaches the scan; null where a compared value is null."""
    if len(columns) != len(values):
        raise GovernanceError("as many values as columns are needed")
    parts = [F.col(c) == F.lit(v).try_cast(df.schema[c].dataType) for c, v in zip(columns, values, strict=True) if c in table.identifiers]
    return reduce(lambda a, b: a & b, parts) if parts else None


def erase_check(project: Project, read, columns: list[str], values: list[str]) -> DataFrame:
    """(schema_name, table_name, erase_strategy, rows_matched) for every table of which a supplied column is an identifier, zeros included; no rows if there is none."""
    if len(columns) != len(values):
        raise GovernanceError("as many values as columns are needed")
    out = None
    for s, t in subject_tables(project):
        df = read(f"{s.name}.{t.name}")
        match = subject_match(t, df, columns, values)
        if match is None:
            continue
        row = df.agg(F.count(F.when(match, 1)).alias("rows_matched")).select(F.lit(s.name).alias("schema_name"), F.lit(t.name).alias("table_name"), F.lit(t.erase_strategy).alias("erase_strategy"), "rows_matched")
        out = row if out is None else out.unionByName(row)
    if out is None:
        return SparkSession.active().createDataFrame([], "schema_name string, table_name string, erase_strategy string, rows_matched long")
    return out


def erased(table: Table, df: DataFrame, match: Col, strategy: str | None = None, identifiers_too: bool = False) -> DataFrame:
    """The table after erasure of the matching rows.

    ``delete`` drops them.  ``nullify`` and ``obfuscate`` change the columns that are neither identifiers (unless
    ``identifiers_too``), nor of the primary key, nor generated, nor the engine's own; generated ones follow.  A table without such columns
    loses the rows.  One pass, no shuffle.
    """
    strategy = strategy or table.erase_strategy
    match = F.coalesce(match, F.lit(False))
    spared = set(SYSTEM_COLUMNS) | set(table.key) | (set() if identifiers_too else set(table.identifiers))
    targets = [c for c in table.columns if c.name in df.columns and c.name not in spared and not c.generated_expression]
    if strategy == "delete" or not targets:
        return df.filter(~match)
    values = {}
    for c in targets:
        kind = df.schema[c.name].dataType
        new = nullified(kind, c.nullable) if strategy == "nullify" else obfuscated(F.col(c.name), kind, c.type, c.nullable)
        values[c.name] = F.when(match, new).otherwise(F.col(c.name))
    hidden = f"__{uuid.uuid4().hex}__"
    out = df.withColumn(hidden, match).select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns], hidden)
    for c in table.columns:  # what was worked out from erased values is worked out anew
        if c.generated_expression and not c.virtual and c.name in df.columns:
            again = F.expr(c.generated_expression).cast(df.schema[c.name].dataType)
            out = out.withColumn(c.name, F.when(F.col(hidden), again).otherwise(F.col(c.name)))
    return out.drop(hidden)


def expired(df: DataFrame, as_of: dt.datetime | str) -> Col:
    """Rows whose time is over and that no legal hold keeps."""
    return F.coalesce((F.col(EXPIRES) <= moment(as_of, df.schema[EXPIRES].dataType)) & F.col(ON_EXPIRY), F.lit(False))


def swept(table: Table, df: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """The table after a retention sweep.  Rows that stay, nullified or obfuscated, are not swept again."""
    hit = expired(df, as_of)
    out = erased(table, df.withColumn("__hit__", hit), F.col("__hit__"), identifiers_too=True)
    return out.withColumn(ON_EXPIRY, F.when(F.col("__hit__"), F.lit(False)).otherwise(F.col(ON_EXPIRY))).drop("__hit__")
