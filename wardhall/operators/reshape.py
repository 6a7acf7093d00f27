"""Stored tables under a changed declaration: columns, types, history and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EXPIRES, ON_EXPIRY, VALID_FROM, VALID_TO, Table
from ..plans.compile import spark_type
from .dml import is_live, missing_values, moment, refuse, with_history, with_retention


def declared(spark: SparkSession, table: Table) -> DataFrame:
    """No rows, with the columns of a declaration."""
    fields = [T.StructField(c.name, T._parse_datatype_string(spark_type(c.type))) for c in table.columns if not c.virtual]
    return spark.createDataFrame([], T.StructType(fields))


def attached(table: Table, df: DataFrame, now: dt.datetime) -> DataFrame:
    """A plain table with what its declaration adds: generated columns, history, retention.  What is there already stays."""
    for c in table.columns:
        if c.generated_expression and not c.virtual and c.name not in df.columns:
            df = df.withColumn(c.name, F.expr(c.generated_expression).cast(spark_type(c.type)))
    if table.versioned and VALID_TO not in df.columns:
        df = with_history(df, now)
    if table.retention_days and EXPIRES not in df.columns:
        df = with_retention(df, table.retention_days, moment(now, T.TimestampNTZType()))
    return df


def detached(df: DataFrame, drop_history: bool) -> DataFrame:
    """A governed table as a plain one; without its history only live rows are left."""
    if drop_history and VALID_TO in df.columns:
        df = df.filter(is_live()).drop(VALID_FROM, VALID_TO)
    return df.drop(EXPIRES, ON_EXPIRY)


def steps(before: Table, after: Table) -> list[str]:
    """What ``reshaped`` does, in words, for review."""
    old, new = {c.name: c for c in before.columns}, {c.name: c for c in after.columns}
    out = [f"drop column {n}" for n in old if n not in new] + [f"add column {n} {c.type}" for n, c in new.items() if n not in old and not c.virtual]
    for n in new.keys() & old.keys():
        if old[n].type != new[n].type:
            out.append(f"cast column {n} from {old[n].type} to {new[n].type}")
        if old[n].generated_expression != new[n].generated_expression and new[n].generated_expression and not new[n].virtual:
            out.append(f"compute column {n} anew")
        if old[n].nullable and not new[n].nullable:
            out.append(f"require a value in {n}")
    if before.versioned != after.versioned:
        out.append("start history" if after.versioned else "keep live rows only")
    if before.retention_days != after.retention_days:
        out.append("drop retention" if not after.retention_days else f"expire after {after.retention_days} days")
    if before.key != after.key:
        out.append(f"check the new key {', '.join(after.key)}")
    return out


def reshaped(before: Table, after: Table, df: DataFrame, now: dt.datetime) -> DataFrame:
    """A stored table under a new declaration, in one pass.  Columns that neither declaration names stay, at the end."""
    old = {c.name: c for c in before.columns}
    if before.versioned and not after.versioned:
        df = df.filter(is_live()).drop(VALID_FROM, VALID_TO)
    if before.retention_days and not after.retention_days:
        df = df.drop(EXPIRES, ON_EXPIRY)
    out = {}
    for c in after.columns:
        if c.virtual:
            continue
        kind = spark_type(c.type)
        if c.generated_expression and (c.name not in old or old[c.name].generated_expression != c.generated_expression):
            out[c.name] = F.expr(c.generated_expression).cast(kind)
        elif c.name in df.columns:
            out[c.name] = F.col(c.name).cast(kind) if old[c.name].type != c.type else F.col(c.name)
        else:
            out[c.name] = F.expr(c.default).cast(kind) if c.default is not None else F.lit(None).cast(kind)
    system = [c for c in (VALID_FROM, VALID_TO, EXPIRES, ON_EXPIRY) if c in df.columns]
    undeclared = [F.col(f"`{c}`") for c in df.columns if c not in out and c not in old and c not in system]
    df = df.select(*[v.alias(n) for n, v in out.items()], *undeclared, *system)
    if after.retention_days and before.retention_days and after.retention_days != before.retention_days:
        df = df.withColumn(EXPIRES, F.col(EXPIRES) + F.expr(f"INTERVAL {after.retention_days - before.retention_days} DAYS"))
    df = attached(after, df, now)
    refuse(missing_values(after, df), f"{after.name}: a required column has nulls")
    return df
