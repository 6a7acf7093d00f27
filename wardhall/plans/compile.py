"""Governed reads: declared columns in order, masks, row policies and history, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import masked
from ..functions.policies import barrier, related, row_filter
from ..model import FOREVER, VALID_FROM, VALID_TO, AccessDenied, GovernanceError, Project
from .access import Access, access


def live(df: DataFrame) -> DataFrame:
    """Current rows of a versioned table."""
    return df.filter(F.col(VALID_TO) == F.lit(FOREVER).cast(df.schema[VALID_TO].dataType))


def governed(project: Project, principal: str, path: str, raw: DataFrame, current: bool = False, key: str | None = None, columns: list[str] | None = None, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """What ``principal`` sees of a table.

    Row policies see raw values, callers only the masked ones.  Without ``columns`` those that the principal may not see
    are left out; naming one of them raises.  System columns never show.  ``current`` keeps a versioned table's live
    rows, else all versions are there.  Filters that a caller adds reach the scan unless they are on a masked value, or the
    table has a security barrier: then they see only rows that the policy lets through.  ``read`` gives the stored rows of
    other tables that a policy asks.
    """
    schema_name, _, table_name = path.partition(".")
    schema, table = project.schema(schema_name), project.table(path)
    found: Access = access(project, principal, schema, table)
    found.require("select", columns)
    shown = found.readable(table)
    if not shown:
        raise AccessDenied(f"{principal} sees no column of {table_name}")
    if columns is not None:
        shown = [c for c in shown if c.name in columns]
    with related(project, table, raw.sparkSession, read or _nowhere) as rename:
        rows = row_filter(table, principal, found.roles, found.bypass_rows, rename)
        df = raw if rows is None else raw.filter(rows)
    if current and table.versioned:
        df = live(df)
    elif table.versioned and VALID_TO in df.columns:  # a version of no length says that a row was gone
        df = df.filter(F.col(VALID_FROM) < F.col(VALID_TO))
    if rows is not None and table.rls_security_barrier:
        df = barrier(df)
    return df.select(*[masked(F.col(f"`{c.name}`"), c.masking_strategy, c.mask_config, key).alias(c.name) for c in shown])


def _nowhere(path: str) -> DataFrame:
    raise GovernanceError(f"a row policy asks {path}, which cannot be read here")


def with_generated(project: Project, path: str, df: DataFrame) -> DataFrame:
    """Stored generated columns, computed anew; virtual ones are not stored."""
    for c in project.table(path).columns:
        if c.generated_expression and not c.virtual:
            df = df.withColumn(c.name, F.expr(c.generated_expression).cast(spark_type(c.type)))
    return df


# The types that a specification's names stand for.
_TYPES = {
    "text": "string", "varchar": "string", "char": "string", "character varying": "string", "character": "string", "bpchar": "string", "str": "string", "uuid": "string", "json": "string", "jsonb": "string",
    "int2": "smallint", "smallint": "smallint", "int4": "int", "int": "int", "integer": "int", "serial": "int", "int8": "bigint", "bigint": "bigint", "bigserial": "bigint",
    "float4": "float", "real": "float", "float8": "double", "double precision": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "bytea": "binary",
    "date": "date", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
}


def spark_type(declared: str) -> str:
    """The Spark type of a declared one; lengths are dropped, decimals keep their precision, unknown ones are text."""
    text = declared.strip().lower()
    base, _, rest = text.partition("(")
    base = base.strip()
    if text.endswith("[]"):
        return f"array<{spark_type(text[:-2])}>"
    if base in ("numeric", "decimal"):
        return f"decimal({rest.rstrip(')') or '38,10'})"
    return _TYPES.get(base, "string")
