"""The metadata tables: what was built, by which specification, and what an undo needs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Project
from .spec import checksum, dumps, object_checksum

PREFIX = "__wardhall__."
_S, _L, _I, _B, _A, _T = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.ArrayType(T.StringType()), T.TimestampType()


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("build_id", _L), *[T.StructField(n, t) for n, t in columns]])


SCHEMAS: dict[str, T.StructType] = {
    "builds": _struct(("kind", _S), ("built_at", _T), ("database_name", _S), ("checksum", _S), ("specification", _S), ("audit_before", _A)),
    "migrations": _struct(("change_kind", _S), ("object_type", _S), ("path", _S), ("field", _S), ("before", _S), ("after", _S)),
    "schemas": _struct(("name", _S), ("clearance", _I), ("description", _S), ("audit_enabled", _B), ("checksum", _S)),
    "tables": _struct(("schema_name", _S), ("name", _S), ("clearance", _I), ("description", _S), ("erase_strategy", _S), ("rls_enabled", _B), ("retention_days", _I), ("checksum", _S)),
    "columns": _struct(("schema_name", _S), ("table_name", _S), ("name", _S), ("position", _I), ("type", _S), ("clearance", _I), ("description", _S), ("nullable", _B), ("sensitive", _B), ("masking_strategy", _S), ("checksum", _S)),
    "indexes": _struct(("schema_name", _S), ("table_name", _S), ("name", _S), ("columns", _A), ("index_type", _S), ("is_unique", _B), ("primary_key", _B), ("partial_filter", _S)),
    "foreign_keys": _struct(("schema_name", _S), ("table_name", _S), ("name", _S), ("column", _S), ("referenced_schema", _S), ("referenced_table", _S), ("referenced_column", _S)),
    "added_foreign_keys": _struct(("schema_name", _S), ("table_name", _S), ("name", _S)),
    "added_generated_columns": _struct(("schema_name", _S), ("table_name", _S), ("name", _S)),
    "moved_objects": _struct(("schema_name", _S), ("kind", _S), ("name", _S)),
    "roles": _struct(("name", _S), ("clearance", _I), ("description", _S), ("can_login", _B), ("can_admin", _B), ("can_write", _B), ("can_maintain", _B), ("can_access_sensitive", _B), ("member_of", _A), ("added_here", _B)),
    "role_schemas": _struct(("role_name", _S), ("schema_name", _S), ("usage", _B), ("create", _B)),
    "role_tables": _struct(("role_name", _S), ("schema_name", _S), ("table_name", _S), *[(p, _B) for p in ("select", "insert", "update", "delete", "truncate", "references", "trigger", "maintain")]),
    "revoked_grants": _struct(("role_name", _S), ("schema_name", _S), ("table_name", _S), ("column_name", _S), ("privilege", _S)),
    "subject_identifiers": _struct(("schema_name", _S), ("table_name", _S), ("identifier_columns", _A), ("identifier_types", _A), ("erase_strategy", _S)),
    "erasures": _struct(("erased_at", _T), ("schema_name", _S), ("table_name", _S), ("column_names", _A), ("column_values", _A), ("erase_strategy", _S), ("rows_affected", _L), ("was_scheduled", _B)),
    "retention": _struct(("schema_name", _S), ("table_name", _S), ("retention_days", _I), ("erase_strategy", _S)),
}


def rows_of(project: Project, build_id: int, before: Project | None = None) -> dict[str, list[tuple]]:
    """The rows that a build adds to the declarative tables."""
    b, out = build_id, {n: [] for n in SCHEMAS}
    for s in project.schemas:
        out["schemas"].append((b, s.name, s.clearance, s.description, s.audit_enabled, object_checksum(s)))
        out["moved_objects"] += [(b, s.name, kind, n) for kind, names in s.names.items() for n in names]
        for t in s.tables:
            out["tables"].append((b, s.name, t.name, t.clearance, t.description, t.erase_strategy, t.rls_enabled, t.retention_days, object_checksum(t)))
            out["columns"] += [(b, s.name, t.name, c.name, i, c.type, c.clearance, c.description, c.nullable, c.sensitive, c.masking_strategy, object_checksum(c)) for i, c in enumerate(t.columns)]
            out["indexes"] += [(b, s.name, t.name, i.name, i.columns, i.index_type, i.unique, i.primary_key, i.partial_filter) for i in t.indexes]
            out["foreign_keys"] += [(b, s.name, t.name, f.name, f.column, f.referenced_schema, f.referenced_table, f.referenced_column) for f in t.foreign_keys]
            if t.identifiers:
                out["subject_identifiers"].append((b, s.name, t.name, t.identifiers, [t.column(c).type for c in t.identifiers], t.erase_strategy))
            if t.retention_days:
                out["retention"].append((b, s.name, t.name, t.retention_days, t.erase_strategy))
            old = next((x for y in (before.schemas if before else []) if y.name == s.name for x in y.tables if x.name == t.name), None)
            out["added_foreign_keys"] += [(b, s.name, t.name, f.name) for f in t.foreign_keys if old is None or f.name not in {x.name for x in old.foreign_keys}]
            out["added_generated_columns"] += [(b, s.name, t.name, c.name) for c in t.columns if c.generated_expression and not c.virtual and (old is None or c.name not in {x.name for x in old.columns})]
    known = {r.name for r in before.roles} if before else set()
    for r in project.roles:
        out["roles"].append((b, r.name, r.clearance, r.description, r.can_login, r.can_admin, r.can_write, r.can_maintain, r.can_access_sensitive, r.member_of, r.name not in known))
        for g in r.on:
            out["role_schemas"].append((b, r.name, g.name, g.usage, g.create))
            out["role_tables"] += [(b, r.name, g.name, t.name, t.select, t.insert, t.update, t.delete, t.truncate, t.references, t.trigger, t.maintain) for t in g.tables]
    for r in before.roles if before else []:
        for g in r.on:
            out["revoked_grants"] += [(b, r.name, g.name, None, None, p) for p, yes in (("usage", g.usage), ("create", g.create)) if yes]
            for t in g.tables:
                out["revoked_grants"] += [(b, r.name, g.name, t.name, None, p) for p in sorted(t.privileges)]
                out["revoked_grants"] += [(b, r.name, g.name, t.name, c, p) for p, cs in t.column_grants.items() for c in cs]
    return out


def build_row(project: Project, build_id: int, kind: str, now: dt.datetime, audit_before: list[str] | None = None) -> tuple:
    return (build_id, kind, now, project.database.name, checksum(project), dumps(project), audit_before or [])


def frame(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMAS[name])


def frames(spark: SparkSession, project: Project, build_id: int, before: Project | None = None) -> dict[str, DataFrame]:
    """The declarative tables of one build, under their store names; tables without rows are left out."""
    return {PREFIX + n: frame(spark, n, rows) for n, rows in rows_of(project, build_id, before).items() if rows}


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A metadata table of an older release, in today's shape: columns that it lacks are null."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
