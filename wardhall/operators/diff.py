"""Differences of two specifications: flattened to fields, matched by path, as a full outer join."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PRIVILEGES, Kind, Project

# The fields that are compared, by type of object.
COMPARED = {
    "database": ("name", "audit_enabled", "audit_logged", "engine", "host", "port", "database", "version", "owner", "retention_schedule"),
    "schema": ("clearance", "audit_enabled"),
    "table": ("clearance", "audit_enabled", "erase_strategy", "rls_enabled", "rls_force", "rls_security_barrier", "retention_days"),
    "column": ("type", "clearance", "nullable", "unique", "immutable", "versioned", "sensitive", "is_subject_identifier", "masking_strategy", "default", "generated_expression", "generated_storage", "mask_config"),
    "index": ("columns", "index_type", "unique", "primary_key", "partial_filter"),
    "foreign_key": ("column", "referenced_schema", "referenced_table", "referenced_column"),
    "rls_policy": ("roles", "using_expr", "check_expr"),
    "role": ("clearance", "can_login", "can_admin", "can_write", "can_maintain", "can_access_sensitive", "member_of"),
    "permission": ("usage", "create"),
    "table_permission": PRIVILEGES,
}

_NOTES = {
    "versioned": "history columns are added or dropped", "type": "stored values are cast", "nullable": "stored values are checked for nulls",
    "masking_strategy": "readers see other values", "retention_days": "expiry of stored rows is set anew",
}


@dataclass(frozen=True)
class Change:
    kind: Kind
    object_type: str
    path: str
    field: str | None = None
    before: Any = None
    after: Any = None
    note: str | None = None


def objects(project: Project) -> dict[tuple[str, str], tuple[str | None, dict[str, Any]]]:
    """(type, path) of every object, with its parent's path and its compared fields."""
    out: dict[tuple[str, str], tuple[str | None, dict[str, Any]]] = {}

    def put(kind: str, path: str, parent: str | None, obj: Any) -> None:
        out[kind, path] = (parent, {n: getattr(obj, n) for n in COMPARED[kind]})

    put("database", project.database.name, None, project.database)
    out["database", "database"] = out.pop(("database", project.database.name))
    for s in project.schemas:
        put("schema", s.name, None, s)
        for t in s.tables:
            at = f"{s.name}.{t.name}"
            put("table", at, s.name, t)
            for c in t.columns:
                put("column", f"{at}.{c.name}", at, c)
                mask = c.mask_config
                out["column", f"{at}.{c.name}"][1]["mask_config"] = None if mask is None else str({"type": mask.strategy} | mask.parameters())
            for i in t.indexes:
                put("index", f"{at}.{i.name}", at, i)
            for f in t.foreign_keys:
                put("foreign_key", f"{at}.{f.name}", at, f)
            for n, p in enumerate(t.rls_policies):
                put("rls_policy", f"{at}[{n}]", at, p)
    for r in project.roles:
        put("role", r.name, None, r)
        for g in r.on:
            at = f"{r.name} on {g.name}"
            put("permission", at, r.name, g)
            for t in g.tables:
                put("table_permission", f"{at}.{t.name}", at, t)
    return out


def diff(before: Project, after: Project) -> list[Change]:
    """Changes in the order of the objects; what stands below an added or removed object is part of it."""
    a, b = objects(before), objects(after)
    out: list[Change] = []
    one_sided = {path for (_, path) in (a.keys() ^ b.keys())}
    for key in [*a, *(k for k in b if k not in a)]:
        kind, path = key
        parent = (a.get(key) or b[key])[0]
        if key in a and key in b:
            for name, old in a[key][1].items():
                if old != (new := b[key][1][name]):
                    out.append(Change(Kind.MODIFIED, kind, path, name, old, new, _NOTES.get(name)))
        elif parent is None or parent not in one_sided:
            out.append(Change(Kind.REMOVED if key in a else Kind.ADDED, kind, path))
    return out


FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("object_type", "path", "parent", "field", "value")])


def flattened(spark: SparkSession, project: Project) -> DataFrame:
    """One row for each compared field of each object."""
    rows = [(k, p, parent, n, None if v is None else str(v)) for (k, p), (parent, values) in objects(project).items() for n, v in values.items()]
    return spark.createDataFrame(rows, FIELDS)


def diff_frame(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same over flattened frames: (change_kind, object_type, path, field, before, after)."""
    keys = ["object_type", "path", "field"]
    a, b = before.select(*keys, F.col("parent").alias("pa"), F.col("value").alias("before"), F.lit(1).alias("ina")), after.select(*keys, F.col("parent").alias("pb"), F.col("value").alias("after"), F.lit(1).alias("inb"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("ina").isNull(), Kind.ADDED.value).when(F.col("inb").isNull(), Kind.REMOVED.value).when(~F.col("before").eqNullSafe(F.col("after")), Kind.MODIFIED.value)
    found = both.withColumn("change_kind", kind).filter("change_kind is not null").withColumn("parent", F.coalesce("pa", "pb"))
    whole = found.filter(F.col("change_kind") != Kind.MODIFIED.value)
    gone = whole.select(F.col("path").alias("parent"), F.lit(True).alias("inside")).distinct()
    tops = whole.join(gone, "parent", "left_anti").select("change_kind", "object_type", "path").distinct().select("*", *[F.lit(None).cast("string").alias(n) for n in ("field", "before", "after")])
    return found.filter(F.col("change_kind") == Kind.MODIFIED.value).select("change_kind", "object_type", "path", "field", "before", "after").unionByName(tops)


def _short(value: Any) -> str:
    text = "-" if value is None else str(value)
    return text if len(text) <= 60 else text[:57] + "..."


def render(changes: list[Change], title: str = "Changes") -> str:
    """A Markdown report: counts by kind, then a table for each type of object."""
    counts = Counter(c.kind.value for c in changes)
    lines = [f"# {title}", "", ", ".join(f"{counts.get(k.value, 0)} {k.value}" for k in Kind)]
    for kind in COMPARED:
        if some := [c for c in changes if c.object_type == kind]:
            lines += ["", f"## {kind.replace('_', ' ')}", "", "| change | path | field | before | after | note |", "|---|---|---|---|---|---|"]
            lines += ["| " + " | ".join([c.kind.value, c.path, c.field or "", *(_short(v).replace("|", "\\|") if c.field else "" for v in (c.before, c.after)), c.note or ""]) + " |" for c in some]
    return "\n".join(lines) + "\n"
