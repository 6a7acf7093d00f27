"""A specification from what is there: a store's tables, or a Spark catalog."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SYSTEM_COLUMNS, Column, Database, Index, Project, Role, Schema, SchemaGrant, Table, TableGrant
from . import spec
from .store import Store

SHADOW = "__shadow__."
INTERNAL = ("information_schema", "__wardhall__", "__shadow__", "global_temp", "sys")


def declared_type(kind: T.DataType) -> str:
    """The declared name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return declared_type(kind.elementType) + "[]"
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    # Names of types on either side.
    names = {"string": "text", "smallint": "int2", "int": "int4", "bigint": "int8", "float": "float4", "double": "float8", "boolean": "bool", "binary": "bytea", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "date": "date"}
    return names.get(kind.simpleString(), kind.simpleString())


def _table(name: str, schema: T.StructType) -> Table:
    out = Table(name, [Column(f.name, declared_type(f.dataType), nullable=f.nullable) for f in schema if f.name not in SYSTEM_COLUMNS])
    if out.columns:
        out.indexes = [Index(f"{name}_pkey", [out.columns[0].name], unique=True, primary_key=True)]
    return out


def _project(database: str, found: list[tuple[str, str, T.StructType]], owner: str | None) -> Project:
    schemas: dict[str, Schema] = {}
    for schema, name, struct in sorted(found, key=lambda f: f[:2]):
        if schema not in INTERNAL:
            schemas.setdefault(schema, Schema(schema)).tables.append(_table(name, struct))
    role = Role("owner", can_login=True, can_admin=True, on=[SchemaGrant(s.name, create=True, tables=[TableGrant(t.name) for t in s.tables]) for s in schemas.values()])
    return Project(Database(database, owner=owner or role.name), list(schemas.values()), [role])


def inspect_store(store: Store, database: str = "store", owner: str | None = None, shadow: bool = False) -> Project:
    """Public tables of a store; with ``shadow`` the governed ones instead.

    Defaults, keys, references, policies, names, roles and grants are those that were declared for the store, or that
    govern it; the first column stands in for an unknown key, and one owner for unknown roles.
    """
    found = []
    for name, entry in store.manifest()["tables"].items():
        hidden = name.startswith(SHADOW)
        public = name.removeprefix(SHADOW)
        if hidden == shadow and not public.startswith("__") and "." in public:
            schema, _, table = public.partition(".")
            found.append((schema, table, T.StructType.fromJson(entry["schema"])))
    out = _project(database, found, owner)
    text = store.state().get("specification" if shadow else "declared")
    return _as_declared(out, spec.loads(text), owner) if text else out


def declare(store: Store, project: Project) -> None:
    """Keeps what a database would know of a store's plain tables beside their rows: keys, references, defaults, policies, roles, grants."""
    store.commit(state={"declared": spec.dumps(project)})


def plain_table(table: Table, columns: list[str] | None = None) -> Table:
    """What a database itself knows of a table: no clearances, masks, policies, history, erasure or retention."""
    shown = [c for c in table.columns if not c.virtual and (columns is None or c.name in columns)]
    names = {c.name for c in shown}
    return Table(
        table.name, [Column(c.name, c.type, nullable=c.nullable, default=c.default, unique=c.unique) for c in shown],
        indexes=[i for i in table.indexes if set(i.columns) <= names], foreign_keys=[f for f in table.foreign_keys if f.column in names],
    )


def _as_declared(found: Project, known: Project, owner: str | None) -> Project:
    """The tables that are there, with what is declared of their columns."""
    declared = {(s.name, t.name): t for s, t in known.tables()}
    for s in found.schemas:
        s.names = next((k.names for k in known.schemas if k.name == s.name), {})
        for i, t in enumerate(s.tables):
            if old := declared.get((s.name, t.name)):
                have, about = {c.name for c in t.columns}, {c.name: c for c in old.columns}
                old.columns = [about.get(c.name, c) for c in t.columns]
                old.indexes = [x for x in old.indexes if set(x.columns) <= have]
                s.tables[i] = old
    there = {(s.name, t.name): {c.name for c in t.columns} for s, t in found.tables()}
    for _, t in found.tables():
        t.foreign_keys = [f for f in t.foreign_keys if f.column in {c.name for c in t.columns} and f.referenced_column in there.get((f.referenced_schema, f.referenced_table), ())]
    if known.roles:
        found.roles, found.database.owner = known.roles, owner or known.database.owner
    return found


def inspect_catalog(spark: SparkSession, database: str = "catalog", owner: str | None = None) -> Project:
    """Databases, tables, views and functions that Spark's catalog knows."""
    found, views = [], {}
    for db in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(db.name):
            if t.tableType == "VIEW":
                views.setdefault(db.name, []).append(t.name)
            elif not t.isTemporary:
                found.append((db.name, t.name, spark.table(f"`{db.name}`.`{t.name}`").schema))
    out = _project(database, found, owner)
    for s in out.schemas:
        if views.get(s.name):
            s.names["views"] = sorted(views[s.name])
        own = sorted(f.name for f in spark.catalog.listFunctions(s.name) if f.namespace and s.name in f.namespace)
        if own:
            s.names["functions"] = own
    return out


def fingerprint(store: Store) -> str:
    """Hash of the public tables' names, columns and folders."""
    tables = store.manifest()["tables"]
    text = "\n".join(f"{n} {tables[n]}" for n in sorted(tables) if not n.startswith("__"))
    return hashlib.sha256(text.encode()).hexdigest()


def effective_grants(roles: DataFrame, schemas: DataFrame, privileges: list[str]) -> DataFrame:
    """Every role with every schema and privilege: the matrix that declared grants are matched against."""
    spark = roles.sparkSession
    kinds = spark.createDataFrame([(p,) for p in privileges], "privilege string")
    # All three are as large as the specification, never as the data.
    return roles.crossJoin(schemas).crossJoin(kinds)


def own_column_grants(column_grants: DataFrame, table_grants: DataFrame) -> DataFrame:
    """Column grants that no grant on the whole table implies."""
    return column_grants.join(table_grants, ["role_name", "schema_name", "table_name", "privilege"], "left_anti")


def ordered_columns(indexes: DataFrame) -> DataFrame:
    """One row for each column of an index, with its position."""
    return indexes.select("schema_name", "table_name", "name", F.posexplode("columns").alias("position", "column"))
