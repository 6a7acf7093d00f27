"""A specification from a database's own catalog views, as frames: read through JDBC, or given.

Views are asked for by name: those that begin with ``pg_`` are PostgreSQL's, all others are the standard's.  Every part is
a frame of its own; only metadata is collected, when a project is put together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..model import INDEX_TYPES, PRIVILEGES, Column, Database, ForeignKey, Index, Project, Role, RowPolicy, Schema, SchemaGrant, Table, TableGrant
from .catalog import INTERNAL, effective_grants, own_column_grants

Views = Callable[[str], DataFrame]
TABLE_KEYS = ["schema_name", "table_name"]


def jdbc(spark: SparkSession, url: str, **options: str) -> Views:
    """Catalog views of a database that Spark reaches through JDBC."""

    def read(name: str) -> DataFrame:
        place = "pg_catalog" if name.startswith("pg_") else "information_schema"
        return spark.read.format("jdbc").options(url=url, dbtable=f"{place}.{name}", **options).load()

    return read


def _own(df: DataFrame, column: str = "schema_name") -> DataFrame:
    """Without the schemas of the database itself."""
    return df.filter(~F.col(column).isin(*INTERNAL)).filter(F.expr(f"{column} not like 'pg/_%' escape '/'"))


def _items(df: DataFrame, column: str) -> Col:
    """An array, which some drivers give as text in braces."""
    c = F.col(column)
    return c if isinstance(df.schema[column].dataType, T.ArrayType) else F.filter(F.split(F.regexp_replace(c, "[{}]", ""), ","), lambda x: x != "")


def _in_order(position: str, value: Col) -> Col:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), value.alias("it")))), lambda x: x["it"])


def _signature(items: Col) -> Col:
    return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))


def _names(df: DataFrame, kind: str, schema: str, name: str | Col) -> DataFrame:
    return _own(df.select(F.col(schema).alias("schema_name"), F.lit(kind).alias("kind"), (F.col(name) if isinstance(name, str) else name).alias("name")))


# --- tables ---------------------------------------------------------------------------------------------------


def key_columns(read: Views) -> DataFrame:
    """One row for each column of a primary or unique key, with its position."""
    on = ["constraint_name", "table_schema", "table_name"]
    keys = read("table_constraints").filter(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE")).select(*on, "constraint_type")
    found = keys.join(read("key_column_usage").select(*on, "column_name", "ordinal_position"), on)
    return _own(found.select(F.col("table_schema").alias("schema_name"), "table_name", F.col("constraint_name").alias("name"), (F.col("constraint_type") == "PRIMARY KEY").alias("primary_key"), "column_name", F.col("ordinal_position").alias("position")))


def columns(read: Views) -> DataFrame:
    """Columns of tables in order: type, whether null is allowed, default, whether some unique constraint has it."""
    tables = read("tables").filter("table_type = 'BASE TABLE'").select("table_schema", "table_name")
    data, udt = F.col("data_type"), F.col("udt_name")
    kind = (
        F.when(data == "ARRAY", F.concat(F.ltrim(udt, F.lit("_")), F.lit("[]"))).when(data == "USER-DEFINED", udt)
        .when(data.isin("numeric", "decimal") & F.col("numeric_precision").isNotNull(), F.format_string("numeric(%d,%d)", F.col("numeric_precision").cast("int"), F.coalesce("numeric_scale", F.lit(0)).cast("int"))).otherwise(F.lower(data))
    )
    unique = key_columns(read).filter("not primary_key").select(*TABLE_KEYS, F.col("column_name").alias("name"), F.lit(True).alias("is_unique")).distinct()
    listed = read("columns").join(tables, ["table_schema", "table_name"]).select(
        F.col("table_schema").alias("schema_name"), "table_name", F.col("column_name").alias("name"), F.col("ordinal_position").cast("int").alias("position"), kind.alias("type"),
        (F.col("is_nullable") == "YES").alias("nullable"), F.col("column_default").alias("default"),
    )
    return _own(listed).join(unique, [*TABLE_KEYS, "name"], "left").withColumn("is_unique", F.coalesce("is_unique", F.lit(False)))


def keys(read: Views) -> DataFrame:
    """Primary and unique keys with their columns in order, as indexes."""
    rows = key_columns(read).groupBy(*TABLE_KEYS, "name", "primary_key").agg(_in_order("position", F.col("column_name")).alias("columns"))
    return rows.select(*TABLE_KEYS, "name", "columns", F.lit("btree").alias("index_type"), F.lit(True).alias("is_unique"), "primary_key", F.lit(None).cast("string").alias("partial_filter"))


def indexes(read: Views) -> DataFrame:
    """Every index of PostgreSQL: columns in order (expressions are left out), method, predicate."""
    text = F.col("indexdef")
    inside = F.split(F.regexp_extract(text, r" USING \w+ \((.*?)\)(?: INCLUDE | WITH | WHERE | TABLESPACE |$)", 1), ",\\s*")
    plain = F.transform(inside, lambda x: F.regexp_replace(F.regexp_replace(x, " (ASC|DESC|NULLS) ?.*$", ""), '"', ""))
    primary = key_columns(read).filter("primary_key").select(*TABLE_KEYS, "name", F.lit(True).alias("primary_key")).distinct()
    method = F.regexp_extract(text, r" USING (\w+) ", 1)
    rows = _own(read("pg_indexes").select(
        F.col("schemaname").alias("schema_name"), F.col("tablename").alias("table_name"), F.col("indexname").alias("name"), F.filter(plain, lambda x: x.rlike(r"^\w+$")).alias("columns"),
        F.when(method.isin(*INDEX_TYPES), method).otherwise("btree").alias("index_type"), text.startswith("CREATE UNIQUE").alias("is_unique"), F.nullif(F.regexp_extract(text, " WHERE (.*)$", 1), F.lit("")).alias("partial_filter"),
    ))
    return rows.join(primary, [*TABLE_KEYS, "name"], "left").withColumn("primary_key", F.coalesce("primary_key", F.lit(False)))


def foreign_keys(read: Views) -> DataFrame:
    """One row for each column of a foreign key; of several columns, each has the column's name behind the key's."""
    usage = read("key_column_usage")
    mine = usage.select("constraint_schema", "constraint_name", F.col("table_schema").alias("schema_name"), "table_name", F.col("column_name").alias("column"), F.col("position_in_unique_constraint").alias("at"))
    other = usage.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("table_schema").alias("referenced_schema"), F.col("table_name").alias("referenced_table"), F.col("column_name").alias("referenced_column"), F.col("ordinal_position").alias("at"))
    links = read("referential_constraints").select("constraint_schema", "constraint_name", "unique_constraint_schema", "unique_constraint_name")
    found = links.join(mine, ["constraint_schema", "constraint_name"]).join(other, ["unique_constraint_schema", "unique_constraint_name", "at"])
    size = F.count("*").over(Window.partitionBy("schema_name", "table_name", "constraint_name"))
    name = F.when(size > 1, F.concat_ws("_", "constraint_name", "column")).otherwise(F.col("constraint_name"))
    return _own(found.select(*TABLE_KEYS, name.alias("name"), "column", "referenced_schema", "referenced_table", "referenced_column"))


def policies(read: Views) -> DataFrame:
    """Row policies with a condition, of tables whose row security is on; the role of everybody is PUBLIC."""
    on = read("pg_class").filter("relrowsecurity and relkind = 'r'").join(read("pg_namespace").select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace")
    on = on.select(F.col("nspname").alias("schema_name"), F.col("relname").alias("table_name"), F.col("relforcerowsecurity").alias("force"))
    p = read("pg_policies")
    roles = F.transform(_items(p, "roles"), lambda x: F.when(F.lower(F.regexp_replace(x, '"', "")) == "public", "PUBLIC").otherwise(F.regexp_replace(x, '"', "")))
    some = p.select(F.col("schemaname").alias("schema_name"), F.col("tablename").alias("table_name"), F.col("policyname").alias("name"), roles.alias("roles"), F.nullif("qual", F.lit("")).alias("using_expr"), F.nullif("with_check", F.lit("")).alias("check_expr"))
    return _own(on.join(some.filter("using_expr is not null"), TABLE_KEYS, "left"))


# --- names of other objects -----------------------------------------------------------------------------------


def sequences(read: Views) -> DataFrame:
    """Sequences, with the column whose default draws from each."""
    used = F.regexp_extract("column_default", r"^nextval\('(?:[^'.]+\.)?\"?([^'\"]+)\"?'", 1)
    owners = read("columns").filter("column_default is not null").select(F.col("table_schema").alias("sequence_schema"), used.alias("sequence_name"), F.concat(F.lit(" OWNED BY "), "table_name", F.lit("."), "column_name").alias("owner")).filter("sequence_name <> ''")
    found = read("sequences").join(owners, ["sequence_schema", "sequence_name"], "left")
    return _names(found, "sequences", "sequence_schema", F.concat("sequence_name", F.coalesce("owner", F.lit(""))))


def routines(read: Views) -> DataFrame:
    """Functions, trigger functions, procedures and aggregates as ``name(types)``."""
    inputs = read("parameters").filter(F.col("parameter_mode").isin("IN", "INOUT"))
    types = inputs.groupBy("specific_schema", "specific_name").agg(_in_order("ordinal_position", F.col("data_type")).alias("types"))
    found = read("routines").join(types, ["specific_schema", "specific_name"], "left")
    kind = F.when(F.col("routine_type") == "PROCEDURE", "procedures").when(F.col("routine_type").isNull(), "aggregates").when(F.col("data_type") == "trigger", "trigger_functions").otherwise("functions")
    rows = found.select("routine_schema", kind.alias("kind"), F.concat("routine_name", _signature(F.coalesce("types", F.array().cast("array<string>")))).alias("name"))
    return _own(rows.withColumnRenamed("routine_schema", "schema_name"))


def types(read: Views) -> DataFrame:
    """Enumerations with their labels and composite types with their attributes, both in order."""
    labels = read("pg_enum").groupBy("enumtypid").agg(_in_order("enumsortorder", F.col("enumlabel")).alias("items"))
    enums = labels.join(read("pg_type").select(F.col("oid").alias("enumtypid"), "typname", "typnamespace"), "enumtypid").join(read("pg_namespace").select(F.col("oid").alias("typnamespace"), "nspname"), "typnamespace")
    parts = read("attributes").groupBy("udt_schema", "udt_name").agg(_in_order("ordinal_position", F.concat_ws(" ", "attribute_name", "data_type")).alias("items"))
    return _names(enums, "types", "nspname", F.concat(F.lit("ENUM "), "typname", F.lit(" "), _signature(F.col("items")))).unionByName(_names(parts, "types", "udt_schema", F.concat(F.lit("TYPE "), "udt_name", F.lit(" "), _signature(F.col("items")))))


def domains(read: Views) -> DataFrame:
    """Domains: the base type, then required, default and checks where there are some."""
    held = read("domain_constraints").join(read("check_constraints").select("constraint_schema", "constraint_name", "check_clause"), ["constraint_schema", "constraint_name"])
    required = F.upper("check_clause") == "VALUE IS NOT NULL"
    text = F.regexp_replace("check_clause", r"^\((.*)\)$", "$1")
    checks = held.groupBy("domain_schema", "domain_name").agg(F.max(required).alias("required"), F.array_join(F.array_sort(F.collect_list(F.when(~required, F.concat(F.lit("CHECK ("), text, F.lit(")"))))), " ").alias("checks"))
    found = read("domains").join(checks, ["domain_schema", "domain_name"], "left")
    parts = [F.concat("domain_name", F.lit(" AS "), "data_type"), F.when(F.col("required"), "NOT NULL"), F.concat(F.lit("DEFAULT "), "domain_default"), F.nullif("checks", F.lit(""))]
    return _names(found, "domains", "domain_schema", F.concat_ws(" ", *parts))


def operators(read: Views) -> DataFrame:
    """Operators as ``name(left,right)``; a missing side is NONE."""
    side = lambda n: read("pg_type").select(F.col("oid").alias(f"opr{n}"), F.col("typname").alias(n))
    found = read("pg_operator").join(side("left"), "oprleft", "left").join(side("right"), "oprright", "left").join(read("pg_namespace").select(F.col("oid").alias("oprnamespace"), "nspname"), "oprnamespace")
    return _names(found, "operators", "nspname", F.format_string("%s(%s,%s)", F.col("oprname"), F.coalesce("left", F.lit("NONE")), F.coalesce("right", F.lit("NONE"))))


# Where plain names stand, as kind -> (view, schema, name).
_PLAIN = {
    "views": ("views", "table_schema", "table_name"), "foreign_tables": ("foreign_tables", "foreign_table_schema", "foreign_table_name"), "collations": ("collations", "collation_schema", "collation_name"),
    "materialized_views": ("pg_matviews", "schemaname", "matviewname"),
}
_SEARCH = {"fts_configurations": ("pg_ts_config", "cfg"), "fts_dictionaries": ("pg_ts_dict", "dict"), "fts_parsers": ("pg_ts_parser", "prs"), "fts_templates": ("pg_ts_template", "tmpl")}


def plain_names(read: Views) -> DataFrame:
    """Views, materialised views, foreign tables, collations and the objects of text search."""
    out = None
    for kind, (view, schema, name) in _PLAIN.items():
        rows = _names(read(view), kind, schema, name)
        out = rows if out is None else out.unionByName(rows)
    for kind, (view, short) in _SEARCH.items():
        found = read(view).join(read("pg_namespace").select(F.col("oid").alias(f"{short}namespace"), "nspname"), f"{short}namespace")
        out = out.unionByName(_names(found, kind, "nspname", f"{short}name"))
    return out


# --- roles ----------------------------------------------------------------------------------------------------


def _roles(read: Views) -> DataFrame:
    return read("pg_roles").filter(F.expr("rolname not like 'pg/_%' escape '/'"))


def roles(read: Views) -> DataFrame:
    """Roles with what they may do in general and the roles that they are direct members of."""
    parents = read("pg_auth_members").join(_roles(read).select(F.col("oid").alias("roleid"), F.col("rolname").alias("parent")), "roleid").groupBy(F.col("member").alias("oid")).agg(F.array_sort(F.collect_set("parent")).alias("member_of"))
    return _roles(read).join(parents, "oid", "left").select(
        F.col("rolname").alias("name"), F.col("rolcanlogin").alias("can_login"), F.col("rolsuper").alias("can_admin"), (F.col("rolcreatedb") | F.col("rolcreaterole")).alias("can_write"),
        F.coalesce("member_of", F.array().cast("array<string>")).alias("member_of"),
    )


def schema_grants(read: Views) -> DataFrame:
    """(role_name, schema_name, privilege) as it is in effect: by the schema's access list, by ownership, through membership, for everybody, or for one who may do all."""
    spark = _roles(read).sparkSession
    reach = spark.sql(
        "WITH RECURSIVE up(member, roleid) AS (SELECT oid, oid FROM {r} UNION ALL SELECT up.member, m.roleid FROM up JOIN {m} m ON m.member = up.roleid) SELECT DISTINCT r.rolname AS role_name, p.rolname AS through FROM up JOIN {r} r ON r.oid = up.member JOIN {r} p ON p.oid = up.roleid",
        r=_roles(read).select("oid", "rolname"), m=read("pg_auth_members").select("member", "roleid"),
    )
    spaces = _own(read("pg_namespace").withColumnRenamed("nspname", "schema_name"))
    quoted = spaces.select("schema_name", F.explode(_items(spaces, "nspacl")).alias("item"))
    listed = quoted.withColumn("item", F.regexp_replace("item", '["\\\\]', "")).select("schema_name", F.split_part("item", F.lit("="), F.lit(1)).alias("through"), F.split_part(F.split_part("item", F.lit("="), F.lit(2)), F.lit("/"), F.lit(1)).alias("letters"))
    given = listed.select("schema_name", "through", F.explode(F.array(F.when(F.col("letters").contains("U"), "usage"), F.when(F.col("letters").contains("C"), "create"))).alias("privilege")).filter("privilege is not null")
    owned = spaces.join(_roles(read).select(F.col("oid").alias("nspowner"), F.col("rolname").alias("through")), "nspowner").select("schema_name", "through", F.explode(F.array(F.lit("usage"), F.lit("create"))).alias("privilege"))
    matrix = effective_grants(_roles(read).select(F.col("rolname").alias("role_name"), "rolsuper"), spaces.select("schema_name"), ["usage", "create"])
    everybody = _roles(read).select(F.col("rolname").alias("role_name"), F.lit("").alias("through"))
    held = reach.unionByName(everybody).join(given.unionByName(owned), "through").select("role_name", "schema_name", "privilege", F.lit(True).alias("held")).distinct()
    return matrix.join(held, ["role_name", "schema_name", "privilege"], "left").filter("rolsuper or held").select("role_name", "schema_name", "privilege")


def table_grants(read: Views) -> DataFrame:
    rows = read("role_table_grants").select(F.col("grantee").alias("role_name"), F.col("table_schema").alias("schema_name"), "table_name", F.lower("privilege_type").alias("privilege")).distinct()
    return _own(rows.filter(F.col("privilege").isin(*PRIVILEGES)))


def column_grants(read: Views) -> DataFrame:
    """Grants on columns that no grant on their table implies."""
    rows = read("role_column_grants").select(F.col("grantee").alias("role_name"), F.col("table_schema").alias("schema_name"), "table_name", F.lower("privilege_type").alias("privilege"), "column_name").distinct()
    return own_column_grants(_own(rows), table_grants(read))


# --- a project ------------------------------------------------------------------------------------------------


def _by_table(df: DataFrame, *order: str) -> dict[tuple[str, str], list]:
    out = defaultdict(list)
    for r in df.orderBy(*[F.asc_nulls_first(c) for c in order]).collect():  # as large as the catalog, never as the data
        out[r["schema_name"], r["table_name"]].append(r)
    return out


def inspect_database(read: Views, database: str, owner: str | None = None, standard_only: bool = False) -> Project:
    """Tables with keys, references and policies, roles with grants, and the names of all else.

    With ``standard_only`` nothing is asked of PostgreSQL's own views: no indexes but keys, no policies, no roles.
    """
    schemas: dict[str, Schema] = {}
    cols, links = _by_table(columns(read), *TABLE_KEYS, "position"), _by_table(foreign_keys(read), *TABLE_KEYS, "name")
    found = _by_table(keys(read) if standard_only else indexes(read), *TABLE_KEYS, "name")
    rows = {} if standard_only else _by_table(policies(read), *TABLE_KEYS, "name")
    for (s, t), some in cols.items():
        at, secured = (s, t), rows.get((s, t), [])
        schemas.setdefault(s, Schema(s)).tables.append(Table(
            t, [Column(c["name"], c["type"], nullable=c["nullable"], default=c["default"], unique=c["is_unique"]) for c in some],
            indexes=[Index(i["name"], list(i["columns"]), i["index_type"], i["is_unique"], i["primary_key"], i["partial_filter"]) for i in found.get(at, [])],
            foreign_keys=[ForeignKey(f["name"], f["column"], f["referenced_schema"], f["referenced_table"], f["referenced_column"]) for f in links.get(at, [])],
            rls_enabled=bool(secured), rls_force=any(p["force"] for p in secured), rls_policies=[RowPolicy(list(p["roles"]), p["using_expr"], p["check_expr"]) for p in secured if p["using_expr"]],
        ))
    parts = [sequences, routines, domains] + ([] if standard_only else [types, operators, plain_names])
    for part in parts:
        for r in part(read).orderBy("schema_name", "kind", "name").collect():
            schemas.setdefault(r["schema_name"], Schema(r["schema_name"])).names.setdefault(r["kind"], []).append(r["name"])
    return Project(Database(database, owner=owner), list(schemas.values()), [] if standard_only else _with_grants(read))


def _with_grants(read: Views) -> list[Role]:
    known = {r["name"]: Role(r["name"], can_login=r["can_login"], can_admin=r["can_admin"], can_write=r["can_write"], member_of=list(r["member_of"])) for r in roles(read).orderBy("name").collect()}

    def schema(role: str, name: str) -> SchemaGrant:
        on = known[role].on
        if not any(g.name == name for g in on):
            on.append(SchemaGrant(name, usage=False))
        return next(g for g in on if g.name == name)

    def table(role: str, at: str, name: str) -> TableGrant:
        on = schema(role, at)
        if not any(t.name == name for t in on.tables):
            on.tables.append(TableGrant(name, select=False))
        return next(t for t in on.tables if t.name == name)

    for df, width in ((schema_grants(read), 2), (table_grants(read), 3), (column_grants(read), 5)):
        for r in df.orderBy(*df.columns).collect():
            if r["role_name"] not in known:
                continue
            if width == 2:
                setattr(schema(r["role_name"], r["schema_name"]), r["privilege"], True)
            elif width == 3:
                setattr(table(r["role_name"], r["schema_name"], r["table_name"]), r["privilege"], True)
            else:
                table(r["role_name"], r["schema_name"], r["table_name"]).column_grants.setdefault(r["privilege"], []).append(r["column_name"])
    for r in known.values():
        r.can_maintain = r.can_admin or any(t.maintain for g in r.on for t in g.tables)
    return list(known.values())
