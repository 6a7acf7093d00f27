"""Queries over a database's catalog views, and the SQL that each must agree with on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import query
from .sources import information_schema as catalog

# A small database's catalog: name -> (columns with types, rows).  Both sides read these rows.
VIEWS: dict[str, tuple[str, list[tuple]]] = {
    "tables": ("table_schema string, table_name string, table_type string", [("sales", "customer", "BASE TABLE"), ("sales", "orders", "BASE TABLE"), ("sales", "big", "VIEW"), ("ops", "events", "BASE TABLE"), ("pg_toast", "t", "BASE TABLE"), ("pgx", "extra", "BASE TABLE")]),
    "columns": (
        "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, udt_name string, numeric_precision int, numeric_scale int, is_nullable string, column_default string",
        [
            ("sales", "customer", "id", 1, "bigint", "int8", 64, 0, "NO", "nextval('sales.customer_id_seq'::regclass)"), ("sales", "customer", "region", 2, "text", "text", None, None, "NO", None),
            ("sales", "customer", "email", 3, "character varying", "varchar", None, None, "YES", None), ("sales", "customer", "balance", 4, "numeric", "numeric", 12, 2, "YES", "0"), ("sales", "customer", "tags", 5, "ARRAY", "_text", None, None, "YES", "'{}'::text[]"),
            ("sales", "orders", "id", 1, "bigint", "int8", 64, 0, "NO", None), ("sales", "orders", "customer", 2, "bigint", "int8", 64, 0, "YES", None), ("sales", "orders", "region", 3, "text", "text", None, None, "YES", None), ("sales", "orders", "state", 4, "USER-DEFINED", "order_state", None, None, "YES", "'open'::sales.order_state"),
            ("sales", "big", "id", 1, "bigint", "int8", 64, 0, "YES", None), ("ops", "events", "at", 1, "timestamp with time zone", "timestamptz", None, None, "YES", "now()"), ("pg_toast", "t", "x", 1, "oid", "oid", None, None, "NO", None), ("pgx", "extra", "n", 1, "NUMERIC", "numeric", None, None, "YES", None),
        ],
    ),
    "table_constraints": ("constraint_name string, table_schema string, table_name string, constraint_type string", [("customer_pkey", "sales", "customer", "PRIMARY KEY"), ("customer_email", "sales", "customer", "UNIQUE"), ("customer_email_2", "sales", "customer", "UNIQUE"), ("orders_pkey", "sales", "orders", "PRIMARY KEY"), ("orders_customer", "sales", "orders", "FOREIGN KEY"), ("events_orders", "ops", "events", "FOREIGN KEY"), ("t_pkey", "pg_toast", "t", "PRIMARY KEY")]),
    "key_column_usage": (
        "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int",
        [
            ("sales", "customer_pkey", "sales", "customer", "region", 2, None), ("sales", "customer_pkey", "sales", "customer", "id", 1, None), ("sales", "customer_email", "sales", "customer", "email", 1, None), ("sales", "customer_email_2", "sales", "customer", "email", 1, None), ("sales", "orders_pkey", "sales", "orders", "id", 1, None),
            ("sales", "orders_customer", "sales", "orders", "customer", 1, 1), ("sales", "orders_customer", "sales", "orders", "region", 2, 2), ("ops", "events_orders", "ops", "events", "at", 1, 1), ("pg_toast", "t_pkey", "pg_toast", "t", "x", 1, None),
        ],
    ),
    "referential_constraints": ("constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string", [("sales", "orders_customer", "sales", "customer_pkey"), ("ops", "events_orders", "sales", "orders_pkey")]),
    "pg_indexes": (
        "schemaname string, tablename string, indexname string, indexdef string",
        [
            ("sales", "customer", "customer_pkey", "CREATE UNIQUE INDEX customer_pkey ON sales.customer USING btree (id, region)"), ("sales", "customer", "by_tags", 'CREATE INDEX by_tags ON sales.customer USING gin (tags, lower(email)) WHERE (balance > (0)::numeric)'),
            ("sales", "orders", "recent", "CREATE INDEX recent ON sales.orders USING btree (region DESC NULLS LAST, id) INCLUDE (state)"), ("ops", "events", "near", "CREATE INDEX near ON ops.events USING spgist (at)"), ("pg_toast", "t", "t_pkey", "CREATE UNIQUE INDEX t_pkey ON pg_toast.t USING btree (x)"),
        ],
    ),
    "pg_namespace": ("oid long, nspname string, nspowner long, nspacl array<string>", [(1, "sales", 10, ["owner=UC/owner", "analyst=U/owner"]), (2, "ops", 10, ["owner=UC/owner", "=U/owner", '"clerk"=UC*/owner']), (3, "pgx", 11, None), (4, "pg_toast", 10, None)]),
    "pg_class": ("relname string, relnamespace long, relkind string, relrowsecurity boolean, relforcerowsecurity boolean", [("customer", 1, "r", True, False), ("orders", 1, "r", False, False), ("events", 2, "r", True, True)]),
    "pg_policies": ("schemaname string, tablename string, policyname string, roles array<string>, qual string, with_check string", [("sales", "customer", "mine", ["public"], "(region = CURRENT_USER)", None), ("sales", "customer", "write", ['"clerk"'], None, "true"), ("sales", "orders", "off", ["clerk"], "true", None)]),
    "sequences": ("sequence_schema string, sequence_name string", [("sales", "customer_id_seq"), ("ops", "free"), ("pg_toast", "hidden")]),
    "routines": ("specific_schema string, specific_name string, routine_schema string, routine_name string, routine_type string, data_type string", [("sales", "f_1", "sales", "total", "FUNCTION", "numeric"), ("sales", "f_2", "sales", "total", "FUNCTION", "numeric"), ("sales", "f_3", "sales", "stamp", "FUNCTION", "trigger"), ("ops", "p_1", "ops", "clean", "PROCEDURE", None), ("ops", "a_1", "ops", "middle", None, "float8")]),
    "parameters": ("specific_schema string, specific_name string, ordinal_position int, parameter_mode string, data_type string", [("sales", "f_1", 2, "IN", "text"), ("sales", "f_1", 1, "IN", "bigint"), ("sales", "f_1", 3, "OUT", "numeric"), ("ops", "p_1", 1, "INOUT", "integer"), ("ops", "a_1", 1, "IN", "float8")]),
    "pg_enum": ("enumtypid long, enumsortorder float, enumlabel string", [(100, 2.0, "paid"), (100, 1.0, "open"), (100, 1.5, "held")]),
    "pg_type": ("oid long, typname string, typnamespace long", [(100, "order_state", 1), (23, "int4", 9), (25, "text", 9)]),
    "attributes": ("udt_schema string, udt_name string, attribute_name string, ordinal_position int, data_type string", [("ops", "point3", "y", 2, "int"), ("ops", "point3", "x", 1, "int"), ("ops", "point3", "z", 10, "text")]),
    "domains": ("domain_schema string, domain_name string, data_type string, domain_default string", [("sales", "percent", "integer", "0"), ("sales", "code", "text", None)]),
    "domain_constraints": ("constraint_schema string, constraint_name string, domain_schema string, domain_name string", [("sales", "c1", "sales", "percent"), ("sales", "c2", "sales", "percent"), ("sales", "c3", "sales", "percent")]),
    "check_constraints": ("constraint_schema string, constraint_name string, check_clause string", [("sales", "c1", "(VALUE >= 0)"), ("sales", "c2", "(VALUE <= 100)"), ("sales", "c3", "VALUE IS NOT NULL")]),
    "pg_operator": ("oprname string, oprnamespace long, oprleft long, oprright long", [("+++", 1, 23, 25), ("!!", 2, 0, 23)]),
    "views": ("table_schema string, table_name string", [("sales", "big"), ("information_schema", "tables")]),
    "foreign_tables": ("foreign_table_schema string, foreign_table_name string", [("ops", "remote")]),
    "collations": ("collation_schema string, collation_name string", [("sales", "german"), ("pg_catalog", "C")]),
    "pg_matviews": ("schemaname string, matviewname string", [("ops", "daily")]),
    "pg_ts_config": ("cfgname string, cfgnamespace long", [("simple", 4), ("ours", 1)]), "pg_ts_dict": ("dictname string, dictnamespace long", [("stems", 1)]), "pg_ts_parser": ("prsname string, prsnamespace long", [("lines", 2)]), "pg_ts_template": ("tmplname string, tmplnamespace long", [("plain", 2)]),
    "pg_roles": ("oid long, rolname string, rolsuper boolean, rolcreatedb boolean, rolcreaterole boolean, rolcanlogin boolean", [(10, "owner", False, True, False, False), (11, "root", True, True, True, True), (12, "analyst", False, False, False, True), (13, "clerk", False, False, False, True), (14, "intern", False, False, False, True), (15, "pg_monitor", False, False, False, False)]),
    "pg_auth_members": ("roleid long, member long", [(12, 14), (10, 12), (15, 14)]),
    "role_table_grants": ("grantee string, table_schema string, table_name string, privilege_type string", [("analyst", "sales", "customer", "SELECT"), ("analyst", "sales", "customer", "UPDATE"), ("clerk", "sales", "orders", "MAINTAIN"), ("clerk", "sales", "orders", "DANCE"), ("clerk", "pg_toast", "t", "SELECT")]),
    "role_column_grants": ("grantee string, table_schema string, table_name string, privilege_type string, column_name string", [("analyst", "sales", "customer", "SELECT", "email"), ("analyst", "sales", "orders", "SELECT", "id"), ("analyst", "sales", "orders", "SELECT", "region"), ("clerk", "sales", "orders", "UPDATE", "state")]),
}


def views(spark: SparkSession) -> catalog.Views:
    return lambda name: spark.createDataFrame(VIEWS[name][1], VIEWS[name][0])


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"


def _with(*names: str) -> str:
    """The same rows as common table expressions, named ``c_`` and the view's name."""
    kind = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "float": "FLOAT", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
    parts = []
    for n in names:
        columns = [c.split() for c in VIEWS[n][0].split(", ")]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in VIEWS[n][1])
        parts.append(f"c_{n} AS (SELECT " + ", ".join(f"{c}::{kind[t]} AS {c}" for c, t in columns) + f" FROM (VALUES {rows}) AS v({', '.join(c for c, _ in columns)}))")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_OURS = "NOT starts_with({0}, 'pg_') AND {0} <> 'information_schema'"


@query(
    "catalog_columns",
    _with("tables", "columns", "table_constraints", "key_column_usage")
    + f"""SELECT c.table_schema AS schema_name, c.table_name, c.column_name AS name, c.ordinal_position AS position,
  CASE WHEN c.data_type = 'ARRAY' THEN substr(c.udt_name, 2) || '[]' WHEN c.data_type = 'USER-DEFINED' THEN c.udt_name
    WHEN c.data_type = 'numeric' AND c.numeric_precision > 0 THEN 'numeric(' || c.numeric_precision || ',' || c.numeric_scale || ')' ELSE lower(c.data_type) END AS type,
  c.is_nullable = 'YES' AS nullable, c.column_default AS default,
  EXISTS (SELECT 1 FROM c_table_constraints k JOIN c_key_column_usage u ON u.constraint_name = k.constraint_name AND u.table_schema = k.table_schema AND u.table_name = k.table_name
    WHERE k.constraint_type = 'UNIQUE' AND u.table_schema = c.table_schema AND u.table_name = c.table_name AND u.column_name = c.column_name) AS is_unique
FROM c_columns c WHERE (c.table_schema, c.table_name) IN (SELECT (table_schema, table_name) FROM c_tables WHERE table_type = 'BASE TABLE') AND {_OURS.format("c.table_schema")}""",
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.columns(views(spark))


@query(
    "catalog_keys",
    _with("table_constraints", "key_column_usage")
    + f"""SELECT k.table_schema AS schema_name, k.table_name, k.constraint_name AS name, string_agg(u.column_name, ',' ORDER BY u.ordinal_position) AS key, k.constraint_type = 'PRIMARY KEY' AS primary_key
FROM c_table_constraints k JOIN c_key_column_usage u USING (constraint_name, table_schema, table_name) WHERE k.constraint_type <> 'FOREIGN KEY' AND {_OURS.format("k.table_schema")} GROUP BY ALL""",
)
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keys(views(spark)).selectExpr("schema_name", "table_name", "name", "array_join(columns, ',') AS key", "primary_key")


_INDEXES = [("sales", "customer", "customer_pkey", "id,region", "btree", True, True, None), ("sales", "customer", "by_tags", "tags", "gin", False, False, "(balance > (0)::numeric)"), ("sales", "orders", "recent", "region,id", "btree", False, False, None), ("ops", "events", "near", "at", "btree", False, False, None)]


@query("catalog_indexes", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _INDEXES) + ") AS t(schema_name, table_name, name, key, index_type, is_unique, primary_key, partial_filter)")
def catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.indexes(views(spark)).selectExpr("schema_name", "table_name", "name", "array_join(columns, ',') AS key", "index_type", "is_unique", "primary_key", "partial_filter")


@query(
    "catalog_foreign_keys",
    _with("key_column_usage", "referential_constraints")
    + f"""SELECT a.table_schema AS schema_name, a.table_name, r.constraint_name || CASE WHEN (SELECT count(*) FROM c_key_column_usage x WHERE x.constraint_name = r.constraint_name) > 1 THEN '_' || a.column_name ELSE '' END AS name,
  a.column_name AS column, b.table_schema AS referenced_schema, b.table_name AS referenced_table, b.column_name AS referenced_column
FROM c_referential_constraints r JOIN c_key_column_usage a ON a.constraint_name = r.constraint_name JOIN c_key_column_usage b ON b.constraint_name = r.unique_constraint_name AND b.ordinal_position = a.position_in_unique_constraint
WHERE {_OURS.format("a.table_schema")}""",
)
def catalog_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.foreign_keys(views(spark))


@query(
    "catalog_policies",
    _with("pg_policies", "pg_class", "pg_namespace")
    + """SELECT n.nspname AS schema_name, c.relname AS table_name, c.relforcerowsecurity AS force, p.policyname AS name, replace(replace(array_to_string(p.roles, ','), '"', ''), 'public', 'PUBLIC') AS roles, p.qual AS using_expr, p.with_check AS check_expr
FROM c_pg_class c JOIN c_pg_namespace n ON n.oid = c.relnamespace LEFT JOIN c_pg_policies p ON p.schemaname = n.nspname AND p.tablename = c.relname AND p.qual IS NOT NULL WHERE c.relrowsecurity""",
)
def catalog_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.policies(views(spark)).selectExpr("schema_name", "table_name", "force", "name", "array_join(roles, ',') AS roles", "using_expr", "check_expr")


@query(
    "catalog_sequences",
    _with("sequences", "columns")
    + f"""SELECT sequence_schema AS schema_name, 'sequences' AS kind, sequence_name || coalesce(' OWNED BY ' || c.table_name || '.' || c.column_name, '') AS name
FROM c_sequences s LEFT JOIN c_columns c ON c.table_schema = s.sequence_schema AND c.column_default = 'nextval(''' || s.sequence_schema || '.' || s.sequence_name || '''::regclass)' WHERE {_OURS.format("sequence_schema")}""",
)
def catalog_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sequences(views(spark))


@query(
    "catalog_routines",
    _with("routines", "parameters")
    + """SELECT r.routine_schema AS schema_name, CASE WHEN r.routine_type = 'PROCEDURE' THEN 'procedures' WHEN r.routine_type IS NULL THEN 'aggregates' WHEN r.data_type = 'trigger' THEN 'trigger_functions' ELSE 'functions' END AS kind,
  r.routine_name || '(' || coalesce((SELECT string_agg(p.data_type, ', ' ORDER BY p.ordinal_position) FROM c_parameters p WHERE p.specific_name = r.specific_name AND p.specific_schema = r.specific_schema AND p.parameter_mode <> 'OUT'), '') || ')' AS name
FROM c_routines r""",
)
def catalog_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.routines(views(spark))


@query(
    "catalog_types",
    _with("pg_enum", "pg_type", "pg_namespace", "attributes")
    + """SELECT n.nspname AS schema_name, 'types' AS kind, 'ENUM ' || t.typname || ' (' || string_agg(e.enumlabel, ', ' ORDER BY e.enumsortorder) || ')' AS name FROM c_pg_enum e JOIN c_pg_type t ON t.oid = e.enumtypid JOIN c_pg_namespace n ON n.oid = t.typnamespace GROUP BY n.nspname, t.typname
UNION ALL SELECT udt_schema, 'types', 'TYPE ' || udt_name || ' (' || string_agg(attribute_name || ' ' || data_type, ', ' ORDER BY ordinal_position) || ')' FROM c_attributes GROUP BY udt_schema, udt_name""",
)
def catalog_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.types(views(spark))


@query("catalog_domains", "SELECT * FROM (VALUES ('sales', 'domains', 'percent AS integer NOT NULL DEFAULT 0 CHECK (VALUE <= 100) CHECK (VALUE >= 0)'), ('sales', 'domains', 'code AS text')) AS t(schema_name, kind, name)")
def catalog_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.domains(views(spark))


@query(
    "catalog_operators",
    _with("pg_operator", "pg_type", "pg_namespace")
    + "SELECT n.nspname AS schema_name, 'operators' AS kind, o.oprname || '(' || coalesce(l.typname, 'NONE') || ',' || coalesce(r.typname, 'NONE') || ')' AS name FROM c_pg_operator o JOIN c_pg_namespace n ON n.oid = o.oprnamespace LEFT JOIN c_pg_type l ON l.oid = o.oprleft LEFT JOIN c_pg_type r ON r.oid = o.oprright",
)
def catalog_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.operators(views(spark))


_NAMES = [("views", "views", "table_schema", "table_name"), ("foreign_tables", "foreign_tables", "foreign_table_schema", "foreign_table_name"), ("collations", "collations", "collation_schema", "collation_name"), ("materialized_views", "pg_matviews", "schemaname", "matviewname")]
_TEXT_SEARCH = [("fts_configurations", "pg_ts_config", "cfg"), ("fts_dictionaries", "pg_ts_dict", "dict"), ("fts_parsers", "pg_ts_parser", "prs"), ("fts_templates", "pg_ts_template", "tmpl")]


@query(
    "catalog_names",
    _with("views", "foreign_tables", "collations", "pg_matviews", "pg_ts_config", "pg_ts_dict", "pg_ts_parser", "pg_ts_template", "pg_namespace")
    + "SELECT * FROM (" + " UNION ALL ".join([f"SELECT {s} AS schema_name, '{k}' AS kind, {n} AS name FROM c_{v}" for k, v, s, n in _NAMES] + [f"SELECT n.nspname, '{k}', v.{p}name FROM c_{v} v JOIN c_pg_namespace n ON n.oid = v.{p}namespace" for k, v, p in _TEXT_SEARCH]) + f") WHERE {_OURS.format('schema_name')}",
)
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.plain_names(views(spark))


@query(
    "catalog_roles",
    _with("pg_roles", "pg_auth_members")
    + """SELECT r.rolname AS name, r.rolcanlogin AS can_login, r.rolsuper AS can_admin, r.rolcreatedb OR r.rolcreaterole AS can_write,
  coalesce((SELECT string_agg(p.rolname, ',' ORDER BY p.rolname) FROM c_pg_auth_members m JOIN c_pg_roles p ON p.oid = m.roleid WHERE m.member = r.oid AND NOT starts_with(p.rolname, 'pg_')), '') AS parents
FROM c_pg_roles r WHERE NOT starts_with(r.rolname, 'pg_')""",
)
def catalog_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roles(views(spark)).selectExpr("name", "can_login", "can_admin", "can_write", "array_join(member_of, ',') AS parents")


@query(
    "catalog_schema_grants",
    _with("pg_roles", "pg_auth_members", "pg_namespace")
    + """, up(member, roleid) AS (SELECT oid, oid FROM c_pg_roles UNION SELECT up.member, m.roleid FROM up JOIN c_pg_auth_members m ON m.member = up.roleid),
acl AS (SELECT oid, unnest(nspacl) AS item FROM c_pg_namespace), wanted(privilege, letter) AS (VALUES ('usage', 'U'), ('create', 'C'))
SELECT r.rolname AS role_name, n.nspname AS schema_name, w.privilege FROM c_pg_roles r, c_pg_namespace n, wanted w
WHERE NOT starts_with(r.rolname, 'pg_') AND NOT starts_with(n.nspname, 'pg_') AND (r.rolsuper OR n.nspowner IN (SELECT roleid FROM up WHERE member = r.oid)
  OR EXISTS (SELECT 1 FROM acl WHERE acl.oid = n.oid AND contains(split_part(split_part(item, '=', 2), '/', 1), w.letter) AND (starts_with(item, '=') OR trim(split_part(item, '=', 1), '"') IN (SELECT p.rolname FROM up JOIN c_pg_roles p ON p.oid = up.roleid WHERE up.member = r.oid))))""",
)
def catalog_schema_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schema_grants(views(spark))


@query(
    "catalog_column_grants",
    _with("role_column_grants", "role_table_grants")
    + "SELECT grantee AS role_name, table_schema AS schema_name, table_name, lower(privilege_type) AS privilege, column_name FROM c_role_column_grants c WHERE NOT EXISTS (SELECT 1 FROM c_role_table_grants t WHERE t.grantee = c.grantee AND t.table_schema = c.table_schema AND t.table_name = c.table_name AND t.privilege_type = c.privilege_type)",
)
def catalog_column_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.column_grants(views(spark))
