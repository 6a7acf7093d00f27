"""Queries over single rules and over whole calls of the engine, and the SQL that each must agree with."""

from __future__ import annotations

import datetime as dt
import tempfile
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.masks import masked
from .functions.policies import row_check
from .model import EXPIRES, FOREVER, ON_EXPIRY, VALID_FROM, VALID_TO, AccessDenied, Column, Database, ForeignKey, GovernanceError, Index, Mask, Project, Role, RowPolicy, Schema, SchemaGrant, Table, TableGrant
from .operators import discover, dml, erase
from .operators.audit import LOG
from .operators.diff import diff_frame, flattened
from .operators.reshape import reshaped, steps
from .plans.access import access
from .plans.compile import governed
from .queries import _HIDE, _IP, NOW, _mask, _meta, _retained, _values, project, query, read
from .sources.catalog import declare, inspect_store
from .sources.work import new_folder
from .validate import problems

# --- masks and reads ------------------------------------------------------------------------------------------

_mask("mask_ip_three", Mask("ip_address", visible_octets=3), _IP, "'X.' || split_part(v, '.', 2) || '.' || split_part(v, '.', 3) || '.' || split_part(v, '.', 4)")
_mask("mask_hide_null_name", Mask("name", "*", hide_null=True), _HIDE, "coalesce(array_to_string(list_transform(regexp_split_to_array(v, '\\s+'), lambda w: left(w, 1) || '***'), ' '), '')")
_mask("mask_hide_null_phone", Mask("phone", "#", hide_null=True), _HIDE, "coalesce(repeat('#', greatest(0, length(regexp_replace(v, '[^0-9]', '', 'g')) - 4)::INT) || right(regexp_replace(v, '[^0-9]', '', 'g'), 4), '#')")


def _secured(force: bool = False, owner: str = "keeper", using: str = "c_nationkey = 3", **table: object) -> Project:
    """Customers under one row policy for everybody, with an owner and a reader."""
    t = project().table("sales.customer")
    t.rls_force, t.rls_policies = force, [RowPolicy(["PUBLIC"], using)]
    for name, value in table.items():
        setattr(t, name, value)
    on = lambda **kw: [SchemaGrant("sales", tables=[TableGrant("customer", **kw)])]
    return Project(Database("shop", owner=owner, version="16"), [Schema("sales", [t])], [Role("keeper", 2, can_login=True, on=on()), Role("guest", 0, can_login=True, on=on()), Role("Customer#000000007", 0, can_login=True, on=on())])


def _keys(spark: SparkSession, sf_dir: str, p: Project, principal: str) -> DataFrame:
    return governed(p, principal, "sales.customer", read(spark, sf_dir, "customer")).select("c_custkey")


@query("rls_owner", "SELECT c_custkey FROM customer")
def rls_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row policies pass the owner by."""
    return _keys(spark, sf_dir, _secured(), "keeper")


@query("rls_force", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def rls_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unless they are forced."""
    return _keys(spark, sf_dir, _secured(force=True), "keeper")


@query("rls_public", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def rls_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, _secured(), "guest")


@query("rls_caller", "SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007'")
def rls_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy that names the caller, over the stored name and not its mask."""
    return _keys(spark, sf_dir, _secured(using="c_name = current_principal()"), "Customer#000000007")


@query("rls_check_apart", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0)")
def rls_check_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a policy with a check of its own refuses to write."""
    t = _secured().table("sales.customer")
    t.rls_policies[0].check_expr = "c_acctbal > 0"
    return read(spark, sf_dir, "customer").filter(~row_check(t, "guest", {"guest"}, False)).select("c_custkey")


@query("virtual_column", "SELECT l_orderkey, l_linenumber FROM lineitem")
def virtual_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A virtual column is declared but not selected."""
    p = project()
    t = p.table("sales.lineitem")
    t.columns = [Column("l_orderkey", "int8"), Column("l_linenumber", "int4"), Column("net", "float8", generated_expression="l_quantity * 2", generated_storage="virtual")]
    p.role("analyst").on[0].tables.append(TableGrant("lineitem"))
    return governed(p, "analyst", "sales.lineitem", read(spark, sf_dir, "lineitem"))


@query("table_clearance", _values("role_name, table_name", *[(r, t) for r, tables in (("auditor", "customer orders"), ("boss", "customer orders supplier"), ("stranger", "customer orders"), ("analyst", "orders"), ("clerk", "orders"), ("reader", "orders")) for t in tables.split()]))
def table_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which role reads which table, where a role must be cleared for the table, and membership passes grants on."""
    p = project()
    p.table("sales.customer").clearance, p.table("sales.supplier").clearance = 2, 3
    rows = []
    for r in p.roles:
        for s, t in p.tables():
            if s.name == "sales" and "select" in access(p, r.name, s, t).privileges:
                rows.append((r.name, t.name))
    return spark.createDataFrame(rows, "role_name string, table_name string")


@query("discover_own_role", _values("name, clearance", ("analyst", 1)))
def discover_own_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.roles(_meta(spark), "analyst").select("name", "clearance")


@query("role_members", _values("role_name, members", ("analyst", "clerk"), ("reader", "analyst")))
def role_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.members(_meta(spark))


# --- erasure --------------------------------------------------------------------------------------------------

_TYPED = {"u": ("uuid", "string", "p_name"), "s": ("int2", "smallint", "p_size"), "b": ("int8", "bigint", "p_partkey * 1000003"), "d": ("numeric(12,2)", "decimal(12,2)", "p_retailprice"), "f": ("bool", "boolean", "p_size % 2 = 0"), "e": ("bytea", "binary", "p_brand")}
_SIGNED = "(n{0}::HUGEINT - CASE WHEN n{0} >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)"


@query(
    "erase_obfuscate_types",
    f"""WITH t AS (SELECT p_partkey, p_name AS u, p_size::SMALLINT AS s, p_partkey * 1000003 AS b, p_retailprice::DECIMAL(12,2) AS d, p_size % 2 = 0 AS f, p_brand AS e FROM part),
h AS (SELECT *, sha256(u) AS hu, sha256(s::VARCHAR) AS hs, ('0x' || left(sha256(b::VARCHAR), 16))::UBIGINT AS nb, ('0x' || left(sha256(d::VARCHAR), 16))::UBIGINT AS nd, sha256(f::VARCHAR) AS hf FROM t)
SELECT p_partkey, concat_ws('-', hu[1:8], hu[9:12], hu[13:16], hu[17:20], hu[21:32]) AS u, (('0x' || left(hs, 4))::BIGINT % 32768)::SMALLINT AS s, {_SIGNED.format("b")}::BIGINT AS b,
  ({_SIGNED.format("d")} % 10000000000)::DECIMAL(12,2) AS d, ('0x' || left(hf, 2))::BIGINT % 2 = 0 AS f, NULL AS e FROM h WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, u, s, b, d, f, e FROM t WHERE p_partkey % 7 <> 0""",
)
def erase_obfuscate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type that has an obfuscated form; one that has none becomes null."""
    t = Table("part", [Column("p_partkey", "int8", nullable=False, is_subject_identifier=True), *[Column(n, declared) for n, (declared, _, _) in _TYPED.items()]], erase_strategy="obfuscate")
    df = read(spark, sf_dir, "part").select("p_partkey", *[F.expr(f"cast({e} as {kind})").alias(n) for n, (_, kind, e) in _TYPED.items()])
    return erase.erased(t, df, F.col("p_partkey") % 7 == 0).withColumn("e", F.col("e").cast("string"))


@query("erase_required", "SELECT s_suppkey, CASE WHEN s_suppkey = 5 THEN '[ERASED]' ELSE s_name END AS s_name, CASE WHEN s_suppkey <> 5 THEN s_nationkey END AS s_nationkey FROM supplier")
def erase_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where null isn't allowed, nullifying leaves a marker."""
    t = Table("supplier", [Column("s_suppkey", "int8", is_subject_identifier=True), Column("s_name", nullable=False), Column("s_nationkey", "int4")], erase_strategy="nullify")
    return erase.erased(t, read(spark, sf_dir, "supplier").drop("s_acctbal"), F.col("s_suppkey") == 5)


@query("erase_identifiers_only", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <> 17")
def erase_identifiers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of keys and identifiers alone loses the rows, whatever its strategy."""
    t = Table("orders", [Column("o_orderkey", "int8"), Column("o_custkey", "int8", is_subject_identifier=True)], indexes=[Index("k", ["o_orderkey"], primary_key=True)], erase_strategy="nullify")
    return erase.erased(t, read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") == 17)


def _swept(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    t = project().table("ops.events")
    t.erase_strategy = strategy
    return erase.swept(t, _retained(spark, sf_dir), "2024-01-31 00:00:00").select("event_id", "ts", "user_id", "event_type", "props", ON_EXPIRY)


_OVER = "(ts + INTERVAL 14 DAY <= TIMESTAMP '2024-01-31')"


@query("retention_nullify", f"SELECT event_id, {', '.join(f'CASE WHEN NOT {_OVER} THEN {c} END AS {c}' for c in ('ts', 'user_id', 'event_type', 'props'))}, NOT {_OVER} AS \"{ON_EXPIRY}\" FROM events")
def retention_nullify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stay with their key; they aren't swept again."""
    return _swept(spark, sf_dir, "nullify")


@query(
    "retention_obfuscate",
    f"""WITH h AS (SELECT *, ('0x' || left(sha256(user_id::VARCHAR), 16))::UBIGINT AS nu FROM events)
SELECT event_id, CASE WHEN NOT {_OVER} THEN ts END AS ts, CASE WHEN {_OVER} THEN {_SIGNED.format("u")}::BIGINT ELSE user_id END AS user_id, CASE WHEN {_OVER} THEN sha256(event_type) ELSE event_type END AS event_type,
  CASE WHEN {_OVER} THEN sha256(props) ELSE props END AS props, NOT {_OVER} AS "{ON_EXPIRY}" FROM h""",
)
def retention_obfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir, "obfuscate")


# --- differences and migrations -------------------------------------------------------------------------------


def _diff(name: str, change: Callable[[Project], object], *rows: tuple) -> None:
    @query(name, _values("change_kind, object_type, path, field, before, after", *rows))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        after = project()
        change(after)
        return diff_frame(flattened(spark, project()), flattened(spark, after))


def _set(**values: object) -> Callable[[object], None]:
    return lambda obj: [setattr(obj, n, v) for n, v in values.items()] and None


_M, _G = "modified", None
_diff("diff_database", lambda p: _set(owner="boss", audit_enabled=True, version="17")(p.database), (_M, "database", "database", "audit_enabled", "False", "True"), (_M, "database", "database", "owner", "owner", "boss"), (_M, "database", "database", "version", "16", "17"))
_diff("diff_schema", lambda p: (_set(clearance=1, audit_enabled=False)(p.schema("sales")), p.schemas.append(Schema("new", [Table("t")])), p.schemas.remove(p.schema("ops"))), (_M, "schema", "sales", "clearance", "0", "1"), (_M, "schema", "sales", "audit_enabled", "True", "False"), ("added", "schema", "new", _G, _G, _G), ("removed", "schema", "ops", _G, _G, _G))
_diff("diff_policies", lambda p: (_set(using_expr="true", check_expr="false")(p.table("sales.customer").rls_policies[1]), p.table("sales.customer").rls_policies.append(RowPolicy(["boss"], "true"))), (_M, "rls_policy", "sales.customer[1]", "using_expr", "c_nationkey >= 20", "true"), (_M, "rls_policy", "sales.customer[1]", "check_expr", _G, "false"), ("added", "rls_policy", "sales.customer[3]", _G, _G, _G))
_diff("diff_column", lambda p: _set(type="int8", nullable=False, default="1", masking_strategy="full")(p.table("sales.customer").column("c_nationkey")), *[(_M, "column", "sales.customer.c_nationkey", f, a, b) for f, a, b in (("type", "int4", "int8"), ("nullable", "True", "False"), ("default", _G, "1"), ("masking_strategy", "none", "full"))])
_diff("diff_index", lambda p: (_set(columns=["o_orderkey", "o_custkey"], unique=False)(p.table("sales.orders").indexes[0]), p.table("sales.supplier").indexes.append(Index("by_name", ["s_name"]))), (_M, "index", "sales.orders.orders_pkey", "columns", "['o_orderkey']", "['o_orderkey', 'o_custkey']"), (_M, "index", "sales.orders.orders_pkey", "unique", "True", "False"), ("added", "index", "sales.supplier.by_name", _G, _G, _G))
_diff("diff_foreign_key", lambda p: (_set(referenced_table="supplier", referenced_column="s_suppkey")(p.table("sales.orders").foreign_keys[0])), (_M, "foreign_key", "sales.orders.orders_customer", "referenced_table", "customer", "supplier"), (_M, "foreign_key", "sales.orders.orders_customer", "referenced_column", "c_custkey", "s_suppkey"))
_diff("diff_role", lambda p: (_set(clearance=2, can_admin=True, member_of=[])(p.role("clerk")), p.roles.append(Role("new"))), (_M, "role", "clerk", "clearance", "0", "2"), (_M, "role", "clerk", "can_admin", "False", "True"), (_M, "role", "clerk", "member_of", "['analyst']", "[]"), ("added", "role", "new", _G, _G, _G))
_diff("diff_permission", lambda p: (_set(create=True)(p.role("reader").on[0]), _set(select=False, delete=True)(p.role("reader").on[0].tables[0]), p.role("auditor").on.pop()), (_M, "permission", "reader on sales", "create", "False", "True"), (_M, "table_permission", "reader on sales.orders", "select", "True", "False"), (_M, "table_permission", "reader on sales.orders", "delete", "False", "True"), ("removed", "permission", "auditor on ops", _G, _G, _G))


@query("migrate_steps", _values("step", *[(s,) for s in ("drop column s_acctbal", "add column rating int4", "cast column s_nationkey from int4 to int8", "require a value in s_name", "start history", "expire after 30 days", "check the new key s_suppkey, s_name")]))
def migrate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a migration does to a table, in words."""
    before, after = project().table("sales.supplier"), project().table("sales.supplier")
    after.columns = [c for c in after.columns if c.name != "s_acctbal"] + [Column("rating", "int4", versioned=True)]
    after.column("s_nationkey").type, after.column("s_name").nullable, after.retention_days = "int8", False, 30
    after.indexes[0].columns = ["s_suppkey", "s_name"]
    return spark.createDataFrame([(s,) for s in steps(before, after)], "step string")


def _reshaped(spark: SparkSession, sf_dir: str, path: str, change: Callable[[Table], object], df: DataFrame, before: Callable[[Table], object] = lambda t: None) -> DataFrame:
    old, new = project().table(path), project().table(path)
    before(old)
    before(new)
    change(new)
    return reshaped(old, new, df, NOW)


@query("migrate_undeclared", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal, upper(s_name) AS remark FROM supplier")
def migrate_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored columns that no declaration names survive."""
    df = read(spark, sf_dir, "supplier").withColumn("remark", F.upper("s_name"))
    return _reshaped(spark, sf_dir, "sales.supplier", lambda t: setattr(t.column("s_nationkey"), "type", "int8"), df)


@query("migrate_generated", "SELECT l_orderkey, l_extendedprice, l_discount, round(l_extendedprice * l_discount, 4) AS net FROM lineitem")
def migrate_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed expression is computed anew."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", F.lit(0.0).alias("net"))
    return _reshaped(spark, sf_dir, "sales.lineitem", lambda t: setattr(t.column("net"), "generated_expression", "l_extendedprice * l_discount"), df).withColumn("net", F.round("net", 4))


@query("migrate_history_start", f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal, TIMESTAMP '{NOW}' AS \"{VALID_FROM}\", TIMESTAMP '{FOREVER}' AS \"{VALID_TO}\" FROM supplier")
def migrate_history_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reshaped(spark, sf_dir, "sales.supplier", lambda t: setattr(t.column("s_name"), "versioned", True), read(spark, sf_dir, "supplier"))


@query("migrate_history_end", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 4 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def migrate_history_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only live rows are left."""
    from .queries import _versions

    return _reshaped(spark, sf_dir, "sales.customer", lambda t: setattr(t.column("c_mktsegment"), "versioned", False), _versions(spark, sf_dir))


@query("migrate_retention", f"SELECT event_id, ts + INTERVAL 30 DAY AS \"{EXPIRES}\" FROM events")
def migrate_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another period moves the expiry of stored rows."""
    return _reshaped(spark, sf_dir, "ops.events", lambda t: setattr(t, "retention_days", 30), _retained(spark, sf_dir)).select("event_id", EXPIRES)


# --- rules of a specification ---------------------------------------------------------------------------------

_BROKEN: list[tuple[str, Callable[[Project], object]]] = [
    ("schema sales is declared twice", lambda p: p.schemas.append(Schema("sales", [Table("x", [Column("a")], indexes=[Index("k", ["a"], primary_key=True)])]))),
    ("unknown engine abacus", lambda p: setattr(p.database, "engine", "abacus")),
    ("unknown audit level loud", lambda p: p.database.audit_logged.append("loud")),
    ("auditing is on but logs nothing", lambda p: _set(audit_enabled=True, audit_logged=[])(p.database)),
    ("sales.supplier: auditing needs auditing of the database", lambda p: setattr(p.table("sales.supplier"), "audit_enabled", True)),
    ("sales.supplier: an erase strategy needs a subject identifier", lambda p: setattr(p.table("sales.supplier"), "erase_strategy", "delete")),
    ("ops.events: a subject identifier needs an erase strategy", lambda p: _set(erase_strategy=None, retention_days=None)(p.table("ops.events"))),
    ("ops.events: retention of 0 days", lambda p: setattr(p.table("ops.events"), "retention_days", 0)),
    ("sales.orders: force without row security", lambda p: setattr(p.table("sales.orders"), "rls_force", True)),
    ("sales.customer: policy 0 names the unknown role nobody", lambda p: setattr(p.table("sales.customer").rls_policies[0], "roles", ["nobody"])),
    ("sales.customer: policy 1 is empty", lambda p: setattr(p.table("sales.customer").rls_policies[1], "using_expr", " ")),
    ("sales.supplier has no primary key", lambda p: setattr(p.table("sales.supplier"), "indexes", [])),
    ("sales.supplier: column s_name is declared twice", lambda p: p.table("sales.supplier").columns.append(Column("s_name"))),
    ("sales.supplier.__valid_to__ is a reserved name", lambda p: p.table("sales.supplier").columns.append(Column("__valid_to__"))),
    ("sales.supplier: index supplier_pkey has the unknown column x", lambda p: p.table("sales.supplier").indexes[0].columns.append("x")),
    ("sales.supplier: f refers to the unknown table x", lambda p: p.table("sales.supplier").foreign_keys.append(ForeignKey("f", "s_nationkey", "sales", "x", "y"))),
    ("sales.supplier.s_acctbal is generated and has a default", lambda p: setattr(p.table("sales.supplier").column("s_acctbal"), "generated_expression", "1")),
    ("sales.supplier.s_suppkey is versioned and immutable", lambda p: setattr(p.table("sales.supplier").column("s_suppkey"), "versioned", True)),
    ("sales.supplier.s_name: the full mask lacks its configuration", lambda p: setattr(p.table("sales.supplier").column("s_name"), "masking_strategy", "full")),
    ("sales.supplier.s_name: an address shows 1, 2 or 3 octets", lambda p: _set(masking_strategy="ip_address", mask_config=Mask("ip_address", visible_octets=4))(p.table("sales.supplier").column("s_name"))),
    ("no role reaches clearance 9", lambda p: setattr(p.table("sales.customer").column("c_acctbal"), "clearance", 9)),
    ("sales.supplier.s_suppkey: clearance 0 below its table's 1", lambda p: setattr(p.table("sales.supplier"), "clearance", 1)),
    ("role reader has neither a schema nor a parent", lambda p: setattr(p.role("reader"), "on", [])),
    ("role clerk: unknown parent ghost", lambda p: p.role("clerk").member_of.append("ghost")),
    ("no role can log in", lambda p: [setattr(r, "can_login", False) for r in p.roles]),
]


@query("validation_rules", _values("problem", *[(m,) for m, _ in _BROKEN]))
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule is broken in a specification of its own, and must be reported there; the sound one breaks none."""
    rows = [(m,) for m in problems(_linked(project()))[0]]
    for wanted, damage in _BROKEN:
        p = _linked(project())
        damage(p)
        rows += [(m,) for m in problems(p)[0] if m == wanted]
    return spark.createDataFrame(rows, "problem string")


def _linked(p: Project) -> Project:
    """Without what the examples break on purpose: a reference to a versioned table, and a table without a key."""
    p.table("sales.orders").foreign_keys = []
    p.table("sales.lineitem").indexes = [Index("lineitem_pkey", ["l_orderkey"], primary_key=True)]
    return p


# --- the engine as a whole ------------------------------------------------------------------------------------


def _shop() -> Project:
    """Suppliers with a secret balance, orders with a reference, and what a clerk, a keeper and a boss may do."""
    supplier = Table(
        "supplier", [Column("s_suppkey", "int8", nullable=False, is_subject_identifier=True), Column("s_name", masking_strategy="full", mask_config=Mask("full")), Column("s_nationkey", "int4", default="0"), Column("s_acctbal", "float8", clearance=2, sensitive=True), Column("size", "int4", generated_expression="length(s_name)")],
        indexes=[Index("supplier_pkey", ["s_suppkey"], primary_key=True)], erase_strategy="nullify", audit_enabled=True,
    )
    every = {"insert": True, "update": True, "delete": True}
    roles = [Role("clerk", 0, can_login=True, on=[SchemaGrant("sales", tables=[TableGrant("supplier", **every)])]), Role("boss", 2, can_login=True, can_admin=True, can_access_sensitive=True, on=[SchemaGrant("sales", create=True, tables=[TableGrant("supplier", truncate=True, **every)])])]
    return Project(Database("shop", owner="boss", audit_enabled=True, audit_logged=["read", "write"], version="16"), [Schema("sales", [supplier])], roles)


def _engine(spark: SparkSession, sf_dir: str, p: Project, tables: dict[str, DataFrame] | None = None, known: Project | None = None) -> tuple[Engine, str]:
    """A store of its own with a build attached, in the folder that the cluster shares."""
    engine = Engine(spark, new_folder(spark, "scenario"), clock=lambda: dt.datetime(2024, 2, 1), principal="boss")
    engine.store.commit(tables or {"sales.supplier": read(spark, sf_dir, "supplier")})
    if known:
        declare(engine.store, known)
    out = tempfile.mkdtemp()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        engine.attach(engine.build(p, out, "shop"))
    return engine, out


def _tried(call: Callable[[], object]) -> None:
    try:
        call()
    except GovernanceError:
        return
    raise AssertionError("this should have been refused")


@query("update_denied_column", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def update_denied_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after a clerk has tried to copy, and to probe, a column that it may not see: all as before."""
    engine, _ = _engine(spark, sf_dir, _shop())
    _tried(lambda: engine.update("clerk", "sales.supplier", "true", {"s_nationkey": "cast(s_acctbal as int)"}))
    _tried(lambda: engine.update("clerk", "sales.supplier", "s_acctbal > 0", {"s_nationkey": "1"}))
    _tried(lambda: engine.delete("clerk", "sales.supplier", "s_acctbal < 0"))
    engine.delete("clerk", "sales.supplier", "s_name = 'Supplier#000000001'")  # its mask is compared, and matches nothing
    return engine.raw("boss", "sales.supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("audit_sql", _values("principal, action, level, table_name", ("boss", "attach", "ddl", "sales.supplier"), ("boss", "select", "read", "sales.supplier"), ("clerk", "select", "read", "sales.supplier"), ("clerk", "update", "write", "sales.supplier"), ("boss", "erase", "write", "sales.supplier")))
def audit_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log after reads by SQL and by table, a write and an erasure."""
    p = _shop()
    p.database.audit_logged = ["read", "write", "ddl"]
    engine, _ = _engine(spark, sf_dir, p)
    engine.sql("clerk", "SELECT count(*) AS n FROM sales_supplier").collect()
    engine.table("boss", "sales.supplier").count()
    engine.table("clerk", "sales.supplier")  # never read, so not logged
    engine.update("clerk", "sales.supplier", "s_suppkey = 1", {"s_nationkey": "1"})
    engine.erase_apply(["s_suppkey"], ["2"])
    return engine.store.read(LOG).select("principal", "action", "level", "table_name")


@query("detach_generated", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey = 3 THEN 9 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier")
def detach_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detaching takes the generated column away again and keeps the rows as they are by then."""
    engine, _ = _engine(spark, sf_dir, _shop())
    engine.update("boss", "sales.supplier", "s_suppkey = 3", {"s_nationkey": "9"})
    engine.detach(confirmed=True)
    return engine.store.read("sales.supplier")


@query("detach_grants", _values("role_name, schema_name, table_name, privilege", ("reader", "sales", "supplier", "select"), ("reader", "sales", "supplier", "delete"), ("PUBLIC", "sales", "supplier", "select")))
def detach_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that were declared before the build are back after detaching; the build's own are gone."""
    known = Project(Database("shop", owner="reader"), [Schema("sales", [Table("supplier", [Column("s_suppkey", "int8", nullable=False)], indexes=[Index("supplier_pkey", ["s_suppkey"], unique=True, primary_key=True)])])], [Role("reader", can_login=True, on=[SchemaGrant("sales", tables=[TableGrant("supplier", delete=True)])]), Role("PUBLIC", on=[SchemaGrant("sales", tables=[TableGrant("supplier")])])])
    engine, _ = _engine(spark, sf_dir, _shop(), known=known)
    engine.detach(confirmed=True)
    rows = [(r.name, g.name, t.name, p) for r in inspect_store(engine.store).roles for g in r.on for t in g.tables for p in sorted(t.privileges)]
    return spark.createDataFrame(rows, "role_name string, schema_name string, table_name string, privilege string")


@query("inspect_declared", _values("name, type, nullable, default_value, unique_value, key", ("s_suppkey", "int8", "false", None, "false", "true"), ("s_name", "text", "true", None, "true", "false"), ("s_nationkey", "int4", "true", "0", "false", "false"), ("s_acctbal", "float8", "true", None, "false", "false")))
def inspect_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's tables with the keys, defaults and uniqueness that are declared for it."""
    p = _shop()
    p.table("sales.supplier").column("s_name").unique = True
    engine, _ = _engine(spark, sf_dir, p)
    engine.detach(confirmed=True)
    t = inspect_store(engine.store).table("sales.supplier")
    return spark.createDataFrame([(c.name, c.type, str(c.nullable).lower(), c.default, str(c.unique).lower(), str(c.name in t.key).lower()) for c in t.columns], "name string, type string, nullable string, default_value string, unique_value string, key string")


@query("truncate_table", "SELECT 0::BIGINT AS n, 1::BIGINT AS logged")
def truncate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only who holds the privilege may truncate."""
    engine, _ = _engine(spark, sf_dir, _shop())
    try:
        engine.truncate("clerk", "sales.supplier")
        raise AssertionError("this should have been refused")
    except AccessDenied:
        engine.truncate("boss", "sales.supplier")
    rows = engine.raw("boss", "sales.supplier").agg(F.count("*").alias("n"))
    return rows.crossJoin(engine.store.read(LOG).filter("action = 'truncate'").agg(F.count("*").alias("logged")))  # one row each


@query("migrate_fk_check", "SELECT count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS refused_for, 1::BIGINT AS build FROM orders")
def migrate_fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new reference is refused where stored rows break it, and the build stays the one that it was."""
    customer, orders = (Table(n, [Column(k, "int8", nullable=False), *more], indexes=[Index(f"{n}_pkey", [k], primary_key=True)]) for n, k, more in (("customer", "c_custkey", [Column("c_nationkey", "int4")]), ("orders", "o_orderkey", [Column("o_custkey", "int8")])))
    p = Project(Database("shop", owner="boss", version="16"), [Schema("sales", [customer, orders])], [Role("boss", can_login=True, can_admin=True, on=[SchemaGrant("sales", tables=[TableGrant("customer"), TableGrant("orders")])])])
    some = read(spark, sf_dir, "customer").filter("c_nationkey < 20").select("c_custkey", "c_nationkey")
    engine, out = _engine(spark, sf_dir, p, {"sales.customer": some, "sales.orders": read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")})
    fk = ForeignKey("orders_customer", "o_custkey", "sales", "customer", "c_custkey")
    p.table("sales.orders").foreign_keys = [fk]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        path = engine.migrate(p, out, "shop")
    _tried(lambda: engine.attach(path))
    bad = dml.orphans(fk, engine.raw("boss", "sales.orders"), engine.raw("boss", "sales.customer"))
    return bad.agg(F.count("*").alias("refused_for")).withColumn("build", F.lit(engine.build_id).cast("long"))


@query("erase_log", "SELECT 'supplier' AS table_name, 'nullify' AS erase_strategy, count(*) AS rows_affected, 's_suppkey=7' AS subject, false AS was_scheduled FROM supplier WHERE s_suppkey = 7")
def erase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An erasure by the engine, as its log has it."""
    engine, _ = _engine(spark, sf_dir, _shop())
    engine.erase_apply(["s_suppkey"], ["7"])
    return engine.meta()["erasures"].select("table_name", "erase_strategy", "rows_affected", F.concat_ws("=", F.array_join("column_names", ","), F.array_join("column_values", ",")).alias("subject"), "was_scheduled")
