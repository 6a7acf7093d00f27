"""Queries over the star schema, one for each operator, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.masks import masked
from .model import EXPIRES, FOREVER, ON_EXPIRY, VALID_FROM, VALID_TO, Column, Database, ForeignKey, Index, Mask, Project, Role, RowPolicy, Schema, SchemaGrant, Table, TableGrant
from .operators import discover, dml, erase
from .operators.audit import merged_levels
from .operators.diff import diff_frame, flattened
from .operators.reshape import attached, detached, reshaped
from .plans.access import grants
from .plans.compile import governed, live, with_generated
from .sources import meta
from .sources.catalog import effective_grants, ordered_columns, own_column_grants
from .sources.work import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW, KEY = "2024-02-01 00:00:00", "test-key"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(**changes: object) -> Project:
    """The specification of the examples: sales with clearances, masks, row policies and erasure; operations with retention."""
    customer = Table(
        "customer",
        [
            Column("c_custkey", "int8", nullable=False, is_subject_identifier=True), Column("c_name", masking_strategy="name", mask_config=Mask("name", "*")), Column("c_nationkey", "int4"),
            Column("c_acctbal", "float8", clearance=2, sensitive=True), Column("c_mktsegment", versioned=True),
        ],
        indexes=[Index("customer_pkey", ["c_custkey"], unique=True, primary_key=True)], erase_strategy="obfuscate", rls_enabled=True,
        rls_policies=[RowPolicy(["analyst"], "c_nationkey < 10"), RowPolicy(["auditor"], "c_nationkey >= 20"), RowPolicy(["auditor"], "c_mktsegment = 'BUILDING'")],
    )
    orders = Table(
        "orders",
        [Column("o_orderkey", "int8", nullable=False), Column("o_custkey", "int8", is_subject_identifier=True), Column("o_orderstatus", default="'O'"), Column("o_totalprice", "float8", clearance=1), Column("o_orderdate", "timestamp"), Column("o_orderpriority")],
        indexes=[Index("orders_pkey", ["o_orderkey"], unique=True, primary_key=True)], foreign_keys=[ForeignKey("orders_customer", "o_custkey", "sales", "customer", "c_custkey")], erase_strategy="nullify",
    )
    supplier = Table("supplier", [Column("s_suppkey", "int8", nullable=False, immutable=True), Column("s_name"), Column("s_nationkey", "int4", default="0"), Column("s_acctbal", "float8", default="0.0")], indexes=[Index("supplier_pkey", ["s_suppkey"], primary_key=True)])
    lineitem = Table("lineitem", [Column("l_orderkey", "int8"), Column("l_extendedprice", "float8"), Column("l_discount", "float8"), Column("net", "float8", generated_expression="l_extendedprice * (1 - l_discount)")])
    events = Table("events", [Column("event_id", "int8", nullable=False), Column("ts", "timestamp"), Column("user_id", "int8", is_subject_identifier=True), Column("event_type"), Column("value", "float8"), Column("props")], indexes=[Index("events_pkey", ["event_id"], primary_key=True)], erase_strategy="delete", retention_days=14)
    on = lambda **kw: [SchemaGrant("sales", tables=[TableGrant("customer"), TableGrant("orders", **kw), TableGrant("supplier", insert=True, update=True, delete=True)]), SchemaGrant("ops", tables=[TableGrant("events")])]
    roles = [
        Role("reader", on=[SchemaGrant("sales", tables=[TableGrant("orders")])]),
        Role("analyst", 1, can_login=True, member_of=["reader"], on=on()),
        Role("auditor", 2, can_login=True, can_access_sensitive=True, on=on(update=True)),
        Role("clerk", 0, can_login=True, member_of=["analyst"]),
        Role("stranger", 2, can_login=True, on=on()),
        Role("boss", 3, can_admin=True, can_access_sensitive=True, on=on(insert=True)),
    ]
    return Project(Database("shop", owner="owner", version="16"), [Schema("sales", [customer, orders, supplier, lineitem]), Schema("ops", [events])], roles)


def _governed(spark: SparkSession, sf_dir: str, principal: str, path: str, **more: object) -> DataFrame:
    return governed(project(), principal, path, read(spark, sf_dir, path.partition(".")[2]), key=KEY, **more)


# --- masks ----------------------------------------------------------------------------------------------------

_HIDE = "nullif(c_mktsegment, 'BUILDING')"
_PHONE = "concat('+1 ', c_nationkey + 100, '-', c_custkey + 5550000)"
_IP = "concat('192.168.', c_custkey % 256, '.', c_nationkey)"
_CARD = "concat(c_custkey + 4000, '-1234-', c_nationkey + 5000, '-', c_custkey + 1000)"
_EMAIL = "concat('user', c_custkey, '@ex', c_nationkey, '.com')"
_IPAD, _OPAD = (bytes(b ^ x for b in KEY.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


def _block_hash_sql() -> str:
    """The 64-bit hash of c_name in SQL: one row for each block of twelve bytes, each step of a round a column of its own."""

    def steps(turns: tuple, form: str) -> list[tuple[str, str]]:
        words, out = ["a", "b", "c"], []
        for i, t in enumerate(turns):
            if form == "mix":  # of three words in turn: x -= z, x ^= z turned, z += y
                x, y, z = words[i % 3], words[(i + 1) % 3], words[(i + 2) % 3]
                out.append((x, f"xor(({x} - {z} + 4294967296) % 4294967296, ({z} << {t}) % 4294967296 | ({z} >> {32 - t}))"))
                out.append((z, f"({z} + {y}) % 4294967296"))
            else:  # z ^= y, z -= y turned
                z, y = ("c", "a", "b")[i % 3], ("b", "c", "a")[i % 3]
                out.append((z, f"(xor({z}, {y}) - (({y} << {t}) % 4294967296 | ({y} >> {32 - t})) + 4294967296) % 4294967296"))
        return out

    def nested(source: str, assignments: list, keep: str) -> str:
        for word, value in assignments:
            source = f"(SELECT {keep}, {', '.join(f'{value} AS {w}' if w == word else w for w in 'abc')} FROM {source})"
        return source

    byte = lambda i: f"coalesce(('0x' || nullif(substr(h, 24 * i + {2 * i + 1}, 2), ''))::BIGINT, 0)"
    word = lambda at, shift: " + ".join(f"({byte(at + j)} << {8 * j + shift})" for j in range(4 - shift // 8))
    start = 0x9E3779B9 + 3923095
    first = f"SELECT c_custkey, lower(hex(encode(c_name))) AS h, 0 AS i, ({start} + strlen(c_name)) % 4294967296 AS a, ({start} + strlen(c_name)) % 4294967296 AS b, ({start} + strlen(c_name)) % 4294967296 AS c FROM customer"
    full = f"(SELECT c_custkey, h, i, (a + {word(0, 0)}) % 4294967296 AS a, (b + {word(4, 0)}) % 4294967296 AS b, (c + {word(8, 0)}) % 4294967296 AS c FROM r WHERE length(h) >= 24 * (i + 1))"
    tail = f"(SELECT c_custkey, h, i, (a + {word(0, 0)}) % 4294967296 AS a, (b + {word(4, 0)}) % 4294967296 AS b, (c + {word(8, 8)}) % 4294967296 AS c FROM r WHERE length(h) < 24 * (i + 1))"
    again = f"SELECT c_custkey, h, i + 1, a, b, c FROM {nested(full, steps((4, 6, 8, 16, 19, 4), 'mix'), 'c_custkey, h, i')}"
    end = nested(tail, steps((14, 11, 25, 16, 4, 14, 24), "end"), "c_custkey, h, i")
    return f"WITH RECURSIVE r AS ({first} UNION ALL {again}) SELECT c_custkey, (b::HUGEINT * 4294967296 + c - CASE WHEN b >= 2147483648 THEN 18446744073709551616::HUGEINT ELSE 0 END)::VARCHAR AS value FROM {end}"


def _mask(name: str, mask: Mask, source: str = "c_name", sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "customer").select("c_custkey", masked(F.expr(source), mask.strategy, mask, KEY).alias("value"))

    query(name, sql and f"SELECT c_custkey, {sql} AS value FROM (SELECT *, {source} AS v FROM customer)")(run)


_mask("mask_full", Mask("full"), sql="regexp_replace(v, '.', 'X', 'gs')")
_mask("mask_partial_right", Mask("partial"), sql="repeat('X', greatest(0, length(v) - 4)::INT) || right(v, 4)")
_mask("mask_partial_left", Mask("partial", visible_side="left", visible_length=6, mask_char="$"), sql="left(v, 6) || repeat('$', greatest(0, length(v) - 6)::INT)")
_mask("mask_sha256", Mask("hash", algorithm="sha256"), sql="sha256(v)")
_mask("mask_sha512", Mask("hash", algorithm="sha512"))
_mask("mask_xxhash", Mask("hash"))
ORACLE_SQL["mask_xxhash"] = _block_hash_sql()
_mask("mask_hmac256", Mask("hash", algorithm="hmac256"), sql=f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(v))))")
_mask("mask_email", Mask("email"), _EMAIL, "left(v, 1) || repeat('X', greatest(0, position('@' IN v) - 2)::INT) || substring(v, greatest(1, position('@' IN v)))")
_mask("mask_phone", Mask("phone"), _PHONE, "repeat('X', greatest(0, length(regexp_replace(v, '[^0-9]', '', 'g')) - 4)::INT) || right(regexp_replace(v, '[^0-9]', '', 'g'), 4)")
_mask("mask_card", Mask("credit_card"), _CARD, "'XXXX-XXXX-XXXX-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4)")
_mask("mask_ip", Mask("ip_address"), _IP, "'X.X.' || split_part(v, '.', 3) || '.' || split_part(v, '.', 4)")
_mask("mask_ip_one", Mask("ip_address", visible_octets=1), _IP, "'X.X.X.' || split_part(v, '.', 4)")
_mask("mask_name", Mask("name", "*"), "concat(c_name, '  ', c_mktsegment)", "array_to_string(list_transform(regexp_split_to_array(v, '\\s+'), lambda w: left(w, 1) || '***'), ' ')")
_mask("mask_hide_null", Mask("full", hide_null=True), _HIDE, "coalesce(regexp_replace(v, '.', 'X', 'gs'), 'X')")
_mask("mask_hide_null_hash", Mask("hash", algorithm="sha256", hide_null=True), _HIDE, "coalesce(sha256(v), sha256(''))")
_mask("mask_keep_null", Mask("partial", visible_length=2), _HIDE, "repeat('X', greatest(0, length(v) - 2)::INT) || right(v, 2)")

# --- reads ----------------------------------------------------------------------------------------------------

_NAME = "array_to_string(list_transform(regexp_split_to_array(c_name, '\\s+'), lambda w: left(w, 1) || '***'), ' ')"


@query("governed_select", f"SELECT c_custkey, {_NAME} AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey < 10")
def governed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "analyst", "sales.customer")


@query("governed_sensitive", f"SELECT c_custkey, {_NAME} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey >= 20 OR c_mktsegment = 'BUILDING'")
def governed_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "auditor", "sales.customer")


@query("role_inheritance", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def role_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clerk of clearance 0 reads what its parents of clearance 1 and 0 may."""
    return _governed(spark, sf_dir, "clerk", "sales.orders")


@query("column_pruning", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def column_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "reader", "sales.orders")


@query("rls_single", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY c_nationkey")
def rls_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "analyst", "sales.customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("rls_or", "SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS dear FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey >= 20 OR c_mktsegment = 'BUILDING' GROUP BY ALL")
def rls_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policies of a role, either of which lets a row through, below a join and an aggregation."""
    customer, orders = _governed(spark, sf_dir, "auditor", "sales.customer"), _governed(spark, sf_dir, "auditor", "sales.orders")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 100000).cast("long")).alias("dear"))


@query("rls_default_deny", "SELECT count(*) AS n FROM customer WHERE false")
def rls_default_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "stranger", "sales.customer").agg(F.count("*").alias("n"))


@query("rls_bypass", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer")
def rls_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir, "boss", "sales.customer").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("rls_check", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey < 10)")
def rls_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an analyst's policy refuses to write."""
    from .functions.policies import row_check

    return read(spark, sf_dir, "customer").filter(~row_check(project().table("sales.customer"), "analyst", {"analyst"}, False)).select("c_custkey", "c_nationkey")


@query("generated_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def generated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_generated(project(), "sales.lineitem", read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"))


@query("governed_join_agg", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey < 10 GROUP BY n_name")
def governed_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _governed(spark, sf_dir, "analyst", "sales.customer"), _governed(spark, sf_dir, "analyst", "sales.orders")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- writes ---------------------------------------------------------------------------------------------------


@query("insert_defaults", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, 0, 0.0 FROM supplier WHERE s_suppkey % 3 = 0")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "supplier")
    new = old.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_name", F.lit(None).cast("int").alias("s_nationkey"))
    return dml.inserted(project().table("sales.supplier"), old, new, NOW)


@query("update_rows", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.updated(project().table("sales.supplier"), read(spark, sf_dir, "supplier"), F.col("s_nationkey") == 3, {"s_acctbal": "s_acctbal + 1"}, NOW)


@query("immutable_violations", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 5 AND s_suppkey % 2 = 1")
def immutable_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an update would refuse to change: it rounds the key down to even."""
    t, df = project().table("sales.supplier"), read(spark, sf_dir, "supplier")
    return dml.changed_immutable(t, df, F.col("s_nationkey") < 5, {"s_suppkey": F.expr("s_suppkey - s_suppkey % 2")}).select("s_suppkey", "s_name")


@query("delete_rows", "SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.deleted(project().table("sales.supplier"), read(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0, NOW)


@query("delete_by_key", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return dml.deleted_by_key(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.with_history(read(spark, sf_dir, "customer"), "2024-01-01 00:00:00")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.updated(project().table("sales.customer"), _history(spark, sf_dir), F.col("c_nationkey") == 4, {"c_mktsegment": F.lit("MOVED")}, NOW)


_V = f"""WITH base AS (SELECT *, TIMESTAMP '2024-01-01' AS "{VALID_FROM}", TIMESTAMP '{FOREVER}' AS "{VALID_TO}" FROM customer),
v AS (
  SELECT * REPLACE (CASE WHEN c_nationkey = 4 THEN TIMESTAMP '{NOW}' ELSE "{VALID_TO}" END AS "{VALID_TO}") FROM base
  UNION ALL SELECT * REPLACE ('MOVED' AS c_mktsegment, TIMESTAMP '{NOW}' AS "{VALID_FROM}") FROM base WHERE c_nationkey = 4)
"""


@query("scd2_update", _V + "SELECT * FROM v")
def scd2_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query("scd2_current", _V + f"SELECT c_custkey, c_mktsegment FROM v WHERE \"{VALID_TO}\" = TIMESTAMP '{FOREVER}'")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(_versions(spark, sf_dir)).select("c_custkey", "c_mktsegment")


@query("scd2_history", _V + f"SELECT c_custkey, {_NAME} AS c_name, c_nationkey, c_mktsegment FROM v WHERE c_nationkey < 10")
def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analyst's base view has every version, without the validity columns."""
    return governed(project(), "analyst", "sales.customer", _versions(spark, sf_dir))


@query("scd2_delete", _V + f"SELECT * REPLACE (CASE WHEN c_custkey % 10 = 0 AND \"{VALID_TO}\" = TIMESTAMP '{FOREVER}' THEN TIMESTAMP '2024-03-01' ELSE \"{VALID_TO}\" END AS \"{VALID_TO}\") FROM v")
def scd2_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.deleted(project().table("sales.customer"), _versions(spark, sf_dir), F.col("c_custkey") % 10 == 0, "2024-03-01 00:00:00")


@query("scd2_drop", _V + f"SELECT * EXCLUDE (\"{VALID_FROM}\", \"{VALID_TO}\") FROM v WHERE \"{VALID_TO}\" = TIMESTAMP '{FOREVER}'")
def scd2_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detaching without history."""
    return detached(_versions(spark, sf_dir), True)


@query("pk_violations", "SELECT o_custkey AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.duplicate_keys(project().table("sales.orders"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("o_orderkey")))


@query("fk_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = project().table("sales.orders")
    return dml.orphans(t.foreign_keys[0], read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").filter("c_nationkey < 20")).select("o_orderkey", "o_custkey")


@query("required_values", "SELECT s_suppkey FROM (SELECT nullif(s_suppkey, 7) AS s_suppkey FROM supplier) WHERE s_suppkey IS NULL")
def required_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "supplier").select(F.expr("nullif(s_suppkey, 7)").alias("s_suppkey"))
    return dml.missing_values(project().table("sales.supplier"), df)


# --- erasure --------------------------------------------------------------------------------------------------


@query("erase_check", "SELECT 'sales' AS schema_name, 'orders' AS table_name, 'nullify' AS erase_strategy, count(*) AS rows_matched FROM orders WHERE o_custkey = 17")
def erase_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erase.erase_check(project(), lambda path: read(spark, sf_dir, path.partition(".")[2]), ["o_custkey"], ["17"])


def _subject(path: str, spark: SparkSession, sf_dir: str, strategy: str, key: str, value: int) -> DataFrame:
    t, df = project().table(path), read(spark, sf_dir, path.partition(".")[2])
    return erase.erased(t, df, erase.subject_match(t, df, [key], [str(value)]), strategy)


@query("erase_delete", "SELECT * FROM orders WHERE NOT coalesce(o_custkey = 17, false)")
def erase_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject("sales.orders", spark, sf_dir, "delete", "o_custkey", 17)


@query("erase_nullify", "SELECT o_orderkey, o_custkey, " + ", ".join(f"CASE WHEN o_custkey = 17 THEN NULL ELSE {c} END AS {c}" for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + " FROM orders")
def erase_nullify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject("sales.orders", spark, sf_dir, "nullify", "o_custkey", 17)


@query(
    "erase_obfuscate",
    """SELECT c_custkey, CASE WHEN hit THEN sha256(c_name) ELSE c_name END AS c_name,
  CASE WHEN hit THEN (h::HUGEINT - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT::DOUBLE ELSE c_acctbal END AS c_acctbal,
  CASE WHEN hit THEN (('0x' || left(sha256(c_nationkey::VARCHAR), 8))::BIGINT % 2147483648)::INT ELSE c_nationkey END AS c_nationkey,
  CASE WHEN hit THEN sha256(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
FROM (SELECT *, c_custkey = 42 AS hit, ('0x' || left(sha256(c_acctbal::VARCHAR), 16))::UBIGINT AS h FROM customer)""",
)
def erase_obfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject("sales.customer", spark, sf_dir, "obfuscate", "c_custkey", 42)


def _retained(spark: SparkSession, sf_dir: str, hold: str | None = None) -> DataFrame:
    return dml.with_retention(read(spark, sf_dir, "events"), 14, F.col("ts"), None if hold is None else F.expr(hold))


@query("retention_columns", f"SELECT event_id, ts + INTERVAL 14 DAY AS \"{EXPIRES}\", true AS \"{ON_EXPIRY}\" FROM events")
def retention_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).select("event_id", EXPIRES, ON_EXPIRY)


@query("retention_sweep", "SELECT event_id, user_id, event_type FROM events WHERE NOT (ts + INTERVAL 14 DAY <= TIMESTAMP '2024-01-31')")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erase.swept(project().table("ops.events"), _retained(spark, sf_dir), "2024-01-31 00:00:00").select("event_id", "user_id", "event_type")


@query("retention_legal_hold", "SELECT event_id, user_id FROM events WHERE NOT (ts + INTERVAL 14 DAY <= TIMESTAMP '2024-01-31') OR event_type = 'purchase'")
def retention_legal_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erase.swept(project().table("ops.events"), _retained(spark, sf_dir, "event_type = 'purchase'"), "2024-01-31 00:00:00").select("event_id", "user_id")


# --- changed declarations -------------------------------------------------------------------------------------


@query("attach_table", f"SELECT *, TIMESTAMP '{NOW}' AS \"{VALID_FROM}\", TIMESTAMP '{FOREVER}' AS \"{VALID_TO}\" FROM customer")
def attach_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(project().table("sales.customer"), read(spark, sf_dir, "customer"), NOW)


@query("migrate_table", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, 'open' AS status FROM supplier")
def migrate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = project().table("sales.supplier"), project().table("sales.supplier")
    after.columns = [c for c in after.columns if c.name != "s_acctbal"] + [Column("status", default="'open'")]
    after.column("s_nationkey").type = "int8"
    return reshaped(before, after, read(spark, sf_dir, "supplier"), NOW)


# --- metadata -------------------------------------------------------------------------------------------------


def _meta(spark: SparkSession) -> dict[str, DataFrame]:
    import datetime as dt

    p = project()
    rows = meta.rows_of(p, 2)
    rows["builds"] = [meta.build_row(p, n, "build", dt.datetime(2024, 1, n)) for n in (1, 2)]
    return {n: meta.frame(spark, n, rows[n]) for n in meta.SCHEMAS}


def _values(columns: str, *rows: tuple) -> str:
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns})"


@query("discover_schemas", _values("name", ("ops",), ("sales",)))
def discover_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.schemas(_meta(spark), "analyst").select("name")


@query("discover_tables", _values("schema_name, name", ("ops", "events"), ("sales", "customer"), ("sales", "orders"), ("sales", "supplier")))
def discover_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.tables(_meta(spark), "analyst").select("schema_name", "name")


@query("discover_columns", _values("name, masking_strategy", ("c_custkey", "none"), ("c_mktsegment", "none"), ("c_name", "name"), ("c_nationkey", "none")))
def discover_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.columns(_meta(spark), "analyst", "sales", "customer").select("name", "masking_strategy")


@query("discover_roles", _values("name, clearance", ("analyst", 1), ("auditor", 2), ("boss", 3), ("clerk", 0), ("reader", 0), ("stranger", 2)))
def discover_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.roles(_meta(spark), "boss").select("name", "clearance")


@query("discover_json", _values("json", ('[{"name":"ops"},{"name":"sales"}]',)))
def discover_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.as_json(discover.schemas(_meta(spark), "analyst").select("name"), "schemas")


@query("discover_nothing", _values("json", ('{"message":"No results found for schemas"}',)))
def discover_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.as_json(discover.schemas(_meta(spark), "nobody").select("name"), "schemas")


@query("latest_build", "SELECT 2::BIGINT AS build_id")
def latest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.latest(_meta(spark))


_DIFF = (("modified", "column", "sales.customer.c_acctbal", "clearance", "2", "3"), ("removed", "column", "sales.orders.o_orderpriority", None, None, None), ("added", "table", "sales.parts", None, None, None), ("modified", "table", "ops.events", "retention_days", "14", "30"))


@query("diff_projects", _values("change_kind, object_type, path, field, before, after", *_DIFF))
def diff_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = project()
    after.table("sales.customer").column("c_acctbal").clearance = 3
    orders = after.table("sales.orders")
    orders.columns = [c for c in orders.columns if c.name != "o_orderpriority"]
    after.schema("sales").tables.append(Table("parts", [Column("p_partkey", "int8")]))
    after.table("ops.events").retention_days = 30
    return diff_frame(flattened(spark, project()), flattened(spark, after))


@query("change_summary", _values("change_kind, n", ("added", 1), ("modified", 2), ("removed", 1)).replace("SELECT *", "SELECT change_kind, n::BIGINT AS n"))
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_projects(spark, sf_dir).groupBy("change_kind").agg(F.count("*").alias("n"))


@query("clearance_rollup", _values("schema_name, table_name, least, most", ("ops", "events", 0, 0), ("sales", "customer", 0, 2), ("sales", "lineitem", 0, 0), ("sales", "orders", 0, 1), ("sales", "supplier", 0, 0)))
def clearance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.clearances(_meta(spark))


@query("grants_matrix", _values("role, schema", *[(r, s) for r in ("a", "b") for s in ("ops", "sales")]).replace("SELECT *", "SELECT role, schema, privilege") + " CROSS JOIN (VALUES ('create'), ('usage')) AS p(privilege)")
def grants_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_grants(spark.createDataFrame([("a",), ("b",)], "role string"), spark.createDataFrame([("ops",), ("sales",)], "schema string"), ["usage", "create"])


@query("grants_compiled", _values("role_name, table_name, column_name", *[("reader", "orders", c) for c in ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")]))
def grants_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r, t, c) for r, _, t, c, p in grants(project()) if r == "reader" and p == "select"]
    return spark.createDataFrame(rows, "role_name string, table_name string, column_name string")


@query("column_grant_dedup", _values("role_name, schema_name, table_name, privilege, column_name", ("b", "s", "t", "select", "x")))
def column_grant_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = spark.createDataFrame([("a", "s", "t", "select", "x"), ("b", "s", "t", "select", "x")], "role_name string, schema_name string, table_name string, privilege string, column_name string")
    tables = spark.createDataFrame([("a", "s", "t", "select")], "role_name string, schema_name string, table_name string, privilege string")
    return own_column_grants(columns, tables).select(*columns.columns)


@query("index_columns", _values("table_name, column_name, position", ("customer", "c_custkey", 0), ("events", "event_id", 0), ("orders", "o_orderkey", 0), ("supplier", "s_suppkey", 0)))
def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_columns(_meta(spark)["indexes"]).select("table_name", F.col("column").alias("column_name"), "position")


@query("audit_level_merge", _values("level", ("read",), ("write",), ("ddl",)))
def audit_level_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a in merged_levels(["read", "write"], ["ddl", "write"])], "level string")


@query("members_listed", "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def members_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.listed(read(spark, sf_dir, "nation"), "n_regionkey", "n_name", "nations")


@query("retention_stream")
def retention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep as a stream over the events' file, into a folder of the session's own."""
    from .streaming.sweep import sweep_stream

    work = new_folder(spark, "retention")
    events = read(spark, sf_dir, "events")
    events.write.parquet(f"{work}/in")
    sweep_stream(spark, f"{work}/in", events.schema, f"{work}/out", f"{work}/checkpoint", project().table("ops.events"), "ts", "2024-01-31 00:00:00").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("event_id", "user_id", "event_type")


ORACLE_SQL["retention_stream"] = ORACLE_SQL["retention_sweep"]


@query("lifecycle_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 4 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def lifecycle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, attach, update with history, detach without it: the store's plain table afterwards."""
    import tempfile
    import warnings

    from .engine import Engine

    t = project().table("sales.customer")
    p = Project(Database("shop", owner="boss", version="16"), [Schema("sales", [t])], [r for r in project().roles if r.name != "reader"])
    for r in p.roles:
        r.member_of = [m for m in r.member_of if m != "reader"]
        r.on = [SchemaGrant("sales", tables=[TableGrant("customer", update=r.name == "boss")])]
    engine = Engine(spark, new_folder(spark, "lifecycle"), KEY, principal="boss")
    engine.store.commit({"sales.customer": read(spark, sf_dir, "customer")})
    with warnings.catch_warnings(), tempfile.TemporaryDirectory() as out:
        warnings.simplefilter("ignore")
        engine.attach(engine.build(p, out, "shop"))
        engine.update("boss", "sales.customer", "c_nationkey = 4", {"c_mktsegment": "'MOVED'"})
        engine.detach("drop", confirmed=True)
    return engine.store.read("sales.customer")
