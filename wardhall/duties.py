"""Queries over what the engine owes: erased rows are gone, hidden rows stay hidden, references hold, history is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .model import Column, Database, ForeignKey, Index, Project, Role, RowPolicy, Schema, SchemaGrant, Table, TableGrant
from .operators.audit import LOG
from .queries import query, read
from .scenarios import _engine, _shop, _tried


def _every_file(engine: Engine, name: str) -> DataFrame:
    """The rows of all files that lie under a store's root for a table, in whatever version."""
    return engine.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{engine.store.root}/tables/*{name}*")


# --- callers' SQL ---------------------------------------------------------------------------------------------


@query("sql_shadow_refused", "SELECT s_suppkey, repeat('X', length(s_name)) AS s_name, s_nationkey FROM supplier")
def sql_shadow_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clerk reads by SQL, after every way round the views has been refused."""
    engine, _ = _engine(spark, sf_dir, _shop())
    path = f"{engine.store.root}/tables/__shadow__.sales.supplier"
    for text in (
        f"WITH `parquet.{path}` AS (SELECT 1 AS a) SELECT * FROM parquet.`{path}`",
        f"SELECT * FROM (WITH `x` AS (SELECT 1 AS a) SELECT * FROM x) JOIN parquet.`{path}`",
        *[f"SELECT * FROM {kind}.`{path}`" for kind in ("parquet", "orc", "json", "csv", "text", "binaryFile")],
        "WITH `global_temp.sales_supplier` AS (SELECT 1 AS a) SELECT * FROM global_temp.sales_supplier", "SELECT s_acctbal FROM sales_supplier",
    ):
        _tried(lambda text=text: engine.sql("clerk", text))
    return engine.sql("clerk", "WITH seen AS (SELECT s_suppkey, s_name, s_nationkey FROM sales_supplier) SELECT * FROM seen")


@query(
    "audit_reads",
    """SELECT 'boss' AS principal, count(*) AS rows_read FROM supplier UNION ALL SELECT 'boss', count(*) FROM supplier
UNION ALL SELECT 'clerk', count(*) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'clerk', count(DISTINCT s_nationkey) FROM supplier""",
)
def audit_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each reading with its rows: a frame read twice, two queries, and none for plans that never run."""
    engine, _ = _engine(spark, sf_dir, _shop())
    engine.count_reads = True
    seen = engine.table("boss", "sales.supplier")
    seen.filter("s_suppkey > 3").count()
    seen.groupBy("s_nationkey").count().collect()
    engine.table("clerk", "sales.supplier").filter("s_suppkey = 1")
    engine.sql("clerk", "SELECT * FROM sales_supplier")
    engine.sql("clerk", "SELECT s_suppkey FROM sales_supplier WHERE s_suppkey % 3 = 0").collect()
    engine.sql("clerk", "SELECT s_nationkey, count(*) AS n FROM sales_supplier GROUP BY s_nationkey").collect()
    return engine.store.read(LOG).filter("action = 'select'").select("principal", F.col("row_count").alias("rows_read"))


# --- erasure --------------------------------------------------------------------------------------------------


def _people(strategy: str, **more: object) -> Project:
    """Customers as data subjects, and a boss."""
    customer = Table("customer", [Column("c_custkey", "int8", nullable=False, is_subject_identifier=True), Column("c_name"), Column("c_nationkey", "int4"), Column("c_acctbal", "float8"), Column("c_mktsegment"), Column("shout", generated_expression="upper(c_name)")], indexes=[Index("customer_pkey", ["c_custkey"], primary_key=True)], erase_strategy=strategy)
    for name, value in more.items():
        setattr(customer, name, value)
    grant = SchemaGrant("sales", create=True, tables=[TableGrant("customer", insert=True, update=True, delete=True, truncate=True)])
    return Project(Database("shop", owner="boss", version="16"), [Schema("sales", [customer])], [Role("boss", can_login=True, can_admin=True, on=[grant])])


@query("erase_physical", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey <> 7")
def erase_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every file on disk, after updates have left snapshots behind and a subject was erased."""
    engine, _ = _engine(spark, sf_dir, _people("delete"), {"sales.customer": read(spark, sf_dir, "customer")})
    engine.update("boss", "sales.customer", "c_custkey = 7", {"c_mktsegment": "'MOVED'"})
    engine.erase_apply(["c_custkey"], ["7"], principal="boss")
    return _every_file(engine, "customer").select("c_custkey", "c_name", "c_mktsegment").distinct()


@query("erase_generated", "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 > 0 THEN upper(c_name) END AS shout FROM customer")
def erase_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was generated from erased values is generated anew."""
    from .operators.erase import erased

    t = _people("nullify").table("sales.customer")
    return erased(t, read(spark, sf_dir, "customer").withColumn("shout", F.upper("c_name")), F.col("c_custkey") % 5 == 0).select("c_custkey", "c_name", "shout")


# --- references -----------------------------------------------------------------------------------------------


def _linked() -> Project:
    """Line items that refer to orders, and orders that refer to customers."""

    def table(name: str, key: list[str], column: str | None = None, to: str = "", referred: str = "") -> Table:
        return Table(name, [Column(c, "int8", nullable=False) for c in [*key, *([column] if column and column not in key else [])]], indexes=[Index(f"{name}_pkey", key, primary_key=True)], foreign_keys=[ForeignKey(f"{name}_{to}", column, "sales", to, referred)] if column else [])

    tables = [table("customer", ["c_custkey"]), table("orders", ["o_orderkey"], "o_custkey", "customer", "c_custkey"), table("lineitem", ["l_orderkey", "l_linenumber"], "l_orderkey", "orders", "o_orderkey")]
    grants = [TableGrant(t.name, insert=True, update=True, delete=True, truncate=True) for t in tables]
    return Project(Database("shop", owner="boss", version="16"), [Schema("sales", tables)], [Role("boss", can_login=True, can_admin=True, on=[SchemaGrant("sales", tables=grants)])])


def _stored(spark: SparkSession, sf_dir: str, p: Project) -> dict[str, DataFrame]:
    return {f"sales.{t.name}": read(spark, sf_dir, t.name).select(*[c.name for c in t.columns]) for _, t in p.tables()}


@query(
    "fk_dependants",
    """WITH RECURSIVE gone(name, a, b) AS (SELECT 'customer', c_custkey, 0 FROM customer WHERE c_custkey % 50 = 7
UNION ALL SELECT * FROM (SELECT 'orders', o_orderkey, 0 FROM gone JOIN orders ON name = 'customer' AND a = o_custkey UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM gone JOIN lineitem ON name = 'orders' AND a = l_orderkey))
SELECT name AS table_name, a AS key_value, b AS line FROM gone WHERE name <> 'customer'""",
)
def fk_dependants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that refer to some customers, directly or through orders."""
    from .operators.references import dependants

    p = _linked()
    tables = _stored(spark, sf_dir, p)
    found = dependants(p, "sales.customer", tables["sales.customer"].filter("c_custkey % 50 = 7"), tables.__getitem__)
    orders = found["sales.orders"].select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("key_value"), F.lit(0).alias("line"))
    return orders.union(found["sales.lineitem"].select(F.lit("lineitem"), "l_orderkey", F.col("l_linenumber").cast("int")))


@query("delete_referenced", "SELECT c_custkey FROM customer WHERE c_custkey > 20 OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey <= 20) AND c_custkey > 20")
def delete_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers can't go before their orders, nor orders before their lines; then they can."""
    p = _linked()
    engine, _ = _engine(spark, sf_dir, p, _stored(spark, sf_dir, p))
    _tried(lambda: engine.delete("boss", "sales.customer", "c_custkey <= 20"))
    _tried(lambda: engine.truncate("boss", "sales.customer"))
    _tried(lambda: engine.update("boss", "sales.customer", "c_custkey <= 20", {"c_custkey": "c_custkey + 1000000000"}))
    some = ", ".join(str(r[0]) for r in read(spark, sf_dir, "orders").filter("o_custkey <= 20").select("o_orderkey").collect())
    _tried(lambda: engine.delete("boss", "sales.orders", "o_custkey <= 20"))
    engine.delete("boss", "sales.lineitem", f"l_orderkey in ({some})")
    engine.delete("boss", "sales.orders", "o_custkey <= 20")
    engine.delete("boss", "sales.customer", "c_custkey <= 20")
    return engine.raw("boss", "sales.customer").select("c_custkey")


# --- policies -------------------------------------------------------------------------------------------------


def _ordered(using: str, barrier: bool = False) -> Project:
    p = _linked()
    t = p.table("sales.orders")
    t.columns += [Column("o_orderstatus"), Column("o_orderpriority")]
    t.foreign_keys, t.rls_enabled, t.rls_security_barrier = [], True, barrier
    t.rls_policies = [RowPolicy(["clerk"], u) for u in using.split(" ;; ")]
    p.table("sales.customer").columns += [Column("c_nationkey", "int4"), Column("c_acctbal", "float8")]
    p.roles.append(Role("clerk", can_login=True, on=[SchemaGrant("sales", tables=[TableGrant("orders", update=True)])]))
    return p


@query("rls_barrier", "SELECT o_orderkey, left(o_orderpriority, 1)::INT AS urgency FROM orders WHERE o_orderstatus = 'O'")
def rls_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's cast fails on every hidden row, and so must not see one."""
    from .plans.compile import governed

    raw = read(spark, sf_dir, "orders").withColumn("o_orderpriority", F.expr("if(o_orderstatus = 'O', o_orderpriority, 'secret')"))
    seen = governed(_ordered("o_orderstatus = 'O'", True), "clerk", "sales.orders", raw)
    return seen.filter(F.left("o_orderpriority", F.lit(1)).cast("int") >= 0).select("o_orderkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("urgency"))


_FEW = "nullif(c_nationkey, 3) < 5"


@query(
    "rls_related",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_custkey, 8) AS o_custkey FROM orders) o
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {_FEW}) OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal < 0) OR (o_custkey IS NULL AND o_orderkey % 2 = 0)""",
)
def rls_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by what customers say of their buyers: three policies, two of which ask another table, with nulls on both sides."""
    from .plans.compile import governed

    customer = read(spark, sf_dir, "customer")
    raw = read(spark, sf_dir, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey, 8)"))
    p = _ordered(f"o_custkey IN (SELECT c_custkey FROM sales.customer WHERE {_FEW}) ;; EXISTS (SELECT 1 FROM sales.customer WHERE sales.customer.c_custkey = o_custkey AND c_acctbal < 0) ;; o_custkey IS NULL AND o_orderkey % 2 = 0")
    return governed(p, "clerk", "sales.orders", raw, read=lambda path: customer).select("o_orderkey")


# --- row images -----------------------------------------------------------------------------------------------


@query(
    "image_versions",
    """WITH i AS (SELECT event_id, ts, user_id, event_type, value FROM events UNION ALL SELECT -1, TIMESTAMP '2023-12-31', user_id, 'signup', 0.0 FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)),
n AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
v AS (SELECT user_id, event_type, value, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '9999-12-31 23:59:59.999999') AS valid_to FROM n)
SELECT * FROM v WHERE event_type <> 'error'""",
)
def image_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose state is their latest event, and who are gone after an error; half of the events come late, in a second batch."""
    from .model import VALID_FROM, VALID_TO
    from .operators.images import folded

    t = Table("users", [Column("user_id", "int8", nullable=False), Column("event_type", versioned=True), Column("value", "float8")], indexes=[Index("users_pkey", ["user_id"], primary_key=True)])
    events = read(spark, sf_dir, "events")
    images = events.select("user_id", "event_type", "value", F.when(F.col("event_type") == "error", "gone").otherwise("put").alias("op"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    start = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")
    stored = events.filter("user_id % 2 = 0").select("user_id", F.lit("signup").alias("event_type"), F.lit(0.0).alias("value"), start.alias(VALID_FROM), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz").alias(VALID_TO)).distinct()
    once = folded(t, stored, images.filter("seq % 2 = 1"))
    return folded(t, once, images.filter("seq % 2 = 0")).filter(F.col(VALID_FROM) < F.col(VALID_TO)).withColumnsRenamed({VALID_FROM: "valid_from", VALID_TO: "valid_to"})


@query("image_rows", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without history, by the engine: the latest image of each user."""
    t = Table("users", [Column("user_id", "int8", nullable=False), Column("event_type"), Column("value", "float8")], indexes=[Index("users_pkey", ["user_id"], primary_key=True)])
    grant = SchemaGrant("ops", tables=[TableGrant("users", insert=True, update=True, delete=True)])
    p = Project(Database("shop", owner="boss", version="16"), [Schema("ops", [t])], [Role("boss", can_login=True, can_admin=True, on=[grant])])
    events = read(spark, sf_dir, "events")
    engine, _ = _engine(spark, sf_dir, p, {"ops.users": events.filter("false").select("user_id", "event_type", "value")})
    engine.apply("boss", "ops.users", events.select("user_id", "event_type", "value", F.when(F.col("event_type") == "error", "gone").otherwise("put").alias("op"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))
    return engine.raw("boss", "ops.users")


# --- erasure file by file -------------------------------------------------------------------------------------


@query("erase_files", "SELECT c_custkey, CASE WHEN c_custkey <> 42 THEN c_name END AS c_name, CASE WHEN c_custkey <> 42 THEN c_nationkey END AS c_nationkey, CASE WHEN c_custkey <> 42 THEN upper(c_name) END AS shout FROM customer")
def erase_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject is erased by rewriting the files that hold it; the others are the same files as before."""
    engine, _ = _engine(spark, sf_dir, _people("nullify"), {"sales.customer": read(spark, sf_dir, "customer").repartition(8, "c_name")})
    engine.erase_apply(["c_custkey"], ["42"], principal="boss")
    return engine.raw("boss", "sales.customer").select("c_custkey", "c_name", "c_nationkey", "shout")


@query("retention_periods", "SELECT event_id, user_id, event_type FROM events WHERE ts + INTERVAL 14 DAY > TIMESTAMP '2024-01-31 12:00:00' OR event_id % 7 = 0")
def retention_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep drops the folders of days that are over and reads the days around its moment; every seventh event is held."""
    from .operators.dml import with_retention
    from .operators.expiry import sweep
    from .queries import project
    from .sources.store import Store
    from .sources.work import new_folder

    t, store = project().table("ops.events"), Store(spark, new_folder(spark, "periods"))
    store.commit({"ops.events": with_retention(read(spark, sf_dir, "events"), 14, F.col("ts"), F.col("event_id") % 7 == 0)})
    found = sweep(store, "ops.events", t, "2024-01-31 12:00:00")
    store.commit(rewrite={"ops.events": (found.files, found.left)})
    store.purge(["ops.events"])
    return store.read("ops.events").select("event_id", "user_id", "event_type")


@query(
    "retention_timers",
    """WITH w AS (SELECT max(ts) AS now FROM events)
SELECT event_id FROM events, w WHERE epoch_ms(ts + INTERVAL 5 DAY) <= epoch_ms(now) AND (event_id % 11 <> 0 OR event_id % 22 = 0)""",
)
def retention_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events expire five days after their time, by timers of a stream in three batches; every eleventh is held from the second on, and half of those are released in the third."""
    from .sources.work import new_folder
    from .streaming.timers import HOLD, RELEASE, ROW, expiring, run_to_end

    work, events = new_folder(spark, "timers"), read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    third = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    rows = events.select(F.col("event_id").alias("key"), F.lit(ROW).alias("kind"), at.alias("at"), F.unix_millis(at + F.expr("INTERVAL 5 DAYS")).alias("expires_ms"), third.alias("batch"))
    sent = lambda batch, kind, every: events.filter(f"event_id % {every} = 0").select("event_id", F.lit(kind), F.lit(f"2024-01-{10 * batch + 5}").cast("timestamp"), F.lit(None).cast("long"), F.lit(batch).cast("long"))
    whole = rows.union(sent(1, HOLD, 11)).union(sent(2, RELEASE, 22))
    for batch in range(3):
        whole.filter(f"batch = {batch}").drop("batch").write.parquet(f"{work}/in/{batch}")
        messages = spark.readStream.schema("key long, kind string, at timestamp, expires_ms long").option("recursiveFileLookup", "true").parquet(f"{work}/in")
        run_to_end(expiring(messages), f"{work}/out", f"{work}/checkpoint", more=batch < 2)
    return spark.read.schema("key long, expired_at long").parquet(f"{work}/out").select(F.col("key").alias("event_id"))
