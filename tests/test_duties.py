import os
import warnings

import pytest
from pyspark.sql import functions as F

from tests.test_engine import rows, shop  # noqa: F401
from tests.test_engine import engine as engine  # noqa: PLC0414
from wardhall.model import AccessDenied, GovernanceError
from wardhall.plans import plain

warnings.filterwarnings("ignore")


@pytest.mark.filterwarnings("ignore")
def test_no_way_round_the_views(spark, engine, tmp_path):
    path = f"{engine.store.root}/tables/__shadow__.hr.people"
    secret = str(tmp_path / "secret")
    spark.range(3).write.mode("overwrite").format("orc").save(secret)
    spark.range(2).createOrReplaceGlobalTempView("outside")
    spark.sql("CREATE TABLE IF NOT EXISTS lying_around USING parquet AS SELECT 1 AS a")
    attacks = [
        f"WITH `parquet.{path}` AS (SELECT 1 AS a) SELECT * FROM parquet.`{path}`", f"WITH `orc.{secret}` AS (SELECT 1 AS a) SELECT * FROM orc.`{secret}`", "WITH `global_temp.outside` AS (SELECT 1 AS a) SELECT * FROM global_temp.outside",
        "SELECT * FROM (WITH lying_around AS (SELECT 1 AS a) SELECT * FROM lying_around), lying_around", "WITH lying_around AS (SELECT * FROM lying_around) SELECT * FROM lying_around", "SELECT * FROM lying_around", "SELECT * FROM default.lying_around", "SELECT * FROM spark_catalog.default.lying_around",
        "WITH a AS (WITH b AS (SELECT 1 AS x) SELECT * FROM b) SELECT * FROM b", "SELECT (SELECT max(id) FROM orc.`" + secret + "`)", "SELECT * FROM hr_people WHERE id IN (SELECT a FROM lying_around)",
        *[f"SELECT * FROM {kind}.`{path}`" for kind in ("parquet", "PARQUET", "csv", "json", "text", "orc", "binaryFile")],
    ]
    try:
        for text in attacks:
            with pytest.raises(GovernanceError):
                engine.sql("clerk", text).collect()
    finally:
        spark.sql("DROP TABLE lying_around")
    assert engine.sql("clerk", "WITH Seen AS (SELECT ID FROM HR_People) SELECT count(*) AS n FROM seen").first()[0] == 2


@pytest.mark.filterwarnings("ignore")
def test_columns_that_reach_beyond_rows(spark, engine):
    spark.range(1).createOrReplaceTempView("other")
    for bad in (F.expr("java_method('java.lang.System', 'getenv', 'HOME')"), F.expr("(select max(id) from other)"), F.input_file_name(), F.udf(lambda x: "x")("name")):
        with pytest.raises(AccessDenied):
            engine.update("clerk", "hr.people", F.lit(True), {"team": bad})
    with pytest.raises(AccessDenied):
        engine.delete("clerk", "hr.people", F.expr("exists(select 1 from other)"))
    engine.update("clerk", "hr.people", F.col("id") == 1, {"team": F.concat(F.col("team"), F.lit("?"))})
    assert "red?" in [r[2] for r in rows(engine.table("clerk", "hr.people"))]
    plain.columns_only(spark.range(1).select(F.upper(F.lit("a"))))


def _held(root, text):
    """Files under a folder in which a text stands, Parquet decoded."""
    import pyarrow.parquet as pq

    found = []
    for at, _, names in os.walk(root):
        for n in names:
            path = os.path.join(at, n)
            whole = str(pq.read_table(path).to_pylist()) if n.endswith(".parquet") else open(path, "rb").read().decode(errors="replace")
            if text in whole:
                found.append(path)
    return found


@pytest.mark.filterwarnings("ignore")
def test_no_file_holds_an_erased_subject(engine):
    old = engine.store.version()
    engine.update("boss", "hr.people", "id = 1", {"team": "'moved'"})
    assert _held(engine.store.root, "Ann") and _held(engine.store.root, "hello")
    engine.erase_apply(["id", "person"], ["1", "1"])
    assert not _held(engine.store.root, "Ann") and not _held(engine.store.root, "hello")
    with pytest.raises(GovernanceError):
        engine.store.read("__shadow__.hr.people", old)
    with pytest.raises(GovernanceError):
        engine.store.read("hr.people", 1)
    assert engine.store.read("__shadow__.hr.people").count() == 4 and _held(engine.store.root, "Bob")


@pytest.mark.filterwarnings("ignore")
def test_no_file_holds_swept_rows(engine):
    import datetime as dt

    engine.sweep(dt.datetime(2024, 2, 15))
    assert not _held(engine.store.root, "hello") and engine.raw("boss", "hr.notes").count() == 0


def test_failed_commits_leave_no_folder(spark, tmp_path):
    from wardhall.sources.store import Conflict, Store

    s = Store(spark, str(tmp_path / "s"))
    s.commit({"a.t": spark.range(1)})
    other = Store(spark, str(tmp_path / "s"))
    taken = other._publish
    other._publish = lambda m: (s.commit({"b.t": spark.range(1)}), taken(m))
    with pytest.raises(Conflict):
        other.commit({"a.t": spark.range(2)})
    assert len(os.listdir(tmp_path / "s" / "tables" / "a.t")) == 1
    other._publish = taken
    seen = s.version()
    s.commit({"b.t": spark.range(3)})
    with pytest.raises(Conflict):
        other.commit({"a.t": spark.range(2)}, expected=seen)
    with pytest.raises(Conflict):
        other.commit({"a.t": spark.range(2)}, expected=seen, reads=["b.t"])
    other.commit({"a.t": spark.range(2)}, expected=seen, reads=[])  # another table's writer doesn't stand in the way
    with pytest.raises(Conflict):
        s.commit({"a.t": spark.range(5)}, expected=seen, reads=[])
    once = []
    other._publish = lambda m: (once or once.append(s.commit({"b.t": spark.range(4)})), taken(m))[1]
    v = other.commit({"a.t": spark.range(1)}, expected=s.version(), reads=[])
    assert v == s.version() and s.read("a.t").count() == 1 and s.read("b.t").count() == 4
    assert len(s.purge(["a.t"])) == 2 and len(os.listdir(tmp_path / "s" / "tables" / "a.t")) == 1 and s.read("a.t").count() == 1


# --- references, policies ---------------------------------------------------------------------------------------


def _people_project(versioned=False):
    from wardhall.model import Column, Database, ForeignKey, Index, Project, Role, Schema, SchemaGrant, Table, TableGrant

    boss = Table("people", [Column("id", "int8", nullable=False), Column("chief", "int8"), Column("name", versioned=versioned)], indexes=[Index("p", ["id"], primary_key=True)], foreign_keys=[ForeignKey("chief", "chief", "hr", "people", "id")])
    pets = Table("pets", [Column("pet", "int8", nullable=False), Column("owner", "int8"), Column("vet", "int8")], indexes=[Index("q", ["pet"], primary_key=True)], foreign_keys=[ForeignKey("owner", "owner", "hr", "people", "id"), ForeignKey("vet", "vet", "hr", "people", "id")])
    every = [TableGrant(n, insert=True, update=True, delete=True, truncate=True) for n in ("people", "pets")]
    return Project(Database("shop", owner="boss", version="16"), [Schema("hr", [boss, pets])], [Role("boss", can_login=True, can_admin=True, on=[SchemaGrant("hr", tables=every)])])


def test_dependants_through_a_cycle(spark):
    from wardhall.operators.references import children_first, dependants

    people = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d"), (5, 6, "e"), (6, 5, "f"), (7, 7, "g")], "id long, chief long, name string")
    pets = spark.createDataFrame([(1, 3, None), (2, None, 3), (3, 3, 2), (4, 4, 4), (5, None, None), (6, 6, 4)], "pet long, owner long, vet long")
    tables = {"hr.people": people, "hr.pets": pets}
    p = _people_project()
    found = lambda where: {n: sorted(r[0] for r in df.collect()) for n, df in dependants(p, "hr.people", people.filter(where), tables.__getitem__).items()}
    assert found("id = 1") == {"hr.people": [1, 2, 3], "hr.pets": [1, 2, 3]}
    assert found("id = 5") == {"hr.people": [5, 6], "hr.pets": [6]}
    assert found("id = 4") == {"hr.people": [4], "hr.pets": [4, 6]}
    assert found("id = 9").get("hr.pets", people.limit(0)) is not None and children_first(p, ["hr.people", "hr.pets"]) == ["hr.pets", "hr.people"]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("versioned", [False, True])
def test_referred_rows_stay(spark, tmp_path, versioned):
    from wardhall.engine import Engine

    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    e.store.commit({"hr.people": spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, None, "c"), (4, 4, "d")], "id long, chief long, name string"), "hr.pets": spark.createDataFrame([(1, 3, None)], "pet long, owner long, vet long")})
    e.attach(e.build(_people_project(versioned), str(tmp_path / "o"), "p")) if not versioned else None
    if versioned:
        p = _people_project(True)
        for t in p.schemas[0].tables:
            t.foreign_keys = []
        e.attach(e.build(p, str(tmp_path / "o"), "p"))
        return
    for where in ("id = 1", "id = 3", "true"):
        with pytest.raises(GovernanceError, match="refers to a row"):
            e.delete("boss", "hr.people", where)
    with pytest.raises(GovernanceError, match="hr.pets"):
        e.update("boss", "hr.people", "id = 3", {"id": "30"})
    e.delete("boss", "hr.people", "id in (1, 2)")  # both sides go at once
    e.delete("boss", "hr.people", "id = 4")
    assert [r[0] for r in rows(e.raw("boss", "hr.people"))] == [3]


def _order_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_predicate_of_a_caller_stands_below_a_barrier(spark):
    from wardhall.duties import _ordered
    from wardhall.plans.compile import governed

    orders = spark.createDataFrame([(1, 1, "O", "1-URGENT"), (2, 2, "F", "hidden"), (3, 3, None, "hidden too")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    customer = spark.createDataFrame([(1, 2, 1.0), (None, 2, 1.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    for using in ("o_orderstatus = 'O'", "o_custkey IN (SELECT c_custkey FROM sales.customer)", "EXISTS (SELECT 1 FROM sales.customer WHERE c_custkey = o_custkey) ;; o_orderstatus = 'X'"):
        seen = governed(_ordered(using, True), "clerk", "sales.orders", orders, read=lambda _: customer)
        asked = seen.filter(F.left("o_orderpriority", F.lit(1)).cast("int") > 0).join(customer.withColumnRenamed("c_custkey", "k"), F.col("o_custkey") == F.col("k")).filter("o_orderkey < 99")
        plan = _order_of(asked)
        top, _, below = plan.partition("SPARK_PARTITION_ID")
        assert "as int) > 0" in top and "as int) > 0" not in below and "99" not in below
        assert [r["o_orderkey"] for r in asked.collect()] == [1]
    open_ = governed(_ordered("o_orderstatus = 'O'"), "clerk", "sales.orders", orders)
    assert "SPARK_PARTITION_ID" not in _order_of(open_)


@pytest.mark.filterwarnings("ignore")
def test_writes_behind_a_barrier(spark, tmp_path):
    from wardhall.duties import _ordered
    from wardhall.engine import Engine

    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    p = _ordered("o_orderstatus = 'O'", True)
    p.schemas[0].tables = [p.table("sales.orders")]
    for r in p.roles:
        r.on[0].tables = [t for t in r.on[0].tables if t.name == "orders"]
    e.store.commit({"sales.orders": spark.createDataFrame([(1, 1, "O", "1-URGENT"), (2, 2, "F", "hidden")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")})
    e.attach(e.build(p, str(tmp_path / "o"), "p"))
    e.update("clerk", "sales.orders", "cast(left(o_orderpriority, 1) as int) > 0", {"o_custkey": "cast(left(o_orderpriority, 1) as int) + 8"})
    assert rows(e.raw("boss", "sales.orders")) == [(1, 9, "O", "1-URGENT"), (2, 2, "F", "hidden")]


@pytest.mark.filterwarnings("ignore")
def test_policies_over_other_tables_in_the_engine(spark, tmp_path):
    from wardhall.duties import _ordered
    from wardhall.engine import Engine

    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    p = _ordered("o_custkey IN (SELECT c_custkey FROM sales.customer WHERE c_nationkey = 1) ;; o_orderpriority = 'sales.customer' ;; o_orderstatus = current_principal()")
    p.table("sales.lineitem").foreign_keys = []
    e.store.commit({
        "sales.customer": spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (None, 1, 1.0)], "c_custkey long, c_nationkey int, c_acctbal double"),
        "sales.orders": spark.createDataFrame([(1, 1, "O", "x"), (2, 2, "O", "x"), (3, 2, "O", "sales.customer"), (4, 9, "clerk", "x")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "sales.lineitem": spark.createDataFrame([(1, 1)], "l_orderkey long, l_linenumber long"),
    })
    e.attach(e.build(p, str(tmp_path / "o"), "p"))
    assert [r[0] for r in rows(e.table("clerk", "sales.orders"))] == [1, 3, 4]
    assert e.sql("clerk", "SELECT sum(o_orderkey) FROM sales_orders").first()[0] == 8
    e.update("clerk", "sales.orders", "true", {"o_orderpriority": "concat(o_orderpriority, '')"})
    with pytest.raises(GovernanceError, match="row policy"):
        e.update("clerk", "sales.orders", "o_orderkey = 1", {"o_custkey": "2"})
    assert not [v.name for v in spark.catalog.listTables() if "asked" in v.name]


# --- row images -------------------------------------------------------------------------------------------------


def _brute_versions(images):
    """(key, value, from, to) by going through each key's images in order."""
    last = {}
    for key, value, op, at, seq in sorted(images, key=lambda i: (i[3], i[4])):
        last[key, at] = (value, op)
    out = []
    for key in {k for k, _ in last}:
        times = sorted(at for k, at in last if k == key)
        for at, to in zip(times, [*times[1:], "9999-12-31 23:59:59.999999"]):
            value, op = last[key, at]
            if op == "put":
                out.append((key, value, at, to))
    return sorted(out)


def test_batches_of_images_fold_into_versions(spark):
    """Out of order, several of one moment, late among stored versions, in one batch or in three."""
    import random

    from wardhall.model import VALID_FROM, VALID_TO, Column, Index, Table
    from wardhall.operators.images import folded

    rnd = random.Random(4)
    t = Table("t", [Column("k", "int8"), Column("v", versioned=True)], indexes=[Index("p", ["k"], primary_key=True)])
    images = [(rnd.randrange(4), f"v{i}", rnd.choice(["put", "put", "gone"]), f"2024-01-{rnd.randint(1, 9):02d} {rnd.randint(0, 3):02d}:00:00", i) for i in range(60)]
    rnd.shuffle(images)
    empty = spark.createDataFrame([], f"k long, v string, {VALID_FROM} timestamp_ntz, {VALID_TO} timestamp_ntz")
    frame = lambda some: spark.createDataFrame(some, "k long, v string, op string, at string, seq long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = lambda df: sorted((r[0], r[1], str(r[2]), str(r[3])) for r in df.filter(f"{VALID_FROM} < {VALID_TO}").select("k", "v", VALID_FROM, VALID_TO).collect())
    assert got(folded(t, empty, frame(images))) == _brute_versions(images)
    assert got(folded(t, empty, frame(images + images[:9]))) == _brute_versions(images)
    one_each = list({(k, at): (k, v, op, at, s) for k, v, op, at, s in sorted(images, key=lambda i: i[4])}.values())  # later batches win a moment
    rnd.shuffle(one_each)
    df = empty
    for part in (one_each[:10], one_each[10:25], one_each[25:]):
        df = folded(t, df, frame(part))
    assert got(df) == _brute_versions(one_each)


@pytest.mark.filterwarnings("ignore")
def test_images_in_the_engine(spark, engine):
    frame = lambda *r: spark.createDataFrame(list(r), "id long, name string, team string, salary int, op string, at string, seq long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    engine.apply("boss", "hr.people", frame((1, "Ann", "green", 11, "put", "2024-03-01", 2), (1, "Ann", "red", 10, "put", "2024-02-01", 1), (3, None, None, None, "gone", "2024-03-01", 3), (9, "New", None, 1, "put", "2024-02-02", 4)))
    live = engine.raw("boss", "hr.people").filter("__valid_to__ > timestamp_ntz'9999-01-01'").select("id", "name", "team", "salary")
    assert rows(live) == [(1, "Ann", "green", 11), (2, "Bob", "secret", 20), (9, "New", "none", 1)]
    assert engine.raw("boss", "hr.people").filter("id = 1").count() == 3
    clerk = lambda *r: frame(*r).drop("salary")
    for bad in ((2, "Bob", "open", 1, "put", "2024-04-01", 1), (1, "Ann", "secret", 1, "put", "2024-04-01", 1), (None, "X", "red", 1, "put", "2024-04-01", 1), (1, "X", "red", 1, "swap", "2024-04-01", 1), (1, "X", "red", 1, "put", None, 1)):
        with pytest.raises(GovernanceError):
            engine.apply("clerk", "hr.people", clerk(bad))
    with pytest.raises(AccessDenied):
        engine.apply("clerk", "hr.people", frame((1, "Ann", "red", 1, "put", "2024-04-01", 1)))
    with pytest.raises(AccessDenied):
        engine.apply("self", "hr.people", clerk((1, "Ann", "red", 1, "gone", "2024-04-01", 1)))
    with pytest.raises(GovernanceError):
        engine.apply("boss", "hr.people", frame((1, "Ann", "red", 1, "put", "2024-04-01", 1)).withColumn("size", F.lit(1)))


# --- erasure file by file -----------------------------------------------------------------------------------------


def _read_by(df):
    """Rows that the scan of a frame gave, after its footers ruled out row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    stack, total = [plan], 0
    while stack:
        node = stack.pop()
        children = list(plain._each(node.children()))
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            children = [node.plan()]
        if "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
        stack += children
    return total


@pytest.mark.filterwarnings("ignore")
def test_an_erasure_rewrites_the_files_that_hold_the_subject(spark, tmp_path):
    from wardhall.duties import _people
    from wardhall.engine import SHADOW, Engine
    from wardhall.operators import erase, expiry
    from wardhall.sources.work import confs

    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    e.store.commit({"sales.customer": spark.read.parquet("/root/testdata/sf0.1/customer.parquet").repartition(16, "c_name")})
    with confs(spark, spark__sql__files__maxPartitionBytes="30000", spark__sql__files__openCostInBytes="30000"):  # a task for each file
        e.attach(e.build(_people("delete"), str(tmp_path / "o"), "p"))
    name, t = SHADOW + "sales.customer", e.project.table("sales.customer")
    before = set(e.store.files(name))
    files = len(before)
    assert files >= 16
    found = e.store.scan(name).filter(erase.subject_predicate(t, e.store.scan(name), ["c_custkey"], ["4711"]))
    assert "EqualTo(c_custkey,4711)" in found._jdf.queryExecution().executedPlan().toString()
    assert _read_by(found) < 2500  # of 15000 rows, those of a row group or two
    hit = expiry.files_with(e.store, name, erase.subject_predicate(t, e.store.scan(name), ["c_custkey"], ["4711"]))
    assert len(hit) == 1
    e.erase_apply(["c_custkey"], ["4711"])
    after = set(e.store.files(name))
    assert len(before & after) == files - 1 and len(before - after) == 1 and not os.path.exists((before - after).pop().removeprefix("file:"))
    assert e.raw("boss", "sales.customer").count() == 14999
    e.erase_apply(["c_custkey"], ["4712"])  # again, of a table that is named by files
    assert e.raw("boss", "sales.customer").count() == 14998 and not _held(e.store.root, "Customer#000004712")
    e.detach(confirmed=True)
    assert e.store.read("sales.customer").count() == 14998


def test_a_sweep_drops_days_by_their_folders(spark, tmp_path):
    from wardhall.model import EXPIRES
    from wardhall.operators import expiry
    from wardhall.operators.dml import with_retention
    from wardhall.queries import project
    from wardhall.sources.store import Store

    t, s = project().table("ops.events"), Store(spark, str(tmp_path / "s"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.expr("if(event_id = 5, null, ts)"))
    s.commit({"e": with_retention(events, 14, F.col("ts"), F.col("event_id") % 7 == 0)})
    found = expiry.sweep(s, "e", t, "2024-01-31 12:00:00")
    days = lambda files: {f.split("__period__=")[1][:10] for f in files}
    assert max(days(found.dropped)) == "2024-01-29" and days(found.read) == {"2024-01-30", "2024-01-31", "2024-02-01"}
    assert all("__held__=false" in f for f in found.files)
    untouched = set(s.files("e")) - set(found.files)
    s.commit(rewrite={"e": (found.files, found.left)})
    s.purge(["e"])
    assert untouched < set(s.files("e")) and not any(os.path.exists(f.removeprefix("file:")) for f in found.files)
    over = events.filter("ts + interval 14 days <= timestamp_ntz'2024-01-31 12:00:00' and event_id % 7 <> 0").count()
    assert s.read("e").count() == events.count() - over == events.count() - found.rows
    assert expiry.sweep(s, "e", t, "2024-01-31 12:00:00").rows == 0
    t.erase_strategy = "nullify"
    found = expiry.sweep(s, "e", t, "2024-02-05 00:00:00")
    assert not found.dropped and found.rows
    s.commit(rewrite={"e": (found.files, found.left)})
    assert expiry.sweep(s, "e", t, "2024-02-05 00:00:00").rows == 0 and s.read("e").filter(f"{EXPIRES} is null").count() == 1


# --- the access log -----------------------------------------------------------------------------------------------


@pytest.mark.filterwarnings("ignore")
def test_reads_are_logged_when_rows_are_read(spark, engine):
    from wardhall.operators.audit import LOG

    log = lambda: sorted((r["principal"], r["row_count"]) for r in engine.store.read(LOG).filter("action = 'select'").collect()) if engine.log_reads() >= 0 and _logged(engine) else []
    seen = engine.table("boss", "hr.people")
    engine.sql("boss", "SELECT * FROM hr_people")
    assert log() == []
    plan = seen.filter("id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan  # without a count, predicates reach the scan
    seen.filter("id > 1").count()
    with pytest.raises(Exception):  # noqa: B017, PT011
        seen.select(F.raise_error(F.lit("broken"))).collect()
    assert log() == [("boss", None)]
    engine.count_reads = True
    engine.table("clerk", "hr.people").filter("id = 3").collect()
    engine.sql("clerk", "SELECT id FROM hr_people WHERE id = 3").collect()
    engine.table("boss", "hr.notes").collect()  # not audited
    assert log() == [("boss", None), ("clerk", 1), ("clerk", 2)]
    assert log() == [("boss", None), ("clerk", 1), ("clerk", 2)]
    engine._reads.close()


@pytest.mark.filterwarnings("ignore")
def test_the_audit_role_reads_the_log(spark, tmp_path):
    from wardhall.engine import Engine
    from wardhall.model import Role

    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    e.store.commit({"hr.people": spark.createDataFrame([(1, "a", "b", 2)], "id long, name string, team string, salary int"), "hr.notes": spark.createDataFrame([], "note long, person long, body string")})
    p = shop()
    p.roles += [Role("audit", on=p.role("self").on), Role("eve", can_login=True, member_of=["audit"])]
    e.attach(e.build(p, str(tmp_path / "o"), "p"))
    e.table("boss", "hr.people").count()
    assert [r["action"] for r in e.access_log("eve").collect()] == ["select"]
    assert sorted(r["action"] for r in e.access_log("boss").collect()) == ["audit", "select"]
    with pytest.raises(AccessDenied):
        e.access_log("clerk")


def _logged(engine):
    return os.path.isdir(f"{engine.store.root}/records")


# --- retention by timers ------------------------------------------------------------------------------------------


def _brute_timers(runs):
    """(key, expiry) of what goes, when each run is one batch and the last is followed by one without messages."""
    expires, held, now, out = {}, set(), 0, []
    for batch in [*runs, []]:
        for key, kind, at, ms in sorted((m for m in batch if m[0] is not None), key=lambda m: (m[2], m[1])):
            if kind == "row":
                expires[key] = 2**62 if ms is None else max(0, ms)
            else:
                held.add(key) if kind == "hold" else held.discard(key)
        over = {k: t for k, t in expires.items() if t <= now and k not in held}
        out += over.items()
        expires = {k: t for k, t in expires.items() if k not in over}
        now = max([now, *[m[2] for m in batch if m[0] is not None]])
    return sorted(out)


def test_timers_of_blocks(spark, tmp_path):
    """Rows that come again, holds before and after rows, releases, below zero, at the very moment: three runs, with an entry of state for 128 keys."""
    import random

    from wardhall.streaming.timers import expiring, run_to_end

    rnd = random.Random(5)
    keys, runs, schema = range(-1500, 1500), [], "key long, kind string, at timestamp, expires_ms long"
    for run in range(3):
        start = 1_000_000 * (run + 1)
        some = [(k, "row", start + 1 + 3 * (k + 1500), rnd.choice([None, -5, 1_005_000, 1_500_000, 2_005_000, 2_500_000, 3_010_000, 9_000_000])) for k in (keys if run == 0 else rnd.sample(keys, 300))]
        some += [(k, kind, start + 2 + 3 * (k + 1500) + rnd.choice([-2, 0]), None) for kind in ("hold", "release") for k in rnd.sample(keys, 600)]
        runs.append([*some, (None, "row", start + 5, 0), (0, "release", start + 10_000, None)])
    runs[0][:2] = [(keys[0], "row", 1_000_001, 1_010_000), (keys[1], "row", 1_000_004, 1_010_001)]  # the greatest moment of the first run, and just after
    os.mkdir(tmp_path / "in")
    sent = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for n, some in enumerate(runs):
        stamps = spark.createDataFrame(some, "key long, kind string, ms long, expires_ms long").select("key", "kind", F.timestamp_millis("ms").alias("at"), "expires_ms")
        stamps.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        run_to_end(expiring(sent, block_bits=7), str(tmp_path / "out"), str(tmp_path / "checkpoint"), more=n < 2)
    assert sorted(map(tuple, spark.read.schema("key long, expired_at long").parquet(str(tmp_path / "out")).collect())) == _brute_timers(runs)
    state = spark.read.format("statestore").option("stateVarName", "block").option("batchId", 0).load(str(tmp_path / "checkpoint"))
    assert 0 < state.count() <= 24


# --- questions at the command line --------------------------------------------------------------------------------


@pytest.mark.filterwarnings("ignore")
def test_questions_at_the_command_line(engine, tmp_path, capsys, monkeypatch):
    import sys

    from wardhall.cli import main

    model = tmp_path / "model.py"
    model.write_text("import json, sys\nasked = json.load(sys.stdin)\nprint('SELECT count(*) AS people FROM hr_people;' if 'SELECT' in asked['instructions'] else 'there are three of them')")
    args = ["ask", "how many?", "--store", engine.store.root, "--principal", "boss", "--model", f"{sys.executable} {model}"]
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert main(args) == 0
    shown = capsys.readouterr().out
    assert "SELECT count(*) AS people FROM hr_people" in shown and "|people|" not in shown
    assert main([*args, "--yes", "--words"]) == 0
    shown = capsys.readouterr().out
    assert "|people|" in shown and "|3     |" in shown and "there are three of them" in shown
    assert main([*args[:-1], f"{sys.executable} -c 1/0"]) == 1
    model.write_text("print('DROP VIEW hr_people')")
    assert main([*args, "--yes"]) == 1


@pytest.mark.filterwarnings("ignore")
def test_whoever_acts_on_the_store_is_named(engine):
    engine.principal = None
    for call in (lambda: engine.erase_apply(["id"], ["1"]), lambda: engine.sweep(), lambda: engine.detach("drop", confirmed=True)):
        with pytest.raises(AccessDenied):
            call()
    assert engine.erase_apply(["colour"], ["1"], principal="boss") == []
