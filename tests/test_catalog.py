"""Specifications from what a database or a store says of itself."""

import warnings

import pytest

from wardhall.catalog_queries import VIEWS, views
from wardhall.engine import Engine
from wardhall.model import GovernanceError
from wardhall.scenarios import _shop
from wardhall.sources import spec
from wardhall.sources.catalog import declare, inspect_store
from wardhall.sources.information_schema import inspect_database, policies


def test_a_database_as_a_project(spark):
    p = inspect_database(views(spark), "shop", "owner")
    t = p.table("sales.customer")
    assert [(c.name, c.type, c.nullable, c.unique) for c in t.columns][:3] == [("id", "bigint", False, False), ("region", "text", False, False), ("email", "character varying", True, True)]
    assert t.key == ["id", "region"] and t.rls_enabled and not t.rls_force and [x.roles for x in t.rls_policies] == [["PUBLIC"]]
    assert p.table("ops.events").rls_force and p.table("ops.events").rls_policies == []
    assert [f.name for f in p.table("sales.orders").foreign_keys] == ["orders_customer_customer", "orders_customer_region"]
    assert p.schema("sales").names["types"] == ["ENUM order_state (open, held, paid)"]
    assert p.schema("sales").names["functions"] == ["total()", "total(bigint, text)"] and p.schema("ops").names["sequences"] == ["free"]
    clerk = p.role("clerk")
    assert clerk.can_maintain and not clerk.can_admin and p.role("intern").member_of == ["analyst"]
    sales = next(g for g in clerk.on if g.name == "sales")
    assert not sales.usage and sales.tables[0].maintain and sales.tables[0].column_grants == {"update": ["state"]}
    assert "pg_toast" not in {s.name for s in p.schemas} and "pg_monitor" not in {r.name for r in p.roles}
    assert spec.checksum(spec.loads(spec.dumps(p))) == spec.checksum(p)


def test_the_standard_alone(spark):
    def read(name):
        assert not name.startswith("pg_")
        return views(spark)(name)

    p = inspect_database(read, "shop", standard_only=True)
    assert p.table("sales.customer").key == ["id", "region"] and p.roles == [] and not p.table("sales.customer").rls_enabled


def test_arrays_as_text(spark):
    def read(name):
        df = views(spark)(name)
        return df.selectExpr("schemaname", "tablename", "policyname", "concat('{', array_join(roles, ','), '}') AS roles", "qual", "with_check") if name == "pg_policies" else df

    assert policies(read).filter("name = 'mine'").first()["roles"] == ["PUBLIC"]


def test_an_empty_catalog(spark):
    p = inspect_database(lambda name: spark.createDataFrame([], VIEWS[name][0]), "nothing")
    assert p.schemas == [] and p.roles == []


@pytest.mark.filterwarnings("ignore")
def test_what_is_declared_outlives_a_build(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    e.store.commit({"sales.supplier": spark.createDataFrame([(1, "a", 3, 2.0, "x")], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double, more string")})
    assert inspect_store(e.store).table("sales.supplier").key == ["s_suppkey"] and inspect_store(e.store).roles[0].name == "owner"
    known = _shop()
    known.roles = known.roles[:1]
    known.table("sales.supplier").indexes[0].columns = ["s_name"]
    declare(e.store, known)
    seen = inspect_store(e.store)
    assert seen.table("sales.supplier").key == ["s_name"] and [c.name for c in seen.table("sales.supplier").columns][-1] == "more" and [r.name for r in seen.roles] == ["clerk"]
    e.attach(e.build(_shop(), str(tmp_path / "o"), "p"))
    assert inspect_store(e.store).schemas == []
    governed = inspect_store(e.store, shadow=True)
    assert governed.table("sales.supplier").column("s_name").masking_strategy == "full" and len(governed.roles) == 2
    assert {r["role_name"] for r in e.meta()["revoked_grants"].collect()} == {"clerk"}
    e.detach(confirmed=True)
    again = inspect_store(e.store)
    assert spec.dumps(again) == spec.dumps(seen)


@pytest.mark.filterwarnings("ignore")
def test_truncation_needs_the_privilege(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    e.store.commit({"sales.supplier": spark.createDataFrame([(1, "a", 3, 2.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")})
    e.attach(e.build(_shop(), str(tmp_path / "o"), "p"))
    with pytest.raises(GovernanceError):
        e.truncate("clerk", "sales.supplier")
    e.truncate("boss", "sales.supplier")
    assert e.table("boss", "sales.supplier").count() == 0


def test_a_schedule_is_kept_not_run(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), principal="boss")
    p = _shop()
    p.table("sales.supplier").retention_days, p.database.retention_schedule = 3, "0 3 * * *"
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        e.build(p, str(tmp_path / "o"), "p")
    assert any("call sweep" in str(w.message) for w in seen) and e.capabilities == {"audit": True, "schedule": False}
