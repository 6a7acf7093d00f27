import copy

import pytest

from wardhall.model import Column, Database, ForeignKey, GovernanceError, Index, Kind, Mask, Project, Role, RowPolicy, Schema, SchemaGrant, Table, TableGrant, ValidationError
from wardhall.operators.diff import diff, diff_frame, flattened, render
from wardhall.plans.access import access, grants, membership
from wardhall.queries import project
from wardhall.sources import spec
from wardhall.validate import problems, validate


def small():
    users = Table("users", [Column("id", "bigint", nullable=False), Column("name")], indexes=[Index("pk", ["id"], primary_key=True)])
    return Project(Database("db", owner="reader"), [Schema("public", [users])], [Role("reader", can_login=True, on=[SchemaGrant("public", tables=[TableGrant("users")])])])


def test_round_trip():
    for p in (small(), project()):
        p.schemas[0].names = {"views": ["v"], "operators": ["+(integer,integer)"]}
        again = spec.loads(spec.dumps(p))
        assert again == p
        assert spec.dumps(again) == spec.dumps(p)
        assert spec.checksum(again) == spec.checksum(p)


def test_yaml_reading():
    p = spec.loads("database: {name: d, version: 16.2}\nschemas: []\nroles:\n- name: r\n  on:\n  - name: s\n    usage: true\n")
    assert p.roles[0].on[0].name == "s"
    assert p.database.major == 16
    for bad in ("a: [", "x: 1", "database: {name: d, colour: red}", "database: {}"):
        with pytest.raises(GovernanceError):
            spec.loads(bad)
    assert spec.loads("database: {name: d}\nschemas: [{name: s, tables: [{name: t, columns: [{name: c, masking_strategy: name, mask_config: {type: name}}]}]}]").schemas[0].tables[0].columns[0].mask_config == Mask("name", "*")


def broken(change):
    p = small()
    change(p)
    return problems(p)


CASES = {
    "needs a schema": lambda p: p.schemas.clear(),
    "needs a role": lambda p: p.roles.clear(),
    "logs nothing": lambda p: (setattr(p.database, "audit_enabled", True), setattr(p.database, "audit_logged", [])),
    "needs auditing of the database": lambda p: setattr(p.schemas[0].tables[0], "audit_enabled", True),
    "needs an erase strategy": lambda p: setattr(p.schemas[0].tables[0].columns[0], "is_subject_identifier", True),
    "needs a subject identifier": lambda p: setattr(p.schemas[0].tables[0], "erase_strategy", "delete"),
    "without row security": lambda p: p.schemas[0].tables[0].rls_policies.append(RowPolicy(["reader"], "true")),
    "is empty": lambda p: (setattr(p.schemas[0].tables[0], "rls_enabled", True), p.schemas[0].tables[0].rls_policies.append(RowPolicy(["reader"], " "))),
    "names no role": lambda p: (setattr(p.schemas[0].tables[0], "rls_enabled", True), p.schemas[0].tables[0].rls_policies.append(RowPolicy([], "true"))),
    "unknown role nobody": lambda p: (setattr(p.schemas[0].tables[0], "rls_enabled", True), p.schemas[0].tables[0].rls_policies.append(RowPolicy(["nobody"], "true"))),
    "retention of 0 days": lambda p: setattr(p.schemas[0].tables[0], "retention_days", 0),
    "retention needs": lambda p: setattr(p.schemas[0].tables[0], "retention_days", 3),
    "reserved name": lambda p: p.schemas[0].tables[0].columns.append(Column("__valid_to__")),
    "schema public is declared twice": lambda p: p.schemas.append(copy.deepcopy(p.schemas[0])),
    "has no table": lambda p: p.schemas[0].tables.clear(),
    "table public.users is declared twice": lambda p: p.schemas[0].tables.append(copy.deepcopy(p.schemas[0].tables[0])),
    "has no column": lambda p: p.schemas[0].tables[0].columns.clear(),
    "column id is declared twice": lambda p: p.schemas[0].tables[0].columns.append(Column("id")),
    "index pk is declared twice": lambda p: p.schemas[0].tables[0].indexes.append(Index("pk", ["id"])),
    "primary keys": lambda p: p.schemas[0].tables[0].indexes.append(Index("pk2", ["id"], primary_key=True)),
    "has no primary key": lambda p: p.schemas[0].tables[0].indexes.clear(),
    "generated and has a default": lambda p: p.schemas[0].tables[0].columns.append(Column("g", generated_expression="1", default="1")),
    "generated and versioned": lambda p: p.schemas[0].tables[0].columns.append(Column("g", generated_expression="1", versioned=True)),
    "versioned and immutable": lambda p: p.schemas[0].tables[0].columns.append(Column("g", immutable=True, versioned=True)),
    "configuration without a mask": lambda p: setattr(p.schemas[0].tables[0].columns[1], "mask_config", Mask("full")),
    "lacks its configuration": lambda p: setattr(p.schemas[0].tables[0].columns[1], "masking_strategy", "full"),
    "configuration for a full mask": lambda p: (setattr(p.schemas[0].tables[0].columns[1], "masking_strategy", "full"), setattr(p.schemas[0].tables[0].columns[1], "mask_config", Mask("email"))),
    "octets": lambda p: (setattr(p.schemas[0].tables[0].columns[1], "masking_strategy", "ip_address"), setattr(p.schemas[0].tables[0].columns[1], "mask_config", Mask("ip_address", visible_octets=4))),
    "unknown column nope": lambda p: p.schemas[0].tables[0].indexes.append(Index("i", ["nope"])),
    "unknown schema x": lambda p: p.schemas[0].tables[0].foreign_keys.append(ForeignKey("f", "id", "x", "users", "id")),
    "unknown table x": lambda p: p.schemas[0].tables[0].foreign_keys.append(ForeignKey("f", "id", "public", "x", "id")),
    "refers to the unknown column x": lambda p: p.schemas[0].tables[0].foreign_keys.append(ForeignKey("f", "id", "public", "users", "x")),
    "f has the unknown column x": lambda p: p.schemas[0].tables[0].foreign_keys.append(ForeignKey("f", "x", "public", "users", "id")),
    "below its table's": lambda p: setattr(p.schemas[0].tables[0], "clearance", 2),
    "no role reaches": lambda p: setattr(p.schemas[0].tables[0].columns[1], "clearance", 9),
    "no role is as low": lambda p: setattr(p.roles[0], "clearance", 5),
    "role reader is declared twice": lambda p: p.roles.append(copy.deepcopy(p.roles[0])),
    "neither a schema nor a parent": lambda p: p.roles[0].on.clear(),
    "unknown schema nowhere": lambda p: setattr(p.roles[0].on[0], "name", "nowhere"),
    "unknown parent": lambda p: p.roles[0].member_of.append("ghost"),
    "no role can log in": lambda p: setattr(p.roles[0], "can_login", False),
    "versioned table": lambda p: (p.schemas[0].tables[0].columns[1].__setattr__("versioned", True), p.schemas[0].tables[0].foreign_keys.append(ForeignKey("f", "id", "public", "users", "id"))),
}


@pytest.mark.parametrize("message", sorted(CASES))
def test_errors(message):
    errors, _ = broken(CASES[message])
    assert any(message in e for e in errors), errors


def test_valid_and_warnings():
    assert problems(small()) == ([], [])
    p = small()
    p.database.retention_schedule = "0 3 * * *"
    p.schemas[0].tables[0].columns[1].sensitive = True
    p.roles[0].can_access_sensitive = True
    notes = problems(p)[1]
    assert len(notes) == 3
    p.roles.clear()
    p.schemas[0].tables[0].indexes.clear()
    with pytest.warns(UserWarning), pytest.raises(ValidationError) as e:
        validate(p)
    assert len(e.value.problems) >= 2


def test_diff_and_report(spark):
    before, after = small(), small()
    assert diff(before, after) == []
    users = after.schemas[0].tables[0]
    users.columns[1].type = "varchar"
    users.columns.append(Column("extra"))
    after.schemas.append(Schema("sales", [Table("orders", [Column("id")])]))
    after.roles[0].can_admin = True
    users.rls_policies.append(RowPolicy(["reader"], "true"))
    changes = diff(before, after)
    assert {(c.kind, c.object_type, c.path, c.field) for c in changes} == {
        (Kind.MODIFIED, "column", "public.users.name", "type"), (Kind.ADDED, "column", "public.users.extra", None), (Kind.ADDED, "schema", "sales", None),
        (Kind.MODIFIED, "role", "reader", "can_admin"), (Kind.ADDED, "rls_policy", "public.users[0]", None),
    }
    rows = diff_frame(flattened(spark, before), flattened(spark, after)).collect()
    assert {(r[0], r[1], r[2], r[3]) for r in rows} == {(c.kind.value, c.object_type, c.path, c.field) for c in changes}
    text = render(changes)
    assert "3 added, 0 removed, 2 modified" in text
    assert "| public.users.name | type | text | varchar |" in text
    assert "x" * 57 + "..." in render([c for c in diff(small(), _long())])


def _long():
    p = small()
    p.database.owner = "x" * 100
    return p


def test_access():
    p = project()
    assert [r.name for r in membership(p, "clerk")] == ["clerk", "analyst", "reader"]
    s, t = p.schema("sales"), p.table("sales.customer")
    clerk = access(p, "clerk", s, t)
    assert [c.name for c in clerk.readable(t)] == ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    with pytest.raises(GovernanceError):
        clerk.require("select", ["c_acctbal"])
    with pytest.raises(GovernanceError):
        clerk.require("update")
    with pytest.raises(GovernanceError):
        access(p, "nobody", s, t)
    assert ("auditor", "sales", "orders", None, "update") in grants(p)
