"""Specifications in YAML: reading, writing, checksums."""

from __future__ import annotations

import hashlib
import json
from dataclasses import fields
from typing import Any

import yaml

from ..model import NAME_LISTS, PRIVILEGES, Column, Database, ForeignKey, GovernanceError, Index, Mask, Project, Role, RowPolicy, Schema, SchemaGrant, Table, TableGrant


class _Loader(yaml.SafeLoader):
    """Booleans are true and false only, so that a key ``on`` stays text."""


_Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", __import__("re").compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


class _Dumper(yaml.SafeDumper):
    """Quotes what older YAML readers would take for booleans."""

    def ignore_aliases(self, data: Any) -> bool:
        return True


def _known(cls: type, given: dict, where: str, extra: tuple[str, ...] = ()) -> dict:
    names = {f.name for f in fields(cls)} | set(extra)
    if unknown := set(given) - names:
        raise GovernanceError(f"{where}: unknown {', '.join(sorted(unknown))}")
    return given


def _mask(strategy: str, given: dict | None) -> Mask | None:
    if given is None:
        return None
    given = dict(given)
    kind = given.pop("type", strategy if strategy != "none" else "full")
    char = "*" if kind == "name" else "X"
    return Mask(**_known(Mask, {"strategy": kind, "mask_char": char} | given, "mask_config"))


def _column(given: dict) -> Column:
    given = dict(given)
    mask = _mask(given.get("masking_strategy", "none"), given.pop("mask_config", None))
    out = Column(**_known(Column, given, f"column {given.get('name')}"))
    out.mask_config = mask
    return out


def _table(given: dict) -> Table:
    given = dict(given)
    parts = {n: given.pop(n, None) or [] for n in ("columns", "indexes", "foreign_keys", "rls_policies")}
    out = Table(**_known(Table, given, f"table {given.get('name')}"))
    out.columns = [_column(c) for c in parts["columns"]]
    out.indexes = [Index(**_known(Index, dict(i), "index")) for i in parts["indexes"]]
    out.foreign_keys = [ForeignKey(**_known(ForeignKey, dict(f), "foreign key")) for f in parts["foreign_keys"]]
    out.rls_policies = [RowPolicy(**_known(RowPolicy, dict(p), "row policy")) for p in parts["rls_policies"]]
    return out


def _schema(given: dict) -> Schema:
    given = dict(given)
    tables = given.pop("tables", None) or []
    names = {n: list(given.pop(n) or []) for n in NAME_LISTS if n in given}
    out = Schema(**_known(Schema, given, f"schema {given.get('name')}"))
    out.tables, out.names = [_table(t) for t in tables], {n: v for n, v in names.items() if v}
    return out


def _role(given: dict) -> Role:
    given = dict(given)
    on = given.pop("on", None) or []
    out = Role(**_known(Role, given, f"role {given.get('name')}"))
    for g in on:
        g = dict(g)
        tables = g.pop("tables", None) or []
        grant = SchemaGrant(**_known(SchemaGrant, g, "schema grant"))
        grant.tables = [TableGrant(**_known(TableGrant, dict(t), "table grant")) for t in tables]
        out.on.append(grant)
    return out


def loads(text: str) -> Project:
    """A project from YAML text; unknown keys and shapes raise."""
    try:
        given = yaml.load(text, Loader=_Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise GovernanceError(f"not YAML: {e}") from None
    if not isinstance(given, dict) or "database" not in given:
        raise GovernanceError("a specification is a mapping with a database")
    try:
        return from_dict(given)
    except TypeError as e:
        raise GovernanceError(f"the specification lacks something: {e}") from None


def load(path: str) -> Project:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def from_dict(given: dict) -> Project:
    database = dict(given["database"])
    if "version" in database:
        database["version"] = str(database["version"])
    return Project(Database(**_known(Database, database, "database")), [_schema(s) for s in given.get("schemas") or []], [_role(r) for r in given.get("roles") or []])


def _short(obj: Any, keep: tuple[str, ...] = ("name",), skip: tuple[str, ...] = ()) -> dict:
    """Fields that differ from their defaults, in declared order."""
    out = {}
    for f in fields(obj):
        if f.name in skip:
            continue
        value = getattr(obj, f.name)
        default = f.default_factory() if callable(f.default_factory) else f.default  # type: ignore[misc]
        if f.name in keep or (value != default and value not in (None, [], {})):
            out[f.name] = value
    return out


def to_dict(project: Project) -> dict:
    """The same as plain data, in a fixed order, without what is at its default."""

    def column(c: Column) -> dict:
        out = _short(c, ("name", "type"), ("mask_config",))
        if c.mask_config is not None:
            out["mask_config"] = {"type": c.mask_config.strategy} | c.mask_config.parameters()
        return out

    def table(t: Table) -> dict:
        out = _short(t, ("name",), ("columns", "indexes", "foreign_keys", "rls_policies"))
        for name, rows in (("columns", [column(c) for c in t.columns]), ("indexes", [_short(i, ("name", "columns")) for i in t.indexes]), ("foreign_keys", [_short(f) for f in t.foreign_keys]), ("rls_policies", [_short(p, ("roles", "using_expr")) for p in t.rls_policies])):
            if rows:
                out[name] = rows
        return out

    def schema(s: Schema) -> dict:
        return _short(s, ("name",), ("tables", "names")) | ({"tables": [table(t) for t in s.tables]} if s.tables else {}) | {n: list(s.names[n]) for n in NAME_LISTS if s.names.get(n)}

    def role(r: Role) -> dict:
        out = _short(r, ("name",), ("on",))
        if r.on:
            out["on"] = [_short(g, ("name",), ("tables",)) | ({"tables": [_short(t, ("name",), ("column_grants",)) for t in g.tables]} if g.tables else {}) for g in r.on]
        return out

    return {"database": _short(project.database)} | {"schemas": [schema(s) for s in project.schemas], "roles": [role(r) for r in project.roles]}


def dumps(project: Project) -> str:
    """YAML text; the same project always gives the same text, and reading it gives the project back."""
    return yaml.dump(to_dict(project), Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=10_000)


def checksum(project: Project) -> str:
    return hashlib.sha256(dumps(project).encode()).hexdigest()


def object_checksum(obj: Any) -> str:
    """16 hex digits over one object's declared values."""
    plain = json.dumps(obj if isinstance(obj, dict) else _short(obj, ()), sort_keys=True, default=lambda o: _short(o, ()))
    return hashlib.sha256(plain.encode()).hexdigest()[:16]


__all__ = ["PRIVILEGES", "checksum", "dumps", "from_dict", "load", "loads", "object_checksum", "to_dict"]
