"""Rules of a specification.  Errors are collected and raised together; warnings are returned and warned."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from .model import AUDIT_LEVELS, ENGINES, ERASE, HASHES, INDEX_TYPES, MASKS, SIDES, STORAGE, SYSTEM_COLUMNS, Column, Project, Schema, Table, ValidationError
from .plans.access import sensitive_warnings

Found = Iterator[tuple[str, str]]  # ("E" or "W", message)
_TEXT = ("text", "varchar", "char", "character varying")


def _twice(names: Iterable[str]) -> list[str]:
    return [n for n, k in Counter(names).items() if k > 1]


def _project(p: Project) -> Found:
    if not p.schemas:
        yield "E", "a project needs a schema"
    if not p.roles:
        yield "E", "a project needs a role"
    for kind, names in (("schema", [s.name for s in p.schemas]), ("role", [r.name for r in p.roles])):
        for n in _twice(names):
            yield "E", f"{kind} {n} is declared twice"
    if p.database.engine not in ENGINES:
        yield "E", f"unknown engine {p.database.engine}"
    for level in p.database.audit_logged:
        if level not in AUDIT_LEVELS:
            yield "E", f"unknown audit level {level}"


def _audit(p: Project) -> Found:
    if p.database.audit_enabled and not p.database.audit_logged:
        yield "E", "auditing is on but logs nothing"
    for s, t in p.tables():
        if t.audit_enabled and not p.database.audit_enabled:
            yield "E", f"{s.name}.{t.name}: auditing needs auditing of the database"


def _subjects(p: Project) -> Found:
    strategies = {(s.name, t.name): t for s, t in p.tables()}
    for s, t in p.tables():
        at = f"{s.name}.{t.name}"
        if t.identifiers and not t.erase_strategy:
            yield "E", f"{at}: a subject identifier needs an erase strategy"
        if t.erase_strategy and not t.identifiers:
            yield "E", f"{at}: an erase strategy needs a subject identifier"
        if t.erase_strategy and t.erase_strategy not in ERASE:
            yield "E", f"{at}: unknown erase strategy {t.erase_strategy}"
        if t.erase_strategy == "obfuscate":
            for c in t.columns:
                if not c.nullable and not c.is_subject_identifier and not c.type.strip().lower().startswith(_TEXT):
                    yield "W", f"{at}.{c.name}: obfuscating a required {c.type} may fail"
        for f in t.foreign_keys:
            other = strategies.get((f.referenced_schema, f.referenced_table))
            if other is not None and other is not t and other.identifiers and not t.erase_strategy:
                yield "E", f"{at}: it refers to the subjects of {f.referenced_table} and needs an erase strategy"


def _history(p: Project) -> Found:
    tables = {(s.name, t.name): t for s, t in p.tables()}
    for s, t in p.tables():
        for f in t.foreign_keys:
            other = tables.get((f.referenced_schema, f.referenced_table))
            if other is not None and other.versioned:
                yield "E", f"{s.name}.{t.name}: {f.name} refers to the versioned table {other.name}, whose key repeats"


def _rows(p: Project) -> Found:
    roles = {r.name for r in p.roles}
    for s, t in p.tables():
        at = f"{s.name}.{t.name}"
        if not t.rls_enabled:
            for what, has in (("policies", bool(t.rls_policies)), ("force", t.rls_force), ("a barrier", t.rls_security_barrier)):
                if has:
                    yield "E", f"{at}: {what} without row security"
        elif p.database.major < 15:
            yield "W", f"{at}: row security through views needs version 15"
        for i, policy in enumerate(t.rls_policies):
            if not policy.using_expr.strip():
                yield "E", f"{at}: policy {i} is empty"
            if not policy.roles:
                yield "E", f"{at}: policy {i} names no role"
            for r in policy.roles:
                if r != "PUBLIC" and r not in roles:
                    yield "E", f"{at}: policy {i} names the unknown role {r}"


def _retention(p: Project) -> Found:
    kept = [f"{s.name}.{t.name}" for s, t in p.tables() if t.retention_days is not None]
    for s, t in p.tables():
        at = f"{s.name}.{t.name}"
        if t.retention_days is not None:
            if t.retention_days <= 0:
                yield "E", f"{at}: retention of {t.retention_days} days"
            if not t.erase_strategy:
                yield "E", f"{at}: retention needs an erase strategy"
        for c in t.columns:
            if c.name in SYSTEM_COLUMNS:
                yield "E", f"{at}.{c.name} is a reserved name"
    if p.database.retention_schedule and not kept:
        yield "W", "a retention schedule, but no table with retention"
    if kept and not p.database.retention_schedule:
        yield "W", f"no retention schedule for {', '.join(kept)}"


def _tables(p: Project) -> Found:
    for s in p.schemas:
        if not s.tables:
            yield "E", f"schema {s.name} has no table"
        for n in _twice(t.name for t in s.tables):
            yield "E", f"table {s.name}.{n} is declared twice"
        for t in s.tables:
            at = f"{s.name}.{t.name}"
            if not t.columns:
                yield "E", f"{at} has no column"
            for n in _twice(c.name for c in t.columns):
                yield "E", f"{at}: column {n} is declared twice"
            for n in _twice(i.name for i in t.indexes):
                yield "E", f"{at}: index {n} is declared twice"
            keys = [i for i in t.indexes if i.primary_key]
            if len(keys) > 1:
                yield "E", f"{at} has {len(keys)} primary keys"
            if not keys:
                yield "E", f"{at} has no primary key"
            yield from _references(p, s, t)
            for c in t.columns:
                yield from _column(at, c)


def _references(p: Project, s: Schema, t: Table) -> Found:
    names, at = {c.name for c in t.columns}, f"{s.name}.{t.name}"
    for i in t.indexes:
        if i.index_type not in INDEX_TYPES:
            yield "E", f"{at}: unknown index type {i.index_type}"
        for c in i.columns:
            if c not in names:
                yield "E", f"{at}: index {i.name} has the unknown column {c}"
    for f in t.foreign_keys:
        if f.column not in names:
            yield "E", f"{at}: {f.name} has the unknown column {f.column}"
        schema = next((x for x in p.schemas if x.name == f.referenced_schema), None)
        table = schema and next((x for x in schema.tables if x.name == f.referenced_table), None)
        if schema is None:
            yield "E", f"{at}: {f.name} refers to the unknown schema {f.referenced_schema}"
        elif table is None:
            yield "E", f"{at}: {f.name} refers to the unknown table {f.referenced_table}"
        elif f.referenced_column not in {c.name for c in table.columns}:
            yield "E", f"{at}: {f.name} refers to the unknown column {f.referenced_column}"


def _column(table: str, c: Column) -> Found:
    at = f"{table}.{c.name}"
    if c.generated_expression and c.default is not None:
        yield "E", f"{at} is generated and has a default"
    if c.generated_expression and c.versioned:
        yield "E", f"{at} is generated and versioned"
    if c.generated_storage not in STORAGE:
        yield "E", f"{at}: unknown storage {c.generated_storage}"
    if c.versioned and c.immutable:
        yield "E", f"{at} is versioned and immutable"
    m = c.mask_config
    if c.masking_strategy not in MASKS:
        yield "E", f"{at}: unknown mask {c.masking_strategy}"
    elif c.masking_strategy == "none":
        if m is not None:
            yield "E", f"{at}: a mask configuration without a mask"
    elif m is None:
        yield "E", f"{at}: the {c.masking_strategy} mask lacks its configuration"
    elif m.strategy != c.masking_strategy:
        yield "E", f"{at}: a {m.strategy} configuration for a {c.masking_strategy} mask"
    elif m.strategy == "ip_address" and m.visible_octets not in (1, 2, 3):
        yield "E", f"{at}: an address shows 1, 2 or 3 octets"
    elif m.strategy == "hash" and m.algorithm not in HASHES:
        yield "E", f"{at}: unknown hash {m.algorithm}"
    elif m.strategy == "partial" and (m.visible_side not in SIDES or m.visible_length < 0):
        yield "E", f"{at}: a partial mask shows a side and a length"


def _clearances(p: Project) -> Found:
    for s, t in p.tables():
        floor = max(s.clearance, t.clearance)
        for c in t.columns:
            if c.clearance < floor:
                yield "E", f"{s.name}.{t.name}.{c.name}: clearance {c.clearance} below its table's {floor}"
    if p.roles:
        least, most = p.clearances
        if max(r.clearance for r in p.roles) < most:
            yield "E", f"no role reaches clearance {most}"
        if min(r.clearance for r in p.roles) > least:
            yield "E", f"no role is as low as clearance {least}"


def _roles(p: Project) -> Found:
    roles, schemas = {r.name for r in p.roles}, {s.name for s in p.schemas}
    for r in p.roles:
        if not r.on and not r.member_of:
            yield "E", f"role {r.name} has neither a schema nor a parent"
        for g in r.on:
            if g.name not in schemas:
                yield "E", f"role {r.name}: unknown schema {g.name}"
        for m in r.member_of:
            if m not in roles:
                yield "E", f"role {r.name}: unknown parent {m}"
    if p.roles and not any(r.can_login for r in p.roles):
        yield "E", "no role can log in"


RULES: tuple[Callable[[Project], Found], ...] = (_project, _audit, _subjects, _history, _rows, _retention, _tables, _clearances, _roles)


def problems(project: Project) -> tuple[list[str], list[str]]:
    """(errors, warnings) of every rule."""
    found = [x for rule in RULES for x in rule(project)]
    return [m for k, m in found if k == "E"], [m for k, m in found if k == "W"] + sensitive_warnings(project)


def validate(project: Project) -> Project:
    """The project, or one error with all that is wrong."""
    errors, notes = problems(project)
    for n in notes:
        warnings.warn(n, stacklevel=2)
    if errors:
        raise ValidationError(errors)
    return project
