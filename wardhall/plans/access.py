"""Who may do what: membership, clearances, grants.  Decided on the driver, before any plan is built."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from ..model import AccessDenied, Column, Project, Role, Schema, Table


def membership(project: Project, name: str) -> list[Role]:
    """A role and all that it is a member of, directly or not; cycles are harmless."""
    out: dict[str, Role] = {}
    stack = [name]
    while stack:
        role = project.role(stack.pop())
        if role.name not in out:
            out[role.name] = role
            stack += reversed(role.member_of)
    return list(out.values())


def visible(role: Role, column: Column) -> bool:
    """Clearance high enough, and sensitive only to those who may."""
    return role.clearance >= column.clearance and (not column.sensitive or role.can_access_sensitive)


@dataclass
class Access:
    """What a principal may do with a table: privileges by column, and whether row policies pass it by."""

    principal: str
    roles: set[str]
    privileges: set[str] = field(default_factory=set)
    columns: dict[str, set[str]] = field(default_factory=dict)
    owner: bool = False
    bypass_rows: bool = False

    def readable(self, table: Table) -> list[Column]:
        """Columns in declared order; virtual ones cannot be selected."""
        return [c for c in table.columns if not c.virtual and c.name in self.columns.get("select", set())]

    def require(self, privilege: str, columns: list[str] | None = None) -> None:
        if privilege not in self.privileges:
            raise AccessDenied(f"{self.principal} lacks {privilege}")
        missing = set(columns or []) - self.columns.get(privilege, set())
        if missing:
            raise AccessDenied(f"{self.principal} lacks {privilege} on {', '.join(sorted(missing))}")


def access(project: Project, principal: str, schema: Schema, table: Table) -> Access:
    """Grants of the principal and of every role that it belongs to, each cut down by that role's own clearance.

    Clearance is not inherited.  A table above a role's clearance, or without any visible column, gives that role
    nothing.  The owner reads all columns, masked as for everybody.
    """
    roles = membership(project, principal)
    out = Access(principal, {r.name for r in roles})
    out.owner = project.database.owner in out.roles if project.database.owner else False
    everything = {c.name for c in table.columns}
    for role in roles:
        for on in role.on:
            if on.name != schema.name or not on.usage:
                continue
            for grant in on.tables:
                if grant.name != table.name or role.clearance < table.clearance:
                    continue
                shown = everything if out.owner else {c.name for c in table.columns if visible(role, c)}
                if not shown:
                    continue
                given = set(grant.privileges)
                if "maintain" in given and not (role.can_maintain and project.database.major >= 16):
                    warnings.warn(f"{role.name}: maintain needs version 16 and a maintaining role", stacklevel=2)
                    given.discard("maintain")
                if "insert" in given and shown != everything:
                    warnings.warn(f"{role.name} may insert into {table.name} but not see all of its columns", stacklevel=2)
                out.privileges |= given
                for p in given:
                    limited = p in ("select", "update", "references")
                    out.columns.setdefault(p, set()).update(shown if limited else everything)
                for p, names in grant.column_grants.items():
                    out.privileges.add(p)
                    out.columns.setdefault(p, set()).update(set(names) & shown)
    if out.owner:
        out.privileges |= {"select", "insert", "update", "delete", "truncate"}
        for p in ("select", "insert", "update", "delete", "truncate"):
            out.columns[p] = set(everything)
    out.bypass_rows = any(r.can_admin for r in roles) or (out.owner and not table.rls_force)
    return out


def sensitive_warnings(project: Project) -> list[str]:
    """Sensitive columns without a mask, and projects in which every role may see sensitive data."""
    out = [f"{s.name}.{t.name}.{c.name} is sensitive but not masked" for s, t in project.tables() for c in t.columns if c.sensitive and c.masking_strategy == "none"]
    if project.roles and all(r.can_access_sensitive for r in project.roles) and any(c.sensitive for _, t in project.tables() for c in t.columns):
        out.append("every role may see sensitive columns")
    return out


def grants(project: Project) -> list[tuple[str, str, str | None, str | None, str]]:
    """(role, schema, table, column, privilege), as declared and cut down: column rows only where not all columns are shown."""
    out: list[tuple[str, str, str | None, str | None, str]] = []
    known = {s.name: s for s in project.schemas}
    for role in project.roles:
        for on in role.on:
            if on.name not in known:
                continue
            out += [(role.name, on.name, None, None, p) for p, yes in (("usage", on.usage), ("create", on.create)) if yes]
            for grant in on.tables:
                table = next((t for t in known[on.name].tables if t.name == grant.name), None)
                if table is None or role.clearance < table.clearance:
                    continue
                shown = [c.name for c in table.columns if visible(role, c)]
                if not shown:
                    continue
                for p in sorted(grant.privileges):
                    if p in ("select", "update", "references") and len(shown) < len(table.columns):
                        out += [(role.name, on.name, table.name, c, p) for c in shown]
                    else:
                        out.append((role.name, on.name, table.name, None, p))
    return out
