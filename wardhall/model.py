"""The declared model: a project of schemas, tables, columns, roles and policies.  Plain data, no Spark."""

from __future__ import annotations

import enum
from collections.abc import Iterator
from dataclasses import dataclass, field

# The vocabulary of a specification.
ENGINES = ("postgres", "mysql", "mssql", "oracle", "sqlite", "snowflake")
AUDIT_LEVELS = ("none", "read", "write", "function", "role", "ddl", "misc")
MASKS = ("none", "full", "partial", "hash", "email", "phone", "credit_card", "ip_address", "name")
SIDES = ("left", "right")
STORAGE = ("stored", "virtual")
INDEX_TYPES = ("btree", "hash", "gin", "gist", "brin")
ERASE = ("delete", "nullify", "obfuscate")
HASHES = ("xxhash", "sha256", "sha512", "hmac256")
PRIVILEGES = ("select", "insert", "update", "delete", "truncate", "references", "trigger", "maintain")
NAME_LISTS = (
    "aggregates", "collations", "domains", "foreign_tables", "fts_configurations", "fts_dictionaries", "fts_parsers", "fts_templates", "functions",
    "materialized_views", "operators", "procedures", "sequences", "trigger_functions", "types", "views",
)

#: Live rows of a versioned table carry this end; Spark has no infinite timestamp.
FOREVER = "9999-12-31 23:59:59.999999"
VALID_FROM, VALID_TO = "__valid_from__", "__valid_to__"
EXPIRES, ON_EXPIRY = "__expires_at__", "__erase_on_expiry__"
SYSTEM_COLUMNS = (VALID_FROM, VALID_TO, EXPIRES, ON_EXPIRY)
ERASED = "[ERASED]"


class GovernanceError(Exception):
    """A rule of the model or of the engine is broken."""


class ValidationError(GovernanceError):
    """All broken rules of a specification, at once."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


class AccessDenied(GovernanceError):
    """A principal asked for something that its roles don't give."""


class Kind(str, enum.Enum):
    ADDED = "added"
    REMOVED = "removed"
    MODIFIED = "modified"


@dataclass
class Mask:
    """Parameters of a mask; each strategy reads its own."""

    strategy: str = "none"
    mask_char: str = "X"
    hide_null: bool = False
    visible_length: int = 4
    visible_side: str = "right"
    algorithm: str = "xxhash"
    visible_digits: int = 4
    visible_octets: int = 2

    def parameters(self) -> dict:
        """What this strategy reads, for specifications and comparisons."""
        names = {
            "full": ("mask_char",), "partial": ("visible_length", "visible_side", "mask_char"), "hash": ("algorithm",), "email": ("mask_char",),
            "phone": ("visible_digits", "mask_char"), "credit_card": ("mask_char",), "ip_address": ("visible_octets", "mask_char"), "name": ("mask_char",),
        }.get(self.strategy, ())
        out = {n: getattr(self, n) for n in names}
        return out | ({"hide_null": True} if self.hide_null else {})


@dataclass
class Column:
    name: str
    type: str = "text"
    clearance: int = 0
    description: str | None = None
    audit_enabled: bool = True
    default: str | None = None
    unique: bool = False
    nullable: bool = True
    immutable: bool = False
    versioned: bool = False
    sensitive: bool = False
    is_subject_identifier: bool = False
    masking_strategy: str = "none"
    mask_config: Mask | None = None
    generated_expression: str | None = None
    generated_storage: str = "stored"

    @property
    def virtual(self) -> bool:
        return self.generated_expression is not None and self.generated_storage == "virtual"


@dataclass
class Index:
    name: str
    columns: list[str]
    index_type: str = "btree"
    unique: bool = False
    primary_key: bool = False
    partial_filter: str | None = None


@dataclass
class ForeignKey:
    name: str
    column: str
    referenced_schema: str
    referenced_table: str
    referenced_column: str


@dataclass
class RowPolicy:
    roles: list[str]
    using_expr: str
    check_expr: str | None = None

    @property
    def check(self) -> str:
        return self.check_expr or self.using_expr


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    clearance: int = 0
    description: str | None = None
    audit_enabled: bool = False
    erase_strategy: str | None = None
    rls_enabled: bool = False
    rls_force: bool = False
    rls_security_barrier: bool = False
    retention_days: int | None = None
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    rls_policies: list[RowPolicy] = field(default_factory=list)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def versioned(self) -> bool:
        return any(c.versioned for c in self.columns)

    @property
    def key(self) -> list[str]:
        return next((i.columns for i in self.indexes if i.primary_key), [])

    @property
    def identifiers(self) -> list[str]:
        return [c.name for c in self.columns if c.is_subject_identifier]

    @property
    def clearances(self) -> tuple[int, int]:
        """Least and greatest clearance of the columns; 0 without columns."""
        found = [c.clearance for c in self.columns] or [0]
        return min(found), max(found)


@dataclass
class Schema:
    name: str
    tables: list[Table] = field(default_factory=list)
    clearance: int = 0
    description: str | None = None
    audit_enabled: bool = True
    names: dict[str, list[str]] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    @property
    def clearances(self) -> tuple[int, int]:
        found = [t.clearances for t in self.tables] or [(0, 0)]
        return min(f[0] for f in found), max(f[1] for f in found)


@dataclass
class TableGrant:
    name: str
    select: bool = True
    insert: bool = False
    update: bool = False
    delete: bool = False
    truncate: bool = False
    references: bool = False
    trigger: bool = False
    maintain: bool = False
    column_grants: dict[str, list[str]] = field(default_factory=dict)

    @property
    def privileges(self) -> set[str]:
        return {p for p in PRIVILEGES if getattr(self, p)}


@dataclass
class SchemaGrant:
    name: str
    usage: bool = True
    create: bool = False
    tables: list[TableGrant] = field(default_factory=list)


@dataclass
class Role:
    name: str
    clearance: int = 0
    description: str | None = None
    can_login: bool = False
    can_admin: bool = False
    can_write: bool = False
    can_maintain: bool = False
    can_access_sensitive: bool = False
    member_of: list[str] = field(default_factory=list)
    on: list[SchemaGrant] = field(default_factory=list)


@dataclass
class Database:
    name: str
    description: str | None = None
    audit_enabled: bool = False
    audit_logged: list[str] = field(default_factory=lambda: ["ddl", "write"])
    host: str | None = None
    port: int = 5432
    database: str | None = None
    version: str = "14"
    engine: str = "postgres"
    profile: str | None = None
    owner: str | None = None
    retention_schedule: str | None = None

    @property
    def major(self) -> int:
        digits = self.version.strip().split(".")[0]
        return int(digits) if digits.isdigit() else 0


@dataclass
class Project:
    database: Database
    schemas: list[Schema] = field(default_factory=list)
    roles: list[Role] = field(default_factory=list)

    def schema(self, name: str) -> Schema:
        return next(s for s in self.schemas if s.name == name)

    def table(self, path: str) -> Table:
        schema, _, name = path.partition(".")
        for s in self.schemas:
            for t in s.tables:
                if s.name == schema and t.name == name:
                    return t
        raise GovernanceError(f"no table {path}")

    def role(self, name: str) -> Role:
        for r in self.roles:
            if r.name == name:
                return r
        raise AccessDenied(f"no role {name}")

    def tables(self) -> Iterator[tuple[Schema, Table]]:
        for s in self.schemas:
            for t in s.tables:
                yield s, t

    @property
    def clearances(self) -> tuple[int, int]:
        found = [s.clearances for s in self.schemas] or [(0, 0)]
        return min(f[0] for f in found), max(f[1] for f in found)
