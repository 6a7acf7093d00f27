"""The engine: a store, a specification, and what principals may do with them.

Enforcement is at this interface.  Whoever holds the Spark session can read the store's files.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import warnings
from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .functions.masks import masked
from .functions.policies import related, row_check, row_filter
from .model import AccessDenied, GovernanceError, Project, Schema, Table
from .operators import audit, discover, dml, erase, expiry, images, references, reshape
from .operators.diff import Change, diff
from .plans import plain
from .plans.access import Access, access, membership
from .plans.compile import governed
from .sources import artifact, meta, spec
from .sources.catalog import SHADOW, fingerprint, inspect_store, plain_table
from .sources.store import Conflict, Store
from .validate import validate

Clock = Callable[[], dt.datetime]


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Engine:
    def __init__(self, spark: SparkSession, root: str, hmac_key: str | None = None, clock: Clock = _now, count_reads: bool = False, principal: str | None = None):
        """``principal`` acts on the whole store where a call names nobody.  ``count_reads`` has reads of audited tables logged with their rows; callers' predicates then stay above the count."""
        self.spark, self.store, self._key, self.clock, self.count_reads, self.principal = spark, Store(spark, root), hmac_key, clock, count_reads, principal
        self._reads: audit.Reads | None = None
        self.store.before_reading[audit.LOG] = self.log_reads

    # -- state -------------------------------------------------------------------------------------------------
    @property
    def project(self) -> Project:
        """The specification in force, from the newest build."""
        text = self.store.state().get("specification")
        if not text:
            raise GovernanceError("nothing is attached")
        return spec.loads(text)

    @property
    def build_id(self) -> int:
        return self.store.state().get("build_id", 0)

    def meta(self) -> dict[str, DataFrame]:
        """Metadata tables by name; those without rows are empty."""
        known = set(self.store.tables())
        return {n: meta.with_missing_columns(self.store.read(meta.PREFIX + n), s) if meta.PREFIX + n in known else self.spark.createDataFrame([], s) for n, s in meta.SCHEMAS.items()}

    def update_meta(self) -> int:
        """Metadata tables of an older release in today's shape, as one commit; returns how many were changed."""
        known = set(self.store.tables())
        old = {meta.PREFIX + n: meta.with_missing_columns(self.store.read(meta.PREFIX + n), s) for n, s in meta.SCHEMAS.items() if meta.PREFIX + n in known and self.store.read(meta.PREFIX + n).columns != s.names}
        if old:
            self.store.commit(old)
        return len(old)

    def _place(self, path: str) -> tuple[Schema, Table]:
        schema, _, _ = path.partition(".")
        project = self.project
        return project.schema(schema), project.table(path)

    def _access(self, principal: str, path: str) -> Access:
        return access(self.project, principal, *self._place(path))

    def _raw(self, path: str) -> DataFrame:
        return self.store.read(SHADOW + path)

    @property
    def capabilities(self) -> dict[str, bool]:
        """What builds may rely on: an access log, and a clock that calls ``sweep``."""
        return {"audit": True, "schedule": False}

    # -- lifecycle ---------------------------------------------------------------------------------------------
    def build(self, project: Project, folder: str, profile: str) -> str:
        """An artifact that attaches a specification to the store's public tables."""
        validate(project)
        if self.build_id:
            raise GovernanceError("a build is attached: migrate or detach it")
        if not project.database.owner:
            raise GovernanceError("the database needs an owner")
        if project.database.retention_schedule and not self.capabilities["schedule"]:
            warnings.warn("the retention schedule is kept, not run: call sweep at its times", stacklevel=2)
        current = inspect_store(self.store, project.database.name)
        have = {f"{s.name}.{t.name}" for s, t in current.tables()}
        plan = [{"step": "shadow" if f"{s.name}.{t.name}" in have else "create", "table": f"{s.name}.{t.name}", "adds": [n for n, yes in (("history", t.versioned), ("retention", bool(t.retention_days))) if yes]} for s, t in project.tables()]
        plan += [{"step": "record", "what": "metadata"}]
        about = {"kind": "build", "profile": profile, "database": project.database.name, "checksum": spec.checksum(project), "specification": spec.dumps(project), "fingerprint": fingerprint(self.store), "built_at": self.clock()}
        return artifact.write(folder, "build", profile, about, plan, self.clock())

    def migrate(self, after: Project, folder: str, profile: str) -> str:
        """An artifact that moves the attached build to another specification."""
        validate(after)
        before = self.project
        changes = diff(before, after)
        if not changes:
            raise GovernanceError("nothing has changed")
        plan: list[dict] = []
        old, new = {f"{s.name}.{t.name}": t for s, t in before.tables()}, {f"{s.name}.{t.name}": t for s, t in after.tables()}
        plan += [{"step": "drop", "table": p} for p in old if p not in new] + [{"step": "create", "table": p} for p in new if p not in old]
        plan += [{"step": "reshape", "table": p, "does": does} for p in new if p in old and (does := reshape.steps(old[p], new[p]))]
        if any(c.field in ("columns", "primary_key") and c.object_type == "index" for c in changes):
            warnings.warn("a changed key is checked, but rows that break it must be mended by hand", stacklevel=2)
        about = {
            "kind": "migrate", "profile": profile, "database": after.database.name, "checksum": spec.checksum(after), "specification": spec.dumps(after), "source_checksum": spec.checksum(before), "built_at": self.clock(),
            "changes": [[c.kind.value, c.object_type, c.path, c.field, None if c.before is None else str(c.before), None if c.after is None else str(c.after)] for c in changes],
        }
        return artifact.write(folder, "migrate", profile, about, plan, self.clock())

    def attach(self, path: str, principal: str | None = None) -> int:
        """Applies an artifact, of either kind, as one commit; returns the build's number."""
        about, _ = artifact.read(path)
        project = spec.loads(about["specification"])
        if spec.checksum(project) != about["checksum"]:
            raise GovernanceError("the artifact's specification was changed")
        if about["kind"] == "build":
            return self._attach_build(project, about, self._manager(principal, project))
        return self._attach_migration(project, about, self._manager(principal))

    def _attach_build(self, project: Project, about: dict, principal: str) -> int:
        seen = self.store.version()
        if self.build_id or any(n.startswith(SHADOW) for n in self.store.tables()):
            raise GovernanceError("a build is attached")
        if fingerprint(self.store) != about["fingerprint"]:
            raise Conflict("the tables have changed since the build")
        now = self.clock()
        replace, register, drop = {}, {}, []
        manifest = self.store.manifest()
        for s, t in project.tables():
            name = f"{s.name}.{t.name}"
            there = name in manifest["tables"]
            raw = self.store.read(name) if there else reshape.declared(self.spark, t)
            new = reshape.attached(t, raw, now)
            if there and new.columns == raw.columns:
                register[SHADOW + name] = (manifest["tables"][name]["folders"], raw.schema)
            else:
                replace[SHADOW + name] = new
            drop += [name] if there else []
        before = inspect_store(self.store, project.database.name)
        append = meta.frames(self.spark, project, 1, before)
        append[meta.PREFIX + "builds"] = meta.frame(self.spark, "builds", [meta.build_row(project, 1, "build", now, self.store.state().get("audit", []))])
        levels = audit.merged_levels(self.store.state().get("audit", []), project.database.audit_logged if project.database.audit_enabled else [])
        state = {"specification": spec.dumps(project), "build_id": 1, "audit": levels, "audit_before": self.store.state().get("audit", []), "public_before": {n: manifest["tables"][n] for n in drop}}
        append |= self._entries(project, principal, "attach", [f"{s.name}.{t.name}" for s, t in project.tables()])
        self._commit(replace, append, register, drop, state, expected=seen, project=project)
        return 1

    def _attach_migration(self, project: Project, about: dict, principal: str) -> int:
        seen = self.store.version()
        before = self.project
        if about["database"] != before.database.name:
            raise Conflict("the artifact is of another database")
        if about["source_checksum"] != spec.checksum(before):
            raise Conflict("the attached build is not the one that the migration started from")
        now, build = self.clock(), self.build_id + 1
        old, new = {f"{s.name}.{t.name}": t for s, t in before.tables()}, {f"{s.name}.{t.name}": t for s, t in project.tables()}
        replace, drop = {}, [SHADOW + p for p in old if p not in new]
        for path, t in new.items():
            if path not in old:
                replace[SHADOW + path] = reshape.attached(t, reshape.declared(self.spark, t), now)
            elif reshape.steps(old[path], t):
                df = reshape.reshaped(old[path], t, self._raw(path), now)
                if t.key and old[path].key != t.key:
                    dml.refuse(dml.duplicate_keys(t, df), f"{path}: the new key repeats")
                replace[SHADOW + path] = df
        for path, t in new.items():
            known = {(f.column, f.referenced_schema, f.referenced_table, f.referenced_column) for f in old[path].foreign_keys} if path in old else set()
            for fk in t.foreign_keys:
                if (fk.column, fk.referenced_schema, fk.referenced_table, fk.referenced_column) not in known:
                    target = f"{fk.referenced_schema}.{fk.referenced_table}"
                    rows, there = (replace[SHADOW + p] if SHADOW + p in replace else self._raw(p) for p in (path, target))
                    dml.refuse(dml.orphans(fk, rows, there), f"{path}: {fk.name} refers to nothing")
        append = meta.frames(self.spark, project, build, before)
        append[meta.PREFIX + "builds"] = meta.frame(self.spark, "builds", [meta.build_row(project, build, "migrate", now, self.store.state().get("audit_before", []))])
        append[meta.PREFIX + "migrations"] = meta.frame(self.spark, "migrations", [(build, *c) for c in about["changes"]])
        state = {"specification": spec.dumps(project), "build_id": build, "audit": audit.merged_levels(self.store.state().get("audit", []), project.database.audit_logged if project.database.audit_enabled else [])}
        append |= self._entries(project, principal, "migrate", list(new))
        self._commit(replace, append, drop=drop, state=state, expected=seen, project=project)
        return build

    def detach(self, history: str | None = None, confirmed: bool = False, principal: str | None = None) -> None:
        """Gives the tables back as plain ones, without the generated columns that governance added.

        Keys, references, policies, roles and grants are again those that were declared before; of tables that were not
        declared, and of those that governance created, what the specification says of them is kept.  ``history`` is ``keep`` or ``drop`` where a table is versioned.  The access log stays.
        """
        if not confirmed:
            raise GovernanceError("detaching needs confirmation")
        project = self.project
        if any(t.versioned for _, t in project.tables()) and history not in ("keep", "drop"):
            raise GovernanceError("say whether history is kept or dropped")
        principal = self._manager(principal)
        seen, manifest = self.store.version(), self.store.manifest()
        before = manifest["state"].get("public_before") or {}
        replace, register, drop = {}, {}, [n for n in manifest["tables"] if n.startswith((SHADOW, meta.PREFIX)) and n != audit.LOG]
        for s, t in project.tables():
            name = f"{s.name}.{t.name}"
            raw = self._raw(name)
            had = {f["name"] for f in before[name]["schema"]["fields"]} if name in before else None
            added = [c.name for c in t.columns if c.generated_expression and had is not None and c.name not in had]
            bare = reshape.detached(raw, history == "drop").drop(*added)
            if bare.columns == raw.columns:
                register[name] = (manifest["tables"][SHADOW + name]["folders"], raw.schema)
            else:
                replace[name] = bare
        entries = self._entries(project, principal, "detach", [f"{s.name}.{t.name}" for s, t in project.tables()])
        state = {"specification": None, "build_id": 0, "audit": manifest["state"].get("audit_before", []), "declared": spec.dumps(self._declared_again(project, before))}
        self.store.commit(replace, entries, register, drop, state, expected=seen)

    def _declared_again(self, project: Project, before: dict) -> Project:
        text = self.store.state().get("declared")
        out = spec.loads(text) if text else Project(project.database)
        known = {(s.name, t.name) for s, t in out.tables()}
        for s, t in project.tables():
            if (s.name, t.name) in known:
                continue
            if not any(x.name == s.name for x in out.schemas):
                out.schemas.append(Schema(s.name))
            entry = before.get(f"{s.name}.{t.name}")
            out.schema(s.name).tables.append(plain_table(t, entry and [f["name"] for f in entry["schema"]["fields"]]))
        return out

    def changes(self, after: Project) -> list[Change]:
        return diff(self.project, after)

    # -- reading -----------------------------------------------------------------------------------------------
    def table(self, principal: str, path: str, current: bool = False, columns: list[str] | None = None) -> DataFrame:
        """What a principal sees of a table.  If the table is audited, the log has an entry each time that rows are read."""
        out = governed(self.project, principal, path, self._raw(path), current, self._key, columns, self._raw)
        return self._watched(out, self.count_reads, principal, [path], out.columns)

    def _watched(self, df: DataFrame, counted: bool, principal: str, paths: list[str], columns: list[str] | None = None) -> DataFrame:
        """A frame whose readings are logged for those of the tables that are audited."""
        some = [p for p in paths if audit.audited(self.project, p, "select")]
        if not some:
            return df
        self._reads = self._reads or audit.Reads(self.spark)
        return self._reads.observed(df, counted, principal=principal, paths=some, columns=columns)

    def access_log(self, principal: str) -> DataFrame:
        """The access log, for the owner, administrators and members of the role ``audit``; looking at it is logged too."""
        if not any(r.name == audit.ROLE for r in membership(self.project, principal)):
            self._manager(principal)
        out = self.store.read(audit.LOG)
        self.store.record(audit.LOG, audit.entry(self.spark, self.clock(), principal, "audit", audit.LOG))
        return out

    def log_reads(self) -> int:
        """Puts the readings that have ended since into the access log; returns their number.  Whoever reads the log gets it so."""
        found = self._reads.taken() if self._reads else []
        entries = [audit.entry(self.spark, self.clock(), about["principal"], "select", p, about["columns"], rows) for about, rows in found for p in about["paths"]]
        if entries:
            self.store.record(audit.LOG, reduce(DataFrame.unionByName, entries).coalesce(1))
        return len(entries)

    def raw(self, principal: str, path: str) -> DataFrame:
        """The stored rows, for the owner only."""
        if not self._access(principal, path).owner:
            raise GovernanceError(f"{principal} doesn't own {path}")
        return self._raw(path)

    def sql(self, principal: str, text: str) -> DataFrame:
        """One query over the tables that a principal sees, as views ``schema_table`` and ``schema_table_current``.

        The views live in a session of their own; the text may only read them, with functions of values alone.  Audited
        tables that it names are logged, each time that its result is read, with the rows of the result.
        """
        session = self.spark.newSession()
        project = self.project
        paths: dict[str, str] = {}
        own = Store(session, self.store.root)
        stored = lambda path: own.read(SHADOW + path)
        for s, t in project.tables():
            path = f"{s.name}.{t.name}"
            try:
                for name, current in ((f"{s.name}_{t.name}", False), (f"{s.name}_{t.name}_current", True)):
                    if current and not t.versioned:
                        continue
                    seen = governed(project, principal, path, stored(path), current, self._key, read=stored)
                    seen.createOrReplaceTempView(name)
                    paths[name.lower()] = path
            except GovernanceError:
                continue  # not granted: no view
        out, read = plain.query(session, text)
        return self._watched(out, True, principal, sorted({paths[n] for n in read}))

    def _manager(self, principal: str | None, project: Project | None = None) -> str:
        """Who acts on the whole store: the owner, its members, or an administrator, named in the call or for the engine."""
        project = project or self.project
        owner = project.database.owner or ""
        principal = principal or self.principal
        if principal is None:
            raise AccessDenied("name the principal who does this")
        if principal == owner:
            return owner
        roles = membership(project, principal)
        if not any(r.name == owner or r.can_admin for r in roles):
            raise AccessDenied(f"{principal} neither owns nor administers {project.database.name}")
        return principal

    def _entries(self, project: Project, principal: str, action: str, paths: list[str]) -> dict[str, DataFrame]:
        """Log entries of one action on several tables, for the commit that does it."""
        some = [audit.entry(self.spark, self.clock(), principal, action, p) for p in paths if audit.audited(project, p, action)]
        return {audit.LOG: reduce(DataFrame.unionByName, some)} if some else {}

    # -- writing -----------------------------------------------------------------------------------------------
    def _write(self, principal: str, action: str, path: str, new: DataFrame, expected: int, more: dict[str, DataFrame] | None = None) -> None:
        append = dict(more or {})
        if audit.audited(self.project, path, action):
            append[audit.LOG] = audit.entry(self.spark, self.clock(), principal, action, path)
        self._commit({SHADOW + path: new}, append, expected=expected, reads=self._neighbours(path))

    def _neighbours(self, path: str) -> list[str]:
        """Tables that checks of a table's rows read: those on either side of a reference, and all if a policy may ask any."""
        project, t = self.project, self._place(path)[1]
        near = {path, *(f"{fk.referenced_schema}.{fk.referenced_table}" for fk in t.foreign_keys), *(c for c, _ in references.referencing(project, path))}
        every = {f"{s.name}.{x.name}" for s, x in project.tables()}
        asks = t.rls_enabled and any(p in text for p in every for r in t.rls_policies for text in (r.using_expr, r.check))
        return [SHADOW + p for p in (every if asks else near)]

    def _commit(self, *args: object, project: Project | None = None, **more: object) -> int:
        """A commit of the store, which keeps Bloom filters of subject identifiers in the files that it writes."""
        self.store.bloom = {f"{SHADOW}{s.name}.{t.name}": t.identifiers for s, t in (project or self.project).tables() if t.identifiers}
        return self.store.commit(*args, **more)

    def _worked_out(self, principal: str, path: str, found: Access, exprs: dict[str, Col | str]) -> DataFrame:
        """Stored rows with the values of callers' expressions under the given names.

        The expressions see what the principal may select, masked: a column that is not granted is not there to be named,
        and a masked one has its masked value.  Row policies apply where the rows are matched; behind a security barrier the
        expressions are not worked out for hidden rows at all.
        """
        _, t = self._place(path)
        raw = self._raw(path)
        for e in exprs.values():
            if isinstance(e, str):
                plain.expression(self.spark, e)
        hidden, ok = f"__{uuid.uuid4().hex}__", f"__{uuid.uuid4().hex}__"
        with self._asked(t) as rename:
            rows = raw.withColumn(ok, self._rows(principal, path, found, rename) if t.rls_security_barrier else F.lit(True))
        shown = found.readable(t) if "select" in found.privileges else []
        seen = rows.select(*[masked(F.col(f"`{c.name}`"), c.masking_strategy, c.mask_config, self._key).alias(c.name) for c in shown], F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias(hidden), ok)
        values = {n: F.expr(e) if isinstance(e, str) else e for n, e in exprs.items()}
        if t.rls_security_barrier:
            values = {n: F.when(F.col(ok), e) for n, e in values.items()}
        values = {n: e.alias(n) for n, e in values.items()}
        try:
            plain.columns_only(seen.select(*values.values()))
            used = seen.select(*values.values())._jdf.queryExecution().analyzed().references()
            if any(a.name() == hidden or a.name() == ok and not t.rls_security_barrier for a in plain._each(used.toSeq())):
                raise AccessDenied(f"{principal} may not name all columns of {path}")
            return seen.select(F.col(f"{hidden}.*"), *values.values())
        except AnalysisException as e:
            raise AccessDenied(f"{path}: {principal} cannot use this expression ({e.getCondition() or 'not valid'})") from None

    def _rows(self, principal: str, path: str, found: Access, rename: Callable[[str], str]) -> Col:
        """A condition on rows that the principal may reach, over stored values."""
        rows = row_filter(self._place(path)[1], principal, found.roles, found.bypass_rows, rename)
        return F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))

    def _asked(self, t: Table) -> AbstractContextManager[Callable[[str], str]]:
        """The tables that a table's policies ask, as long as plans with these policies are made."""
        return related(self.project, t, self.spark, self._raw)

    def _unreferred(self, path: str, gone: DataFrame, after: DataFrame, read: Callable[[str], DataFrame] | None = None) -> None:
        """Refuses to take away rows that others refer to, in this table or in another."""
        for child, fk, rows in references.still_referred(self.project, path, gone, after, read or self._raw):
            dml.refuse(rows, f"{path}: {child} refers to a row that would go ({fk.name})")

    def insert(self, principal: str, path: str, rows: DataFrame) -> None:
        """New rows: defaults, row policy, required values, references and the key are checked before anything is written."""
        seen = self.store.version()
        found, (_, t) = self._access(principal, path), self._place(path)
        found.require("insert", [c for c in rows.columns])
        old = self._raw(path)
        new = dml.inserted(t, old.limit(0), rows, self.clock())
        with self._asked(t) as rename:
            check = row_check(t, principal, found.roles, found.bypass_rows, rename)
            if check is not None:
                dml.refuse(new.filter(~check), f"{path}: the row policy refuses a row")
        dml.refuse(dml.missing_values(t, new), f"{path}: a required value is missing")
        self._references(t, path, new)
        whole = old.unionByName(new)
        if t.key:
            dml.refuse(dml.duplicate_keys(t, whole.join(new.select(*t.key).distinct(), t.key, "left_semi")), f"{path}: the key repeats")
        append = {SHADOW + path: new}
        if audit.audited(self.project, path, "insert"):
            append[audit.LOG] = audit.entry(self.spark, self.clock(), principal, "insert", path)
        self._commit(append=append, expected=seen, reads=self._neighbours(path))  # old folders stay as they are

    def _references(self, t: Table, path: str, new: DataFrame) -> None:
        for fk in t.foreign_keys:
            dml.refuse(dml.orphans(fk, new, self._raw(f"{fk.referenced_schema}.{fk.referenced_table}")), f"{path}: {fk.name} refers to nothing")

    def update(self, principal: str, path: str, where: Col | str, changes: dict[str, Col | str]) -> None:
        """Assigned columns only; immutable ones may not change; history is kept where declared.

        ``where`` and the assigned expressions see what the principal may read, as it reads it.
        """
        seen = self.store.version()
        found, (_, t) = self._access(principal, path), self._place(path)
        found.require("update", list(changes))
        stored = self._raw(path).columns
        names = {c: f"__new_{i}__" for i, c in enumerate(changes)}
        old = self._worked_out(principal, path, found, {"__hit__": where, **{n: changes[c] for c, n in names.items()}})
        with self._asked(t) as rename:
            old = old.withColumn("__hit__", F.coalesce(F.col("__hit__"), F.lit(False)) & self._rows(principal, path, found, rename))
        match, new_values = F.col("__hit__"), {c: F.col(n) for c, n in names.items()}
        kinds = {f.name: f.dataType for f in old.schema}
        dml.refuse(dml.changed_immutable(t, old, match, dml.assigned(t, new_values, kinds)), f"{path}: an immutable column would change")
        new = dml.updated(t, old, match, new_values, self.clock()).select(*stored)
        with self._asked(t) as rename:
            check = row_check(t, principal, found.roles, found.bypass_rows, rename)
            if check is not None:
                after = dml.updated(t, old.filter(match), F.lit(True), new_values, self.clock())
                after = after.filter(dml.is_live()) if t.versioned else after
                dml.refuse(after.filter(~check), f"{path}: the row policy refuses a row")
        dml.refuse(dml.missing_values(t, new), f"{path}: a required value is missing")
        if any(fk.column in changes for fk in t.foreign_keys):
            self._references(t, path, new)
        if set(t.key) & set(changes):
            dml.refuse(dml.duplicate_keys(t, new), f"{path}: the key repeats")
        if any(fk.referenced_column in changes for _, fk in references.referencing(self.project, path)):
            self._unreferred(path, old.filter(match), new)
        self._write(principal, "update", path, new, seen)

    def delete(self, principal: str, path: str, where: Col | str) -> None:
        seen = self.store.version()
        found, (_, t) = self._access(principal, path), self._place(path)
        found.require("delete")
        rows = self._worked_out(principal, path, found, {"__hit__": where})
        with self._asked(t) as rename:
            rows = rows.withColumn("__hit__", F.coalesce(F.col("__hit__"), F.lit(False)) & self._rows(principal, path, found, rename))
        new = dml.deleted(t, rows, F.col("__hit__"), self.clock()).drop("__hit__")
        self._unreferred(path, rows.filter("__hit__"), new)
        self._write(principal, "delete", path, new, seen)

    def apply(self, principal: str, path: str, changes: DataFrame, op: str = "op", at: str | None = "at", sequence: str = "seq") -> None:
        """A batch of row images: ``put`` says what a row is from ``at`` on, ``gone`` that it is no more; ``sequence`` orders images of one moment.

        Whole rows by key, several of one key and out of order if need be.  What holds for single writes holds for each of
        them: privileges by operation and column, row policies on what is put and on what is replaced or taken away,
        immutable columns, required values and references on both sides.
        """
        seen = self.store.version()
        found, (_, t) = self._access(principal, path), self._place(path)
        old = self._raw(path)
        dml.refuse(images.checked(t, changes, op, at), f"{path}: an image names no key, no moment or no operation")
        values = [c for c in changes.columns if c not in (op, at, sequence)]
        ops = {r[0] for r in changes.select(op).distinct().collect()}
        if images.PUT in ops:
            found.require("insert", values)
            found.require("update", values)
        if images.GONE in ops:
            found.require("delete")
        new = images.folded(t, old, changes, op, at, sequence)
        keys = changes.select(*t.key).distinct()
        live = lambda df: df.filter(dml.is_live()) if t.versioned else df
        before, after = live(old).join(keys, t.key, "left_semi"), live(new).join(keys, t.key, "left_semi")
        with self._asked(t) as rename:
            reach = self._rows(principal, path, found, rename)
            dml.refuse(before.filter(~reach), f"{path}: the row policy hides a row that would change")
            check = row_check(t, principal, found.roles, found.bypass_rows, rename)
            if check is not None:
                dml.refuse(after.filter(~check), f"{path}: the row policy refuses a row")
        frozen = [c.name for c in t.columns if c.immutable and c.name not in t.key]
        if frozen:
            pairs = before.select(*t.key, *[F.col(c).alias(f"__was_{c}__") for c in frozen]).join(after, t.key)
            dml.refuse(pairs.filter(reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__was_{c}__")) for c in frozen])), f"{path}: an immutable column would change")
        dml.refuse(dml.missing_values(t, after), f"{path}: a required value is missing")
        self._references(t, path, after)
        self._unreferred(path, before, new)
        self._write(principal, "update", path, new, seen)

    def truncate(self, principal: str, path: str) -> None:
        """All rows go, of all versions; row policies have no say, as the privilege is on the whole table."""
        seen = self.store.version()
        self._access(principal, path).require("truncate")
        old = self._raw(path)
        self._unreferred(path, old, old.limit(0))
        self._write(principal, "truncate", path, old.limit(0), seen)

    # -- erasure -----------------------------------------------------------------------------------------------
    def erase_check(self, columns: list[str], values: list[str]) -> DataFrame:
        return erase.erase_check(self.project, self._raw, columns, values)

    def erase_apply(self, columns: list[str], values: list[str], principal: str | None = None) -> list[dict]:
        """Erases a subject from every table that knows it, those that refer before what they refer to, and logs each table, as one commit; then older snapshots of these tables are removed."""
        principal = self._manager(principal)
        seen, project, now = self.store.version(), self.project, self.clock()
        counts = {f"{r['schema_name']}.{r['table_name']}": r for r in self.erase_check(columns, values).collect()}
        counts = [counts[p] for p in references.children_first(project, list(counts))]
        rewrite, log = {}, []
        for r in counts:
            path = f"{r['schema_name']}.{r['table_name']}"
            t = project.table(path)
            df = self._raw(path)
            if r["rows_matched"]:
                files = expiry.files_with(self.store, SHADOW + path, erase.subject_predicate(t, df, columns, values))
                some = self.store.rows_of(SHADOW + path, files)
                rewrite[SHADOW + path] = (files, erase.erased(t, some, erase.subject_match(t, some, columns, values)))
            log.append((self.build_id, now, r["schema_name"], r["table_name"], columns, values, r["erase_strategy"], r["rows_matched"], False))

        def later(path: str) -> DataFrame:
            """A table as it is afterwards."""
            df, t = self._raw(path), project.table(path)
            return erase.erased(t, df, erase.subject_match(t, df, columns, values)) if SHADOW + path in rewrite else df

        for full in rewrite:
            path = full.removeprefix(SHADOW)
            df, t = self._raw(path), project.table(path)
            self._unreferred(path, df.filter(erase.subject_match(t, df, columns, values)), later(path), later)
        if log:
            entries = self._entries(project, principal, "erase", [f"{r['schema_name']}.{r['table_name']}" for r in counts])
            self._commit(append={meta.PREFIX + "erasures": meta.frame(self.spark, "erasures", log), **entries}, expected=seen, rewrite=rewrite)
            self._purge(rewrite)
        return [{"schema_name": r["schema_name"], "table_name": r["table_name"], "erase_strategy": r["erase_strategy"], "rows_affected": r["rows_matched"]} for r in counts]

    def _purge(self, names: Iterable[str]) -> list[str]:
        """Older snapshots of tables that were erased from, under the governed and under the plain name, leave the disk."""
        return self.store.purge([n for full in names for n in (full, full.removeprefix(SHADOW))])

    def sweep(self, as_of: dt.datetime | None = None, principal: str | None = None) -> list[dict]:
        """Erases what has expired, table by table, as one commit, then removes their older snapshots; logs the tables that lost something."""
        principal = self._manager(principal)
        seen, project = self.store.version(), self.project
        now = as_of or self.clock()
        rewrite, log, out = {}, [], []
        for s, t in project.tables():
            if not t.retention_days:
                continue
            full = SHADOW + f"{s.name}.{t.name}"
            found = expiry.sweep(self.store, full, t, now)
            if found.rows:
                rewrite[full] = (found.files, found.left)
                log.append((self.build_id, now, s.name, t.name, [], [], t.erase_strategy, found.rows, True))
                out.append({"schema_name": s.name, "table_name": t.name, "erase_strategy": t.erase_strategy, "rows_affected": found.rows})
        if log:
            entries = self._entries(project, principal, "sweep", [f"{r['schema_name']}.{r['table_name']}" for r in out])
            self._commit(append={meta.PREFIX + "erasures": meta.frame(self.spark, "erasures", log), **entries}, expected=seen, rewrite=rewrite)
            self._purge(rewrite)
        return out

    # -- discovery ---------------------------------------------------------------------------------------------
    def context(self, principal: str) -> dict[str, list[dict]]:
        return discover.context(self.meta(), principal)


def result_json(rows: list[dict]) -> str:
    return json.dumps(rows, indent=1, default=str)
