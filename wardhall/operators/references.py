"""Both sides of references: who refers to a row, directly or not, and what may not go while somebody does."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import VALID_TO, ForeignKey, Project
from ..sources.work import new_folder, removed
from .dml import is_live

Read = Callable[[str], DataFrame]


def referencing(project: Project, path: str) -> list[tuple[str, ForeignKey]]:
    """(table, reference) for every reference to a table."""
    return [(f"{s.name}.{t.name}", fk) for s, t in project.tables() for fk in t.foreign_keys if f"{fk.referenced_schema}.{fk.referenced_table}" == path]


def children_first(project: Project, paths: list[str]) -> list[str]:
    """Tables so ordered that those which refer come before what they refer to; within a cycle as given."""
    out: list[str] = []
    open_: set[str] = set()

    def visit(path: str) -> None:
        if path in out or path in open_:
            return
        open_.add(path)
        for child, _ in referencing(project, path):
            visit(child)
        out.append(path)

    for p in paths:
        visit(p)
    return [p for p in out if p in paths]


def _live(df: DataFrame) -> DataFrame:
    return df.filter(is_live()) if VALID_TO in df.columns else df


def still_referred(project: Project, path: str, gone: DataFrame, after: DataFrame, read: Read) -> list[tuple[str, ForeignKey, DataFrame]]:
    """(table, reference, rows) for every reference to a table: rows whose key is among ``gone`` and not among ``after``; the table itself is read as ``after``."""
    out = []
    for child, fk in referencing(project, path):
        c = fk.referenced_column
        lost = gone.select(F.col(c).alias("__key__")).filter("__key__ is not null").distinct().join(_live(after).select(F.col(c).alias("__key__")), "__key__", "left_anti")
        rows = _live(after if child == path else read(child))
        out.append((child, fk, rows.join(lost, F.col(fk.column) == F.col("__key__"), "left_semi")))
    return out


def dependants(project: Project, path: str, rows: DataFrame, read: Read, most: int = 1000) -> dict[str, DataFrame]:
    """Live rows of each table that refer to ``rows`` of a table, directly or through others.

    Without a cycle among the tables that is one lazy plan of semi joins, a table at a time.  With one, whole rounds are
    written until a round finds no row that is not known by its key yet; a table without a key is known by all columns.
    """
    reached, stack = [path], [path]
    while stack:
        for child, _ in referencing(project, stack.pop()):
            if child not in reached:
                reached.append(child)
                stack.append(child)
    order = children_first(project, reached)[::-1]
    edges = [(parent, child, fk) for parent in reached for child, fk in referencing(project, parent)]
    if all(order.index(parent) < order.index(child) for parent, child, _ in edges):
        found = {path: rows}
        for child in order[1:]:
            parts = [(found[parent].select(F.col(fk.referenced_column).alias("__key__")).distinct(), fk) for parent, c, fk in edges if c == child and parent in found]
            found[child] = _any_of(_live(read(child)), parts, _known_by(project, child, read))
        return {p: found[p] for p in order[1:]}
    spark, folders = rows.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        folders.append(new_folder(spark, "reached"))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    known: dict[str, DataFrame] = {path: kept(rows)}
    frontier = dict(known)
    for _ in range(most):
        fresh: dict[str, DataFrame] = {}
        for child in reached:
            parts = [(frontier[parent].select(F.col(fk.referenced_column).alias("__key__")).distinct(), fk) for parent, c, fk in edges if c == child and parent in frontier]
            if not parts:
                continue
            by = _known_by(project, child, read)
            some = _any_of(_live(read(child)), parts, by)
            if child in known:
                there = known[child].select(*[F.col(f"`{c}`").alias(f"__{i}__") for i, c in enumerate(by)])
                some = some.join(there, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}__")) for i, c in enumerate(by)]), "left_anti")
            some = kept(some)
            if some.limit(1).count():
                fresh[child] = some
        if not fresh:
            break
        known |= {c: known[c].unionByName(df) if c in known else df for c, df in fresh.items()}
        frontier = fresh
    else:
        raise RuntimeError(f"references to {path} did not settle in {most} rounds")
    ends = {p: kept(df) for p, df in known.items() if p != path or any(c == path for _, c, _ in edges)}
    for f in folders[: -len(ends)] if ends else folders:
        removed(spark, f)
    return ends


def _known_by(project: Project, path: str, read: Read) -> list[str]:
    return project.table(path).key or read(path).columns


def _any_of(df: DataFrame, parts: list[tuple[DataFrame, ForeignKey]], by: list[str]) -> DataFrame:
    """Rows that refer to any of the keys, each once."""
    if len(parts) == 1:
        return df.join(parts[0][0], F.col(parts[0][1].column) == F.col("__key__"), "left_semi")
    for i, (keys, fk) in enumerate(parts):
        df = df.join(keys.select(F.col("__key__").alias(f"__key{i}__")), F.col(fk.column) == F.col(f"__key{i}__"), "left")
    return df.filter(reduce(lambda a, b: a | b, [F.col(f"__key{i}__").isNotNull() for i in range(len(parts))])).drop(*[f"__key{i}__" for i in range(len(parts))])
