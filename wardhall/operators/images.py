"""Batches of row images: many changes of many rows, in any order, folded into a table and its history.

An image says what a row is from a moment on, or that it is gone.  Images of one key may come several in a batch, out of
order, and late, among versions that are stored already: a key's stored versions are images too, and all of them are
folded anew.  Keys that the batch doesn't name are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FOREVER, VALID_FROM, VALID_TO, GovernanceError, Table
from .dml import fill_defaults, generated, moment, writable

PUT, GONE = "put", "gone"


def _same_key(keys: list[str]) -> Col:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key_{k}__")) for k in keys])


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(f"__key_{k}__") for k in keys]).distinct()


def checked(table: Table, images: DataFrame, op: str, at: str | None) -> DataFrame:
    """Images whose operation is neither, or which name no key or no moment; a batch with one is refused."""
    bad = ~F.coalesce(F.col(op).isin(PUT, GONE), F.lit(False))
    for c in [*table.key, *([at] if at else [])]:
        bad |= F.col(f"`{c}`").isNull()
    return images.filter(bad)


def full_images(table: Table, old: DataFrame, images: DataFrame, op: str, at: str | None, sequence: str) -> DataFrame:
    """Stored columns of each image besides __op__, __at__, __seq__; defaults fill what puts leave out, generated columns follow.

    Columns that are neither stored nor the three named ones raise.
    """
    kinds = {f.name: f.dataType for f in old.schema}
    extra = set(images.columns) - set(writable(table)) - {op, at, sequence}
    if extra:
        raise GovernanceError(f"{table.name}: images have the unknown columns {', '.join(sorted(extra))}")
    if not table.key:
        raise GovernanceError(f"{table.name} has no key to fold images by")
    rows = images.withColumnsRenamed({n: w for n, w in ((op, "__op__"), (at, "__at__"), (sequence, "__seq__")) if n})
    rows = generated(table, fill_defaults(table, rows), kinds)
    values = [(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items() if c not in (VALID_FROM, VALID_TO)]
    return rows.select(*values, "__op__", (F.col("__at__").cast("timestamp_ntz") if at else F.lit(None).cast("timestamp_ntz")).alias("__at__"), F.col("__seq__").cast("long").alias("__seq__"))


def versions(rows: DataFrame, keys: list[str], unit: str = "DAY") -> DataFrame:
    """Images (columns, __op__, __at__, __seq__) as versions with __valid_from__ and __valid_to__, whose intervals touch or leave a gap where the row was gone.

    That a row is gone is kept as a version of no length, so that a late image still ends there; reads don't show it.

    Of images of one key and moment the one with the greatest sequence holds.  A version ends where its key's next image
    begins.  The next image is looked for within a ``unit`` of time; the last of a unit ends with the first moment of the
    key's next unit, which comes from one row for each key and unit.  So a key with very many images is as many groups as
    it has units.
    """
    part = F.date_trunc(unit, F.col("__at__")).alias("__unit__")
    rows = rows.select("*", part)
    columns = [c for c in rows.columns if c not in ("__seq__", "__unit__")]
    newest = rows.groupBy(*keys, "__unit__", "__at__").agg(F.max_by(F.struct("*"), F.coalesce(F.col("__seq__"), F.lit(-(2**63)))).alias("r")).select("r.*")
    inside = newest.withColumn("__next__", F.lead("__at__").over(Window.partitionBy(*keys, "__unit__").orderBy("__at__")))
    starts = newest.groupBy(*keys, "__unit__").agg(F.min("__at__").alias("__first__"))
    starts = starts.withColumn("__after__", F.lead("__first__").over(Window.partitionBy(*keys).orderBy("__unit__")))
    edges = starts.select(*[F.col(f"`{k}`").alias(f"__key_{k}__") for k in keys], F.col("__unit__").alias("__of__"), "__after__")
    whole = inside.join(edges, _same_key(keys) & (F.col("__unit__") == F.col("__of__")))
    ends = F.coalesce("__next__", "__after__", F.lit(FOREVER).cast("timestamp_ntz"))
    ends = F.when(F.col("__op__") == GONE, F.col("__at__")).otherwise(ends)
    return whole.select(*[F.col(f"`{c}`") for c in columns if c not in ("__at__", "__op__")], F.col("__at__").alias(VALID_FROM), ends.alias(VALID_TO))


def folded(table: Table, old: DataFrame, images: DataFrame, op: str = "op", at: str | None = "at", sequence: str = "seq") -> DataFrame:
    """The table after a batch of images.

    A versioned table gets the versions of each named key anew: stored versions are images at their beginning, and say at
    their end that the row is gone unless another begins there; new images come after stored ones of the same moment.  A
    plain table keeps of each named key the image with the greatest (moment, sequence), or nothing if that is gone; it has
    no moments of its own, so a later batch wins.  An image is whole: what it leaves out is its default, or null.
    Nulls in ``sequence`` come first; a repeated image changes nothing.
    """
    keys = table.key
    new = full_images(table, old, images, op, at, sequence)
    named = _named(new, keys)
    apart = old.join(named, _same_key(keys), "left_anti")
    if VALID_TO not in old.columns:
        last = new.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct("__at__", F.coalesce(F.col("__seq__"), F.lit(-(2**63))))).alias("r")).select("r.*")
        return apart.unionByName(last.filter(F.col("__op__") == PUT).select(*[F.col(f"`{c}`") for c in old.columns]))
    there = old.join(named, _same_key(keys), "left_semi")
    plain = [F.col(f"`{c}`") for c in old.columns if c not in (VALID_FROM, VALID_TO)]
    begin = there.filter(F.col(VALID_FROM) < F.col(VALID_TO)).select(*plain, F.lit(PUT).alias("__op__"), F.col(VALID_FROM).alias("__at__"), F.lit(-1).cast("long").alias("__seq__"))
    end = there.filter(F.col(VALID_TO) < moment(FOREVER, old.schema[VALID_TO].dataType)).select(*plain, F.lit(GONE).alias("__op__"), F.col(VALID_TO).alias("__at__"), F.lit(-2).cast("long").alias("__seq__"))
    later = new.withColumn("__seq__", F.coalesce(F.col("__seq__"), F.lit(0)))
    return apart.unionByName(versions(begin.unionByName(end).unionByName(later), keys).select(*old.columns))
