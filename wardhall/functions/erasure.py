"""What erasure puts in a column's place."""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ERASED, GovernanceError

_UUID = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"


def _hex_number(h: Col, digits: int, signed: bool = False) -> Col:
    return F.conv(F.left(h, F.lit(digits)), 16, -10 if signed else 10)


def obfuscated(c: Col, kind: T.DataType, declared: str = "text", nullable: bool = True) -> Col:
    """A value of the same type that follows from the SHA-256 of the old one's text; null stays null."""
    h = F.sha2(c.cast("string"), 256)
    if isinstance(kind, T.StringType):
        return F.regexp_replace(F.left(h, F.lit(32)), _UUID, "$1-$2-$3-$4-$5") if declared.lower() == "uuid" else h
    if isinstance(kind, T.ShortType):
        return (_hex_number(h, 4).cast("int") % 32768).cast(kind)
    if isinstance(kind, T.IntegerType):
        return (_hex_number(h, 8).cast("long") % 2147483648).cast(kind)
    if isinstance(kind, (T.LongType, T.FloatType, T.DoubleType)):
        return _hex_number(h, 16, signed=True).cast("long").cast(kind)
    if isinstance(kind, T.DecimalType):
        whole = 10 ** max(0, kind.precision - kind.scale)
        number = _hex_number(h, 16, signed=True).cast("decimal(38,0)")
        return (number % F.lit(whole).cast("decimal(38,0)")).cast(kind) if whole < 10**19 else number.cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNotNull(), _hex_number(h, 2).cast("int") % 2 == 0)
    return _marker(kind, nullable)


def nullified(kind: T.DataType, nullable: bool = True) -> Col:
    """Null, or a marker where null isn't allowed."""
    return F.lit(None).cast(kind) if nullable else _marker(kind, False)


def _marker(kind: T.DataType, nullable: bool) -> Col:
    if isinstance(kind, T.StringType):
        return F.lit(ERASED)
    if nullable:
        return F.lit(None).cast(kind)
    raise GovernanceError(f"a required column of type {kind.simpleString()} has no erased value")
