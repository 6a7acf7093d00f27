"""The 64-bit hash of text that databases use for their own tables (seed 0), in built-in functions.

Three 32-bit words take in twelve bytes at a time; between the blocks, and once at the end, they are mixed by steps that
take turns among the words, so a step is one expression and a round is an ``aggregate`` over its rotations.
"""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import functions as F

# Rotations of the two rounds, and what the words start from besides the length.
MIX, END = (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24)
START = 0x9E3779B9 + 3923095
_WORD = 0xFFFFFFFF


def _low(c: Col) -> Col:
    return c.bitwiseAND(F.lit(_WORD))


def _turned(word: Col, factor: Col) -> Col:
    """A word turned left; ``factor`` is two to the power of the turn."""
    wide = word * factor
    return _low(wide).bitwiseOR(F.shiftrightunsigned(wide, 32))


def _words(x: Col, y: Col, z: Col) -> Col:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"))


def _factors(turns: tuple[int, ...]) -> Col:
    return F.array(*[F.lit(1 << t).cast("long") for t in turns])


def _mixed(state: Col) -> Col:
    """x -= z; x ^= turned z; z += y; then the next word is x."""
    step = lambda s, f: _words(s["y"], _low(s["z"] + s["y"]), _low(s["x"] - s["z"]).bitwiseXOR(_turned(s["z"], f)))
    return F.aggregate(_factors(MIX), state, step)


def _finished(state: Col) -> Col:
    """The last word takes in the middle one, turned; then the first is last."""
    step = lambda s, f: _words(s["y"], _low(s["z"].bitwiseXOR(s["y"]) - _turned(s["y"], f)), s["x"])
    # roles: z is worked on, y is its neighbour, x the third; afterwards z <- x, y <- z, x <- y
    return F.aggregate(_factors(END), state, step)


def _number(hexes: Col, at: Col) -> Col:
    """Four bytes of a hexadecimal text as a word, the lowest first."""
    digits = F.concat(*[F.substr(hexes, at + F.lit(2 * i), F.lit(2)) for i in (3, 2, 1, 0)])
    return F.conv(digits, 16, 10).cast("long")


def hash64(text: Col, start: int = START) -> Col:
    """The hash as a signed 64-bit number; null stays null.  Text is taken as UTF-8."""
    n = F.octet_length(text)
    first = _low(F.lit(start).cast("long") + n.cast("long"))
    hexes = F.rpad(F.hex(text.cast("binary")), ((n / 12).cast("int") + 1) * 24, F.lit("0"))
    add = lambda s, at, shift: _words(_low(s["x"] + _number(hexes, at)), _low(s["y"] + _number(hexes, at + 8)), _low(s["z"] + _low(_number(hexes, at + 16) * F.lit(1 << shift).cast("long"))))
    blocks = F.slice(F.sequence(F.lit(0), (n / 12).cast("int")), F.lit(1), (n / 12).cast("int"))
    taken = F.aggregate(blocks, _words(first, first, first), lambda s, i: _mixed(add(s, i * 24 + 1, 0)))
    # The tail's last word leaves its lowest byte to the length.
    last = F.transform(F.array(taken), lambda s: _finished(add(s, (n / 12).cast("int") * 24 + 1, 8)))[0]
    return F.shiftleft(last["x"], 32).bitwiseOR(last["y"])
