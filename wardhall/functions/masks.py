"""Masks as column expressions.  Every one is built in, so masked reads stay inside code generation."""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column as Col
from pyspark.sql import functions as F

from ..model import GovernanceError, Mask
from .blockhash import hash64

_BLOCK = 64


def _literal(text: str) -> str:
    """A replacement text in which ``\\`` and ``$`` stand for themselves."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _run(char: str, count: Col) -> Col:
    return F.repeat(F.lit(char), F.greatest(F.lit(0), count))


def full(c: Col, char: str = "X") -> Col:
    """Every character, line ends included."""
    return F.regexp_replace(c, r"(?s).", _literal(char))


def partial(c: Col, visible: int = 4, side: str = "right", char: str = "X") -> Col:
    """All but ``visible`` characters of one side; a shorter text is shown whole."""
    hidden = _run(char, F.length(c) - F.lit(visible))
    return F.concat(hidden, F.right(c, F.lit(visible))) if side == "right" else F.concat(F.left(c, F.lit(visible)), hidden)


def hmac_sha256(c: Col, key: str) -> Col:
    """HMAC with SHA-256, from two digests of built-in functions; the padded keys are made on the driver."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > _BLOCK else raw
    raw = raw.ljust(_BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), c.cast("binary")), 256))), 256)


def hashed(c: Col, algorithm: str, key: str | None = None) -> Col:
    if algorithm == "xxhash":
        warnings.warn("xxhash is not cryptographic: values can be recovered", stacklevel=3)
        return hash64(c).cast("string")
    if algorithm in ("sha256", "sha512"):
        warnings.warn(f"{algorithm} without a key can be reversed by dictionary", stacklevel=3)
        return F.sha2(c, int(algorithm[3:]))
    if algorithm == "hmac256":
        if not key:
            raise GovernanceError("the hmac256 mask needs a key: set it on the engine, it is never stored")
        return hmac_sha256(c, key)
    raise GovernanceError(f"no hash {algorithm}")


def email(c: Col, char: str = "X") -> Col:
    """The first character, the rest of the name hidden, the domain as it is."""
    at = F.position(F.lit("@"), c)
    return F.concat(F.left(c, F.lit(1)), _run(char, at - 2), F.substring(c, at, F.length(c) + 1))


def _digits(c: Col) -> Col:
    return F.regexp_replace(c, "[^0-9]", "")


def phone(c: Col, visible: int = 4, char: str = "X") -> Col:
    """Digits only, all but the last ones hidden."""
    return partial(_digits(c), visible, "right", char)


def credit_card(c: Col, char: str = "X") -> Col:
    return F.concat(F.lit("-".join([char * 4] * 3) + "-"), F.right(_digits(c), F.lit(4)))


def ip_address(c: Col, visible: int = 2, char: str = "X") -> Col:
    """The last octets."""
    if visible not in (1, 2, 3):
        raise GovernanceError("an address shows 1, 2 or 3 octets")
    shown = [F.split_part(c, F.lit("."), F.lit(i)) for i in range(5 - visible, 5)]
    return F.concat(F.lit(f"{char}." * (4 - visible)), *_between(shown))


def _between(parts: list[Col]) -> list[Col]:
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit("."), p]
    return out


def name(c: Col, char: str = "*") -> Col:
    """Each word's first character and three mask characters; runs of blanks become one space."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"(?:^|(?<= ))([^ ]?)[^ ]*", "$1" + _literal(char * 3))


def masked(c: Col, strategy: str, mask: Mask | None, key: str | None = None) -> Col:
    """The mask of a strategy over a column cast to text; ``none`` keeps value and type.

    Nulls stay null, unless ``hide_null`` puts the mask character there, the hash of an empty text for hashes, and an
    empty text for names.
    """
    if strategy == "none":
        return c
    if mask is None or mask.strategy != strategy:
        raise GovernanceError(f"a {strategy} mask needs a {strategy} configuration")
    text = c.cast("string")
    build = {
        "full": lambda t: full(t, mask.mask_char), "partial": lambda t: partial(t, mask.visible_length, mask.visible_side, mask.mask_char),
        "hash": lambda t: hashed(t, mask.algorithm, key), "email": lambda t: email(t, mask.mask_char), "phone": lambda t: phone(t, mask.visible_digits, mask.mask_char),
        "credit_card": lambda t: credit_card(t, mask.mask_char), "ip_address": lambda t: ip_address(t, mask.visible_octets, mask.mask_char), "name": lambda t: name(t, mask.mask_char),
    }.get(strategy)
    if build is None:
        raise GovernanceError(f"no mask {strategy}")
    out = build(text)
    if mask.hide_null:
        out = F.coalesce(out, F.lit("") if strategy == "name" else build(F.lit("")) if strategy == "hash" else F.lit(mask.mask_char))
    return out
