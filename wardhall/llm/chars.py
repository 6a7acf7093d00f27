"""Code points of texts, as numpy arrays over many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

_TABLES: dict[str, np.ndarray] = {}
_TESTS: dict[str, Callable[[str], bool]] = {"letters": str.isalpha, "alnum": str.isalnum}


def marked(kind: str) -> np.ndarray:
    """Which code points are letters, or letters and digits; made once for each process."""
    if kind not in _TABLES:
        test = _TESTS[kind]
        _TABLES[kind] = np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)
    return _TABLES[kind]


def spaced_code_points(texts: Iterable[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, index of the text) of lower-cased texts; each run of unmarked ones is one space, and each text has one at either end."""
    texts = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    good = marked(kind)[cp]
    keep = good.copy()
    keep[0:1] = True
    keep[1:] |= good[:-1]
    keep[1:] |= doc[1:] != doc[:-1]
    return np.where(good, cp, 32)[keep].astype(np.uint64), doc[keep]


def decoded(raw: bytes | None) -> str:
    """A text's characters; null is empty, and bytes that are no UTF-8 become replacement characters, so that one bad row ends no job."""
    if raw is None:
        return ""
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def cut(text: str, limit: int, kind: str) -> Iterator[str]:
    """A text in pieces of ``limit`` characters or a little more: a piece ends at a blank, or else before an unmarked character, never within a word."""
    at, test = 0, _TESTS[kind]
    while len(text) - at > limit:
        end = at + limit
        blank = next((i for i in range(end, min(end + 4096, len(text))) if text[i].isspace()), None)
        if blank is None:
            blank = next((i for i in range(end, len(text)) if not test(text[i])), len(text))
        yield text[at:blank]
        at = blank
    yield text[at:]


def pieces(texts: list[str], limit: int, kind: str) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, pieces) of about ``limit`` characters in all; a longer text is cut between words."""
    owner: list[int] = []
    some: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in cut(text, limit, kind) if text else ():
            owner.append(i)
            some.append(piece)
            size += len(piece)
            if size >= limit:
                yield owner, some
                owner, some, size = [], [], 0
    if some:
        yield owner, some
