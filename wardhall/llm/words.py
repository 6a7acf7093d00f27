"""Words of UTF-8 texts, found and hashed with numpy over many texts at once.

A batch of texts is joined with newlines into one byte buffer.  Words are runs
of bytes that a 256-entry table marks; every UTF-8 byte of a non-ASCII code
point is a word byte in both tables, so runs of bytes are runs of code points.
Hashes are 64 bits wide and the same on every machine and in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
_BLOCK = 1 << 17
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW, _IPOW = _powers(_P, _BLOCK), _powers(_P_INV, _BLOCK)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))

#: Words [^\x20\x09-\x0D]+: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: letters and digits of ASCII, and all else.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def utf8(text: str | None) -> bytes:
    """A text's bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def batches(texts: Iterable[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) for runs of texts of about ``limit`` bytes."""
    first, some, size = 0, [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > limit:
            yield first, some
            first, some, size = i, [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield first, some


class Words:
    """Words of a batch: starts and ends (bytes in the joined buffer), the text of each, counts."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool):
        joined = b"\n".join(texts)
        if lower:
            joined = joined.translate(LOWER)
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        inside = is_word[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.concatenate([edge, [len(inside)]])
        self.start, self.end = edge[0::2], edge[1::2]
        #: First word of each text, and one past the last of all.
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            s = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, s + _BLOCK, "right")))
            e = int(self.end[j - 1])
            if e - s > _BLOCK:
                out[i] = self._long(s, e)
            else:
                sums = np.empty(e - s + 1, dtype=np.uint64)
                sums[0] = 0
                np.cumsum(_BYTE[self.buf[s:e]] * _POW[: e - s], out=sums[1:])
                a, b = self.start[i:j] - s, self.end[i:j] - s
                out[i:j] = (sums[b] - sums[a]) * _IPOW[a]
            i = j
        return _mix(out + (self.end - self.start).astype(np.uint64))

    def _long(self, s: int, e: int) -> int:
        total = 0
        for at in range(s, e, _BLOCK):
            part = _BYTE[self.buf[at : min(e, at + _BLOCK)]]
            total += int(np.sum(part * _POW[: len(part)])) * pow(_P, at - s, 1 << 64)
        return total & _MASK


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, of whichever text; callers drop those that cross texts."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_P) + h[j : j + n]
    return _mix(out + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int, is_word: np.ndarray = SPACED) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; the whole sequence as one if it has fewer words; none without words."""
    w = Words(texts, is_word, lower=True)
    h = w.hashes()
    g = grams(h, k)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= k:
            s = np.sort(g[a : a + n - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(grams(h[a : a + n], n) if n else np.empty(0, np.uint64))
    return out
