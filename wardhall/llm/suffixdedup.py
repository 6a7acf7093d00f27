"""Suffix-array dedup by bucket-pointer refinement, over many machines.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  Sorting all
suffixes of a large corpus on one machine is out of reach, so equal strings first have to meet.  They do by an anchor, the
least 16-byte gram of the string, which both copies choose alike, together with the half of the other bytes that stands
after or before it: of the bytes around the anchor a string has at least half on one side.  Anchor and half are one key;
a key that only one row has is dropped.  Each other key brings its context, the bytes that a string with this half can
reach beyond it.  Contexts are dealt out by key, so that a gram which is common everywhere splits by what stands next to
it.  The anchors only decide which suffixes meet; which strings are equal is the suffix order's to say.

Where they meet the suffixes of the contexts are sorted in buckets.  Buckets start from 8-byte grams.  Each bucket of
several suffixes is refined by the bucket pointers of a later offset, and its suffixes' pointers are updated before the
next bucket is refined, which reads them, until a bucket holds the suffixes that agree in ``length`` bytes.  A bucket's
least document keeps its string.

Keys that several rows have are told by a bitmap, of a size bounded by ``_FILTER_BITS``; as it fills, more keys bring their
contexts than need to, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import ROWS, small_batches, table
from .shared import spent, written
from .words import _mix, batches

LENGTH = 50
_Q = 16
#: Bits of the bitmap of repeated keys, in all and for each bucket of keys at most.
_FILTER_BITS, _BUCKET_BITS = 1 << 29, 1 << 24
_LOW = np.uint64((1 << 40) - 1)
_BUCKET_BYTES = 64_000_000
#: Contexts of one call at most, on average.
_GROUP_ROWS = 200_000
_FLUSH, _HELD, _AT_ONCE = 1_000_000, 200_000, 40_000
#: Bytes of text whose anchors are found at once, few enough for a core's cache.
_ANCHOR_BYTES = 1 << 17


def _slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over each run of ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        a = op(a[: len(a) - span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _grams(word: np.ndarray, n: int) -> np.ndarray:
    """32 bits of each 16-byte gram, from 1; they only choose anchors, so equal ones of different grams do no harm."""
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h += word[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(32)
    return np.maximum(h.astype(np.uint32), np.uint32(1))


class Anchors:
    """Anchors of a batch of texts: index of the text, place there."""

    def __init__(self, texts: list[bytes], length: int):
        self.reach = length - _Q
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])
        joined = b"\0" * length + b"\0".join(texts) + b"\0" * (length + 16)
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        self.pad = length
        n = len(joined) - 2 * length - 16
        self.word = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
        h = _grams(self.word[length:], n)
        w = self.reach + 1
        least = np.zeros(n + self.reach, dtype=np.uint32)
        if n >= w:
            m = _slide(h, w, np.minimum)
            last = np.repeat(self.start + self.sizes, np.minimum(self.sizes + 1, length)) - _counted(np.minimum(self.sizes + 1, length))
            m[last[last < len(m)]] = 0  # a string from there would leave its text
            least[self.reach : self.reach + len(m)] = m
        most = _slide(least, w, np.maximum)[:n]
        at = np.flatnonzero(most == h)  # no gram's hash is 0
        self.doc = np.searchsorted(self.start, at, "right") - 1
        self.place = at - self.start[self.doc]

    def halves(self, buckets: int) -> list[np.ndarray]:
        """Keys of each anchor with the half after it, and before it; 0 where the text has fewer bytes."""
        self.half = half = -(-self.reach // 2)
        width = _Q + half
        here = self.pad + self.start[self.doc] + self.place
        out = []
        for at, ok, salt in ((here, self.place + width <= self.sizes[self.doc], 1), (here - half, self.place >= half, 2)):
            x = np.full(len(at), salt, dtype=np.uint64)
            for step in [*range(0, width - 7, 8), width - 8]:
                x = _mix(x * np.uint64(0x100000001B3) + self.word[at + step])
            out.append(np.where(ok, np.maximum(x, 1), np.uint64(0)))
        return out

    def contexts(self, side: int, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes before the key, bytes after it, both as rows with zeros outside the text, place of the key) of some anchors.

        Side 0: the half after the anchor; side 1: before it.  A string with this half reaches ``length`` - key bytes
        beyond the key on either side.
        """
        half, width = self.half, _Q + self.half
        beyond = length - width
        doc, at = self.doc[which], self.place[which] - (half if side else 0)
        lo, hi = np.minimum(beyond, at), np.minimum(beyond, self.sizes[doc] - at - width)
        place = self.pad + self.start[doc] + at
        view = np.lib.stride_tricks.sliding_window_view(self.buf, beyond)
        rows = np.concatenate([view[place - beyond], view[place + width]], axis=1)
        step = np.concatenate([np.arange(-beyond, 0), np.arange(beyond)])
        edge = np.flatnonzero((lo < beyond) | (hi < beyond))
        rows[edge] *= (step >= -lo[edge, None]) & (step < hi[edge, None])
        return lo, hi, rows, at


def context_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """64 bits of a key and its context."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    x = _mix(h * np.uint64(0x100000001B3) + (lo * 256 + hi).astype(np.uint64))
    for column in wide.view("<u8").T:
        x = _mix(x * np.uint64(0x100000001B3) + column)
    return x


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text], docs[key]).alias("tag"), docs[text].cast("binary").alias("text"))


def _slots(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Place of each key in the bitmap; every bucket of keys has a run of ``bits`` there."""
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64) * bits + ((keys & _LOW) % np.uint64(bits)).astype(np.int64)


def _anchored(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Anchors]]:
    """Anchors by batch of texts; a row with a null id or text, or too short a text, has none."""
    ids = batch.column("doc_id")
    texts = [t if t is not None and ok and len(t) >= length else b"" for t, ok in zip(batch.column("text").to_pylist(), ids.is_valid().to_pylist(), strict=True)]
    for first, some in batches(texts, _ANCHOR_BYTES):
        yield first, Anchors(some, length)


def _cuts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in stream:
        for at in range(0, big.num_rows, ROWS):
            yield big.slice(at, ROWS)


def _packed(keys: np.ndarray) -> bytes:
    """The low five bytes of each key; the bucket has the rest."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(parts: bytes) -> np.ndarray:
    out = np.zeros((len(parts) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(parts, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def repeated_keys(source: DataFrame, length: int, buckets: int, bits: int) -> DataFrame:
    """A run of the bitmap for each bucket of keys: the slots of keys that more than one row has.  Keys that clash only keep more."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            if len(h):
                h = np.sort(((h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40)) | (h & _LOW))
                third = np.zeros(len(h), dtype=bool)
                third[2:] = h[2:] == h[:-2]
                h = h[~third]  # twice says that it is repeated
                some, at = np.unique((h >> np.uint64(40)).astype(np.int32), return_index=True)
                parts = [_packed(p) for p in np.split(h, at[1:])]
                for i in range(0, len(parts), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 64], pa.int32()), pa.array(parts[i : i + 64], pa.binary())], names=["bucket", "part"])

        for batch in _cuts(stream):
            for _, a in _anchored(batch, length):
                keys = np.concatenate(a.halves(buckets))
                if not len(keys):
                    continue
                own = _mix(keys + np.concatenate([a.doc, a.doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(own)  # a key counts once in a text
                fresh = order[np.concatenate([[True], own[order[1:]] != own[order[:-1]]])]
                held.append(keys[fresh][keys[fresh] > 0])
                size += len(held[-1])
                if size > _FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(_unpacked(b"".join(pdf["part"])))
        marked = np.zeros(bits, dtype=bool)
        marked[(h[1:][h[1:] == h[:-1]] % np.uint64(bits)).astype(np.int64)] = True
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "part": [np.packbits(marked, bitorder="little").tobytes()]})

    return small_batches(source).mapInArrow(run, "bucket int, part binary").groupBy("bucket").applyInPandas(merge, "bucket int, part binary")


def _ranks(a: np.ndarray) -> np.ndarray:
    """Rank of each value, equal for equal ones."""
    order = np.argsort(a)
    out = np.empty(len(a), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], a[order[1:]] != a[order[:-1]]])) if len(a) else 0
    return out


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number that orders by ``first``, then ``second``; neither is negative."""
    return first * (int(second.max(initial=0)) + 1) + second


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.argsort(_pairs(first, second))


def refine(group: np.ndarray, rows: np.ndarray, length: int, runs: int = 16) -> np.ndarray:
    """Class of each start of ``length`` bytes in the rows: equal where these bytes, the start and the row's group agree.

    Buckets start from 8-byte grams, in order, of one group and start.  A pass goes over the buckets of several suffixes,
    a run of them at a time, sorts each by the pointers of the suffixes one offset further on, and writes the new pointers
    at once, so that buckets refined earlier in a pass serve the later ones with their finer order.  A suffix alone in
    its bucket is done.  In the order that comes of it, neighbours with equal bytes are one class.
    """
    m, width = rows.shape
    places, n = width - 7, width - length + 1
    flat = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, 8))))
    word = np.ndarray((m, places), dtype=">u8", buffer=flat, strides=(flat.shape[1], 1)).astype(np.uint64).ravel()
    own = (group[:, None] * places + np.arange(places)).ravel()
    order = _order(own, _ranks(word))
    word, own = word[order], own[order]
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (own[1:] != own[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))  # first rank of the bucket of each rank
    pointer = np.empty(len(order), dtype=np.int64)
    pointer[order] = head
    for offset in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        several = ~new
        several[:-1] |= ~new[1:]
        todo = np.flatnonzero(several)
        todo = todo[order[todo] % places + offset < places]  # whole buckets, for a bucket has one start
        if not len(todo):
            continue
        heads = head[todo]
        cut = np.unique(np.searchsorted(heads, heads[np.linspace(0, len(todo) - 1, runs + 1).astype(np.int64)]))
        for a, b in zip(cut, [*cut[1:], len(todo)], strict=True):
            ranks, some, bucket = todo[a:b], order[todo[a:b]], heads[a:b]
            by = _order(bucket, pointer[some + offset])
            some, later = some[by], pointer[some[by] + offset]
            split = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])])
            order[ranks], new[ranks] = some, split
            head[ranks] = ranks[np.maximum.accumulate(np.where(split, np.arange(len(some)), 0))]
            pointer[some] = head[ranks]
    whole = order[order % places < n]
    text = np.lib.stride_tricks.sliding_window_view(flat, length, axis=1)[whole // places, whole % places]
    own = group[whole // places] * places + whole % places
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]).any(axis=1)])
    out = np.empty(m * places, dtype=np.int64)
    out[whole] = np.cumsum(fresh) - 1
    return out.reshape(m, places)[:, :n]


def first_owners(h: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, dmin: np.ndarray, dmax: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """For each context that loses strings: its least document, first and last start that even that document loses (or -1), first and last start of all.

    ``rows`` leave out the bytes of the key, which are the same in its whole group: a string is the key and ``beyond``
    bytes that stand together in its row.
    """
    order = np.lexsort((x, h))
    at = np.flatnonzero(np.concatenate([[True], (x[order[1:]] != x[order[:-1]]) | (h[order[1:]] != h[order[:-1]])]))
    dmin, dmax = np.minimum.reduceat(dmin[order], at), np.maximum.reduceat(dmax[order], at)
    h, x, lo, hi, rows = (a[order[at]] for a in (h, x, lo, hi, rows))
    beyond = rows.shape[1] // 2
    start = np.arange(beyond + 1)
    valid = (start >= beyond - lo[:, None]) & (start <= hi[:, None])
    less = np.zeros(valid.shape, dtype=bool)
    same = h[1:] == h[:-1]
    met = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))  # contexts that share their key with another
    if len(met):
        ids = refine(np.unique(h[met], return_inverse=True)[1], rows[met], beyond)
        ok = valid[met]
        owner = np.full(int(ids.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(owner, ids[ok], np.broadcast_to(dmin[met, None], ids.shape)[ok])
        less[met] = ok & (owner[ids] < dmin[met, None])
    some = less.any(axis=1)
    keep = valid.any(axis=1) & (some | (dmax > dmin))
    last = lambda a: beyond - a[:, ::-1].argmax(axis=1)
    out = {"h": h, "x": x, "dmin": dmin, "a1": np.where(some, less.argmax(axis=1), -1), "b1": np.where(some, last(less), -1), "a2": valid.argmax(axis=1), "b2": last(valid)}
    return {k: v[keep] for k, v in out.items()}


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, lo, hi): bytes of a row that a string of an earlier document covers; spans of a row may overlap."""
    source = _source(docs, key, text)
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(docs[text].cast("binary")))).first()[0] or 0
    buckets = min(1 << 24, max(1, -(-size // _BUCKET_BYTES)))
    bits = max(8, min(_BUCKET_BITS, _FILTER_BITS // buckets) // 8 * 8)
    bitmap = np.zeros(buckets * bits // 8, dtype=np.uint8)  # _FILTER_BITS / 8 bytes at most
    marks = written(repeated_keys(source, length, buckets, bits))
    for r in marks.toLocalIterator():
        bitmap[r["bucket"] * bits // 8 : (r["bucket"] + 1) * bits // 8] = np.frombuffer(r["part"], np.uint8)
    spent(marks)
    known = spark.sparkContext.broadcast(bitmap)
    spread = max(1, size // 9 // _GROUP_ROWS)  # keys are no more than one for 9 bytes
    half = -(-(length - _Q) // 2)
    beyond = length - _Q - half

    def found_keys(a: Anchors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(side, anchors, keys) of the anchors whose key the bitmap marks, some at a time."""
        for side, keys in enumerate(a.halves(buckets)):
            slot = _slots(keys, buckets, bits)
            which = np.flatnonzero((keys > 0) & (known.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0))
            for cut in range(0, len(which), _HELD):
                yield side, which[cut : cut + _HELD], keys[which[cut : cut + _HELD]]

    record = np.dtype([("h", "<u8"), ("x", "<u8"), ("lo", "i1"), ("hi", "i1"), ("ctx", "u1", (2 * beyond,)), ("dmin", "<i8"), ("dmax", "<i8")])

    def collapsed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """One record for each context, with its least and greatest document; the records of a bucket are one row."""
        h, x, lo, hi, rows, doc = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(x)
        at = np.flatnonzero(np.concatenate([[True], x[order[1:]] != x[order[:-1]]]))
        rest, doc = order[at], doc[order]
        bucket = (h[rest] % np.uint64(spread)).astype(np.int32)
        by = np.argsort(bucket)
        out = np.empty(len(rest), dtype=record)
        for name, column in (("h", h[rest]), ("x", x[rest]), ("lo", lo[rest]), ("hi", hi[rest]), ("ctx", rows[rest]), ("dmin", np.minimum.reduceat(doc, at)), ("dmax", np.maximum.reduceat(doc, at))):
            out[name] = column[by]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) > 0]))
        ends = np.append(edge, len(out)).astype(np.int32) * record.itemsize
        parts = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(out.view(np.uint8))])
        return pa.RecordBatch.from_arrays([pa.array(bucket[by[edge]]), parts], names=["bucket", "part"])

    def contexts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in _cuts(stream):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, a in _anchored(batch, length):
                for side, which, h in found_keys(a):
                    lo, hi, rows, _ = a.contexts(side, which, length)
                    held.append((h, context_hash(h, lo, hi, rows), lo.astype(np.int8), hi.astype(np.int8), rows, ids[first + a.doc[which]].astype(np.int64)))
                    size += len(h)
                    if size > _HELD:
                        yield collapsed(held)
                        held, size = [], 0
        if held:
            yield collapsed(held)

    def owners(found: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(found["part"].to_pylist()), dtype=record)
        got = got[np.argsort(got["h"])]
        h = got["h"].view(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        cuts = [0, *edge[np.flatnonzero(np.diff(edge // _AT_ONCE)) + 1].tolist(), len(h)]  # whole keys, about so many rows
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                some = got[lo:hi]
                out.append(first_owners(h[lo:hi], some["x"].view(np.int64), some["lo"].astype(np.int64), some["hi"].astype(np.int64), some["ctx"], some["dmin"], some["dmax"], length))
        return pa.table({f.name: pa.array(np.concatenate([o[f.name] for o in out]).astype(f.type.to_pandas_dtype())) for f in owned}, schema=owned)

    owned = pa.schema([(n, pa.int8() if n[0] in "ab" else pa.int64()) for n in ("h", "x", "dmin", "a1", "b1", "a2", "b2")])
    dealt = small_batches(source).mapInArrow(contexts, "bucket int, part binary")
    found = written(dealt.groupBy("bucket").applyInArrow(owners, "h long, x long, dmin long, a1 tinyint, b1 tinyint, a2 tinyint, b2 tinyint"))

    def places(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cuts(stream):
            for first, a in _anchored(batch, length):
                for side, which, h in found_keys(a):
                    lo, hi, rows, at = a.contexts(side, which, length)
                    row = pa.array(first + a.doc[which])
                    columns = [batch.column("doc_id").take(row), batch.column("tag").take(row), pa.array((at - beyond).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(context_hash(h, lo, hi, rows).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "pos", "h", "x"])

    hits = small_batches(source).mapInArrow(places, "doc_id long, tag long, pos long, h long, x long").alias("hits")
    same = (F.col("hits.x") == F.col("found.x")) & (F.col("hits.h").bitwiseXOR(F.col("found.h")) == 0)  # one key to sort by; the other only checks
    later = F.col("doc_id") > F.col("dmin")
    lo, hi = F.when(later, F.col("a2")).otherwise(F.col("a1")), F.when(later, F.col("b2")).otherwise(F.col("b1"))
    lost = hits.join(found.alias("found"), same).filter(later | (F.col("b1") >= 0))
    return lost.select("doc_id", "tag", (F.col("pos") + lo).alias("lo"), (F.col("pos") + hi + length).alias("hi"))


def join_spans(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each (doc, tag) that touch or overlap as one; no place is negative."""
    if not len(lo):
        return doc, tag, lo, hi
    row = _ranks(_pairs(_ranks(doc), _ranks(tag)))
    order = _order(row, lo)
    doc, tag, lo, hi, row = (a[order] for a in (doc, tag, lo, hi, row))
    far = row * (int(hi.max()) + 1)  # the rows' places one after the other
    end = np.maximum.accumulate(hi + far)
    first = np.flatnonzero(np.concatenate([[True], ((lo + far)[1:] > end[:-1]) | (row[1:] != row[:-1])]))
    return doc[first], tag[first], lo[first], end[np.append(first[1:], len(row)) - 1] - far[first]


def _joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans joined as far as they come together here."""
    names = ["doc_id", "tag", "lo", "hi"]
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        return join_spans(*(np.concatenate(c) for c in zip(*held, strict=True)))

    for batch in stream:
        held.append(tuple(batch.column(n).to_numpy() for n in names))
        size += batch.num_rows
        if size > _FLUSH:
            held = [joined()]
            size = len(held[0][0])
            if size > _FLUSH // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in joined()], names=names)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept.

    ``kept`` is the remaining bytes, n_spans the maximal removed runs.  Strings lie within one text and are judged on the
    input.  Null and empty texts have no bytes; texts shorter than ``length`` lose none.  Rows with the same id don't
    remove from each other; a row with a null id neither removes nor loses; an empty table gives no rows; other columns
    are not read.  Ids may be of any type that has an order.  A text of any length is read whole; of equal grams in a
    window all are anchors.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        ranks = docs.select(docs[key].alias("own_id")).filter("own_id is not null").distinct().orderBy("own_id")
        ranks = written(ranks.withColumn("rank", F.monotonically_increasing_id()))  # ascending as the ids are
        ranked = docs.select(docs[key].alias("own_id"), docs[text].alias("text")).join(ranks, "own_id", "left").select("rank", "text")
        out = suffix_dedup(ranked, "rank", "text", length).withColumnRenamed("doc_id", "rank").join(ranks, "rank", "left")
        return out.select(F.col("own_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
    spans = repeated_spans(docs, key, text, length).repartition("doc_id", "tag")
    spans = spans.mapInArrow(_joined, spans.schema)  # most of a text's spans overlap
    merged = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("tag").alias("cut_tag")).agg(F.collect_set(F.struct("lo", "hi")).alias("cut"))
    merged = written(merged.select("cut_id", "cut_tag", F.col("cut.lo").alias("lo"), F.col("cut.hi").alias("hi")))
    both = _source(docs, key, text).join(merged, (F.col("doc_id") == F.col("cut_id")) & (F.col("tag") == F.col("cut_tag")), "left").select("doc_id", "text", "lo", "hi")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cuts(stream):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for t, los, his in zip(batch.column("text").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                t = t or b""
                out, at, spans_, removed = [], 0, 0, 0
                end = -1
                for lo, hi in sorted(zip(los or [], his or [], strict=True)):
                    if lo > end:
                        out.append(t[at:lo])
                        spans_ += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                    at = end
                out.append(t[at:])
                n_bytes.append(len(t))
                n_removed.append(removed)
                n_spans.append(spans_)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return small_batches(both).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
