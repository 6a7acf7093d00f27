"""Benchmark decontamination by winnowing.

Of every six neighbouring 5-gram hashes the least is kept, so any ten words that two texts share have a kept
fingerprint in common.  Of the other five shared words at least three stand on one side of it: a fingerprint is joined
with the three words after it, and with the three before, so that a 5-gram which is common everywhere meets only where it
goes on alike.  Each carries the hashes of the words around it, and a hit is extended over them in both directions.  Ten
equal words or more are a contaminated run.  Items shorter than a window are one fingerprint of their own length.

A bitmap over the benchmark's fingerprints, sized by their number up to a bound, drops most training fingerprints where
they arise; what passes goes through an ordinary join, so neither side is ever held by one machine.  Items that agree in
all words around a fingerprint are one row of that join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import ROWS, by_batch, small_batches, table
from .shared import written
from .words import ALNUM, Words, batches, grams

WINDOW = 10
K = 5
#: Least and most bits of the bitmap; 16 for each fingerprint of the benchmark between them.
_BITS, _MOST_BITS = 1 << 16, 1 << 27
_SIDES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0676A9A99))
_HIT = "doc_id string, tag long, key long, pos long, short long, ctx binary"


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: in each run of ``width`` hashes the least, of equal ones the last."""
    n = len(g) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = g[:n].copy()
    for s in range(1, width):
        np.minimum(least, g[s : s + n], out=least)
    at = np.arange(n)
    for s in range(1, width):
        at = np.where(g[s : s + n] == least, np.arange(s, s + n), at)
    return np.unique(at)


def fingerprints(h: np.ndarray, window: int, k: int, shorts: list[int], whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
    """(words of a short one or 0, keys, positions, contexts of positions) of one text's word hashes: the winnowed k-grams with half of a window's other words on either side, and the grams of each short length.

    ``whole``: a text shorter than a window is one fingerprint of its own length (a benchmark item), else each of
    ``shorts`` is looked for at every place (a document).
    """
    n, reach = len(h), window - k
    if n >= window:
        at = winnow(grams(h, k), reach + 1)
        half = -(-reach // 2)
        wide = grams(h, k + half)
        padded = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(reach, np.uint64)])
        for first, salt in ((at, _SIDES[0]), (at - half, _SIDES[1])):
            ok = (first >= 0) & (first < len(wide))
            yield 0, wide[first[ok]] ^ salt, at[ok], lambda some: padded[some[:, None] + np.arange(2 * reach + k)]
    for m in [n] if whole and 0 < n < window else [] if whole else [s for s in shorts if s <= n]:
        g = grams(h, m) ^ np.uint64(0x5851F42D4C957F2D * m & (1 << 64) - 1)
        wide = np.arange(m)
        yield m, g, np.arange(len(g)), lambda some, wide=wide: np.pad(h[some[:, None] + wide], ((0, 0), (0, 2 * reach + k - len(wide))))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
    for first, some in batches(t or b"" for t in batch.column("text").to_pylist()):
        yield first, Words(some, ALNUM, lower=True)


def _emit(df: DataFrame, window: int, k: int, shorts: list[int], whole: bool, packed: Broadcast | None) -> DataFrame:
    """Fingerprints of a table with doc_id (string), tag and text; with a bitmap, those that it marks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if packed is None else packed.value
        for big in stream:
            for cut in range(0, big.num_rows, ROWS):
                batch = big.slice(cut, ROWS)
                row, key, pos, short, ctx = [], [], [], [], []
                for first, w in _texts(batch):
                    h = w.hashes()
                    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                        for m, g, at, around in fingerprints(h[a:b], window, k, shorts, whole):
                            if bitmap is not None:
                                slot = (g % np.uint64(8 * len(bitmap))).astype(np.int64)
                                ok = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                                g, at = g[ok], at[ok]
                            if len(g):
                                row.append(np.full(len(g), first + i))
                                key.append(g.view(np.int64))
                                pos.append(at)
                                short.append(np.full(len(g), m))
                                ctx += [c.tobytes() for c in around(at)]
                if row:
                    rows = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(np.concatenate(key)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(short)), pa.array(ctx, pa.binary())], names=["doc_id", "tag", "key", "pos", "short", "ctx"])

    return small_batches(df).mapInArrow(run, _HIT)


def _extended(joined: DataFrame, window: int, k: int) -> DataFrame:
    """Runs of equal words around each joined pair: doc_id, tag, lo, hi, items."""
    reach = window - k

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(n, -1) for c in ("ctx", "item_ctx"))
        pos, short = (np.asarray(batch.column(c)) for c in ("pos", "short"))
        same = (a == b) & (a != 0)
        left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
        right = np.cumprod(same[:, reach + k :], axis=1).sum(axis=1)
        long = same[:, reach : reach + k].all(axis=1) & (left + right + k >= window) & (short == 0)
        brief = (short > 0) & (a == b).all(axis=1)
        lo = np.where(short > 0, pos, pos - left)
        hi = np.where(short > 0, pos + short, pos + k + right)
        keep = pa.array(np.flatnonzero(long | brief))
        columns = [batch.column("doc_id"), batch.column("tag"), pa.array(lo), pa.array(hi), batch.column("items")]
        return pa.RecordBatch.from_arrays([c.take(keep) for c in columns], names=["doc_id", "tag", "lo", "hi", "items"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(work, (b for b in stream if b.num_rows))

    return small_batches(joined).mapInArrow(run, "doc_id string, tag long, lo long, hi long, items array<string>")


def _tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id as text, a hash that tells apart rows of one id, and the text's bytes."""
    return docs.select(docs[key].cast("string").alias("doc_id"), F.xxhash64(docs[text], docs[key]).alias("tag"), docs[text].cast("binary").alias("text"))


def contaminated_runs(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Runs of a document's words that hold windows of an item: doc_id (string), tag, lo, hi, items; an item without id adds none to items."""
    items = bench.select(bench[item].cast("string").alias("doc_id"), F.lit(0).cast("long").alias("tag"), bench[item_text].cast("binary").alias("text")).filter("text is not null")
    marks = written(_emit(items, window, k, [], True, None))
    shorts = [r[0] for r in marks.filter("short > 0").select("short").distinct().collect()]  # fewer than a window has words
    bits = min(_MOST_BITS, max(_BITS, 1 << (16 * marks.count()).bit_length()))
    slot = F.pmod("key", F.lit(bits)) + 1
    parts = marks.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # bits / 8 bytes at most
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for part, some in parts:
        bitmap[(part - 1) * len(some) : part * len(some)] = np.frombuffer(some, np.uint8)
    mine = _emit(_tagged(docs, key, text), window, k, shorts, False, docs.sparkSession.sparkContext.broadcast(bitmap))
    theirs = marks.groupBy("key", "short", F.col("ctx").alias("item_ctx")).agg(F.collect_set("doc_id").alias("items"))
    return _extended(mine.join(theirs, ["key", "short"]).select("doc_id", "tag", "pos", "ctx", "item_ctx", "short", "items"), window, k)


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without text or words have no window; words of an item without id are hit, but it counts among no items.  Rows with the same
    id stay apart, equal rows get equal results, a null id is kept; an item_id that several items share counts once;
    an empty table or an empty benchmark gives no rows or no hits; other columns are not read.  A text of any length is
    read whole; of equal least hashes in a run the last is the fingerprint, on both sides alike.
    """
    runs = contaminated_runs(docs, bench, key, text, item, item_text, window, k)
    spans = F.array_sort(F.collect_set(F.struct("lo", "hi")))
    ends = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(s["lo"], a["end"]))).alias("n"), F.greatest(a["end"], s["hi"]).alias("end")))
    hits = runs.groupBy("doc_id", "tag").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).select("doc_id", "tag", ends["n"].alias("n_hit"), "items")
    kind = docs.schema[key].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "n_words": [int(c) for _, w in _texts(batch) for c in w.count]}

    sized = by_batch(_tagged(docs, key, text), count, "doc_id string, tag long, n_words long")
    full = sized.join(hits, sized["doc_id"].eqNullSafe(hits["doc_id"]) & (sized["tag"] == hits["tag"]), "left")
    items = F.coalesce(hits["items"], F.array().cast("array<string>"))
    n_hit = F.coalesce(hits["n_hit"], F.lit(0).cast("long"))
    return full.select(sized["doc_id"].cast(kind).alias("doc_id"), sized["n_words"], n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its columns, without the rows that hold a window of a benchmark item, with an id or without.

    Null and empty texts hold none and stay; repeated rows go or stay alike, a null id is judged as any other; an empty
    table gives no rows, an empty benchmark takes none; columns may have any name.
    """
    runs = contaminated_runs(docs, bench, key, text).select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct()
    names = docs.columns
    whole = docs.select(docs[key].cast("string").alias("doc_id"), F.xxhash64(docs[text], docs[key]).alias("tag"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    left = whole.join(runs, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag")), "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
