"""N-gram Jaccard join with a count-vector R-tree.

Texts become sets of word shingles.  Documents with equal sets are one class, and only a class's first document goes
on.  Candidates meet by prefix: of two similar sets, the rarest shingles of each share one.  A shingle's first
document is its pivot, and a document joins the group of every pivot of its prefix, so each candidate pair meets in
a group.  In a group, shingles are hashed into count groups; a set is the point of its counts, an R-tree holds the
points, and the summed coordinate minima bound a pair's overlap from above.  That happens twice: on vectors that travel
without the text, and again among the documents that still have a partner.  Surviving pairs are verified on
the sets.  The prefixes only decide which documents meet; whether two may link, and so which texts move, is the tree's to
say: of 0.5 GB of documents 1.38 million rows met in groups, and the tree left 0.34 million.

A search goes from a document to those not yet reached, so a group of many copies costs one edge a copy, and no link
between different components is lost.  Large groups are cut into tiles; each tile is searched by itself, and each pair of
tiles across only.  Prefix shingles that make up a thousandth of all are paired with their pivot where they lie.
Components are found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import ROWS, by_batch, small_batches, table
from .shared import components, spent, written
from .words import _mix, batches, shingle_sets

SHINGLE, SIMILARITY = 4, 85
#: Least and most buckets of the sketch of how common shingles are; one for 8 KB of text between them.
_BUCKETS, _MOST_BUCKETS = 1 << 18, 1 << 21
_GROUPS = 256
_HOT = 1000
#: Groups of the count vectors that travel with a document, before its text does.
_COARSE = 256
_TILE_ROWS, _TILE_SHINGLES = 2048, 1_000_000
_SLOTS = 1 << 20


class CountTree:
    """R-tree over count vectors, packed by halving on the coordinate that varies most; nodes keep upper corners and least sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16, fan: int = 4):
        self.points, self.sizes = points, sizes
        order: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            some = stack.pop()
            if len(some) <= leaf:
                order.append(some)
                continue
            axis = int(points[some].var(axis=0).argmax())
            some = some[np.argsort(points[some, axis], kind="stable")]
            stack += [some[len(some) // 2 :], some[: len(some) // 2]]
        self.members = order
        corner = np.array([points[o].max(axis=0) for o in order])
        least = np.array([sizes[o].min() for o in order])
        self.levels = [(corner, least)]
        while len(corner) > fan:
            cut = np.arange(0, len(corner), fan)
            corner, least = np.maximum.reduceat(corner, cut), np.minimum.reduceat(least, cut)
            self.levels.append((corner, least))
        self.fan = fan

    def search(self, point: np.ndarray, size: int, similarity: int) -> np.ndarray:
        """Points whose overlap bound with this one reaches the similarity."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[nodes], point).sum(axis=1)
            nodes = nodes[bound * (100 + similarity) >= similarity * (size + least[nodes])]
            if depth:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if not len(nodes):
            return nodes
        some = np.concatenate([self.members[i] for i in nodes])
        bound = np.minimum(self.points[some], point).sum(axis=1)
        return some[bound * (100 + similarity) >= similarity * (size + self.sizes[some])]


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= similarity * union."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < similarity * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


def count_vector(s: np.ndarray, groups: int) -> np.ndarray:
    """Shingles of a set by hash group."""
    return np.bincount((_mix(s) % np.uint64(groups)).astype(np.int64), minlength=groups)


def with_partner(points: np.ndarray, sizes: np.ndarray, similarity: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which points have another whose overlap bound reaches the similarity; with ``side``, another of the other side."""
    out = np.zeros(len(points), dtype=bool)
    if side is not None:
        for a, b in ((side, ~side), (~side, side)):
            here, there = np.flatnonzero(a), np.flatnonzero(b)
            if len(there):
                tree = CountTree(points[there], sizes[there])
                for i in here[~out[here]].tolist():
                    near = tree.search(points[i], int(sizes[i]), similarity)
                    out[there[near]] = True
                    out[i] = len(near) > 0
    elif len(points) > 1:
        tree = CountTree(points, sizes)
        for i in range(len(points)):
            if not out[i]:
                near = tree.search(points[i], int(sizes[i]), similarity)
                near = near[near != i]
                out[near] = True
                out[i] = len(near) > 0
    return out


def spanning_links(sets: list[np.ndarray], similarity: int, groups: int = _GROUPS, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what all links among the sets connect; with ``side``, what all links between the two sides connect."""
    if len(sets) < 2 or side is not None and side.all() | ~side.any():
        return []
    points = np.stack([count_vector(s, groups) for s in sets]).astype(np.int32)
    sizes = np.array([len(s) for s in sets])
    halves = [np.arange(len(sets))] * 2 if side is None else [np.flatnonzero(side), np.flatnonzero(~side)]
    trees = [CountTree(points[h], sizes[h]) for h in (halves if side is not None else halves[:1])]
    fresh = np.ones(len(sets), dtype=bool)
    out = []
    for first in range(len(sets)):
        if not fresh[first]:
            continue
        fresh[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            other = 0 if side is None else int(side[i])  # halves[1] is where side is false
            near = halves[other][trees[other].search(points[i], int(sizes[i]), similarity)]
            for j in near[fresh[near]].tolist():
                if linked(sets[i], sets[j], similarity):
                    fresh[j] = False
                    queue.append(j)
                    out.append((i, j))
    return out


def _runs(*keys: np.ndarray) -> Iterator[slice]:
    """Runs of equal keys of sorted rows."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = [*np.flatnonzero(new).tolist(), n]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield slice(lo, hi)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for _, some in batches(t or b"" for t in batch.column("text").to_pylist()):
        yield from shingle_sets(some, shingle)


def shingle_levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """How common shingles are, by hash bucket, from all documents: a byte for each bucket.  It only orders the shingles of a set."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(_MOST_BUCKETS, max(_BUCKETS, 1 << (size >> 13).bit_length()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, dtype=np.int64)
        for big in stream:
            for at in range(0, big.num_rows, ROWS):
                for s in _sets(big.slice(at, ROWS), shingle):
                    np.add.at(count, (s % np.uint64(buckets)).astype(np.int64), 1)
        some = np.flatnonzero(count)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(count[part])], names=["bucket", "n"])

    found = small_batches(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    levels = np.zeros(buckets, dtype=np.uint8)
    levels[found["bucket"].to_numpy()] = np.minimum(255, np.log2(found["n"].to_numpy() + 1) * 8)
    return levels


def _prefixes(docs: DataFrame, kind: str, shingle: int, similarity: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (hash of the set), tokens: the rarest shingles, of which similar sets share one; vec: coarse counts."""

    common = docs.sparkSession.sparkContext.broadcast(levels)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        levels = common.value
        n, s1, s2, tokens, vec = [], [], [], [], []
        for s in _sets(batch, shingle):
            n.append(len(s))
            s1.append(int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            s2.append(int(_mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            keep = len(s) - -(-similarity * len(s) // 100) + 1 if len(s) else 0
            level = levels[(s % np.uint64(len(levels))).astype(np.int64)]
            tokens.append(s[np.argsort(level, kind="stable")[:keep]].view(np.int64))
            vec.append(count_vector(s, _COARSE).astype("<u4").tobytes())
        return {"doc_id": batch.column("doc_id"), "n": n, "s1": s1, "s2": s2, "tokens": tokens, "vec": vec}

    return by_batch(docs, work, f"doc_id {kind}, n long, s1 long, s2 long, tokens array<long>, vec binary")


def _bucketed(rows: DataFrame, n: int, each: int) -> DataFrame:
    """Deals whole tiles into buckets of about ``each`` rows, so that small groups share a task's call."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("pivot", "one", "two"), F.lit(max(1, -(-n // each)))))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs without ASCII white space; a text with fewer words than a shingle is one shingle.
    The component is the least id that links reach.  Texts without words, and null texts, have no shingles and are
    components of their own.  Rows that share an id are one node: their components are one.  A row with a null id
    links with nothing and has a null component.  An empty table gives no rows; other columns are not read.  Texts of any
    length are whole sets; of equally common shingles those of the smaller hash come first, in every document alike.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("doc_id"), docs[text].cast("binary").alias("text"))
    levels = shingle_levels(source, shingle)
    rows = written(_prefixes(source, kind, shingle, similarity, levels))
    usable = rows.filter("n > 0 and doc_id is not null")
    classes = written(usable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("vec").alias("vec"), F.count("*").alias("c")))
    tokens = classes.select("rep", F.explode("tokens").alias("token"))
    counts = written(tokens.groupBy("token").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).filter("c > 1"))
    hot = counts.filter(F.col("c") * _HOT >= (counts.agg(F.sum("c")).first()[0] or 0)).select("token", "pivot")  # no more than _HOT
    apart = tokens.join(F.broadcast(hot.select("token")), "token", "left_anti").join(counts.select("token", "pivot"), "token")
    met = tokens.join(F.broadcast(hot), "token").select("pivot", "rep").union(apart.select("pivot", "rep")).distinct()
    members = met.join(classes.select("rep", "n", "vec"), "rep")
    members = written(members.select("pivot", "rep", "n", "vec"))
    tiles = F.ceil(F.greatest(F.count("*") / _TILE_ROWS, F.sum("n") / _TILE_SHINGLES)).cast("long")
    groups = members.groupBy("pivot").agg(tiles.alias("tiles"), F.count("*").alias("c")).filter("c > 1")
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles"))
    large = groups.filter(F.col("c") * _HOT >= members.count())  # no more than _HOT
    sized = members.join(F.broadcast(large), "pivot").unionByName(members.join(F.broadcast(large.select("pivot")), "pivot", "left_anti").join(groups, "pivot"))
    dealt = sized.select("pivot", "rep", "n", "vec", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("pivot", "rep", "n", "vec", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    dealt = _bucketed(dealt, members.count(), 4000)

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "one", "two", "rep"], kind="stable")
        points = np.frombuffer(b"".join(pdf["vec"]), dtype="<u4").reshape(len(pdf), -1).astype(np.int64)
        sizes = pdf["n"].to_numpy()
        keep = np.zeros(len(pdf), dtype=bool)
        one, two, mine = (pdf[c].to_numpy() for c in ("one", "two", "mine"))
        for run in _runs(pdf["pivot"].to_numpy(), one, two):
            side = None if one[run.start] == two[run.start] else mine[run] == one[run]
            keep[run] = with_partner(points[run], sizes[run], similarity, side)
        return pdf.loc[keep, ["pivot", "one", "two", "mine", "rep", "n"]]

    near = written(dealt.groupBy("bucket").applyInPandas(bound, f"pivot {kind}, one long, two long, mine long, rep {kind}, n long").distinct())
    spent(members)
    work = near.agg(F.count("*"), F.sum("n")).first()
    slots = near.select(F.pmod(F.xxhash64("rep"), F.lit(_SLOTS)).alias("slot")).distinct()  # so many rows at most
    wanted = source.filter("doc_id is not null").join(F.broadcast(slots), F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS)) == F.col("slot"), "left_semi")
    with_text = _bucketed(near, max(work[0], (work[1] or 0) // 250), 400).join(wanted.withColumnRenamed("doc_id", "rep"), "rep")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "one", "two", "rep"], kind="stable")
        rep, texts = pdf["rep"].to_numpy(), pdf["text"].to_list()
        one, two, mine = (pdf[c].to_numpy() for c in ("one", "two", "mine"))
        a, b = [], []
        for run in _runs(pdf["pivot"].to_numpy(), one, two):
            side = None if one[run.start] == two[run.start] else mine[run] == one[run]
            sets: list[np.ndarray] = []
            for _, some in batches(t or b"" for t in texts[run]):
                sets += shingle_sets(some, shingle)
            for i, j in spanning_links(sets, similarity, side=side):
                a.append(rep[run][i])
                b.append(rep[run][j])
        return pd.DataFrame({"a": a, "b": b})

    edges = with_text.groupBy("bucket").applyInPandas(find, f"a {kind}, b {kind}")
    # Equal sets under several ids are links as well, from the class's first id to itself; ids with several sets are one node.
    copied = classes.filter("c > 1").select("s1", "s2", "n", "rep", "c")
    big = copied.filter(F.col("c") * _HOT >= usable.count()).drop("c")  # no more than _HOT
    rest = usable.join(F.broadcast(big.drop("rep")), ["s1", "s2", "n"], "left_anti").join(copied.drop("c"), ["s1", "s2", "n"])
    same = usable.join(F.broadcast(big), ["s1", "s2", "n"]).select("doc_id", "rep").union(rest.select("doc_id", "rep")).toDF("a", "b").filter("a <> b")
    found = components(edges.union(same))
    joined = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, rows["doc_id"] == found["node"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with its columns, of each group of similar documents only the rows of the least id.

    Five words and a similarity of 0.8 are the usual measure of near duplicates.  Rows with a null id stay, as do
    texts without words.  Rows that share an id stay or go together; an empty table gives no rows; columns may have any
    name.
    """
    groups = similar_components(docs, key, text, shingle, similarity)
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    names = docs.columns
    whole = docs.select(docs[key].alias("doc_id"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    left = whole.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
