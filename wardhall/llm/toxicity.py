"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a bag of its character n-grams with word ends marked, each hashed to a row of an embedding table; a text
is the average of its words' vectors, and a linear softmax over it gives the probability of either label.  Table
and softmax are trained jointly in numpy.  A misspelt word shares most n-grams with the word it is meant to be.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import decoded, pieces, spaced_code_points
from .frames import by_batch, held_out, keys_and_text, labelled_sample, table
from .words import _mix

THRESHOLD = 0.3
_ORDERS = (3, 4, 5)
#: Averages are scaled so that a few words in hundreds move the softmax at the usual rates.
_SCALE = 50.0
_PIECE = 1 << 18


def subwords(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table row, share of its word, text) of each n-gram, and the words of each text.

    A word stands between single spaces, which mark its ends; an n-gram lies within a word and its ends.
    """
    cp, doc = spaced_code_points(texts, "alnum")
    space = cp == 32
    word = np.cumsum(space)
    start = np.flatnonzero(space[:-1] & ~space[1:]) if len(cp) else np.empty(0, np.int64)
    n_words = np.bincount(doc[start], minlength=len(texts))
    rows, words, docs = [], [], []
    for n in _ORDERS:
        m = max(0, len(cp) - n + 1)
        h = np.full(m, n, dtype=np.uint64)
        broken = np.zeros(m, dtype=bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + cp[j : j + m]
            if 0 < j < n - 1:
                broken |= space[j : j + m]
        ok = ~broken
        rows.append((_mix(h[ok]) % np.uint64(buckets)).astype(np.int64))
        words.append(word[1 : 1 + m][ok])
        docs.append(doc[:m][ok])
    w = np.concatenate(words)
    share = 1.0 / np.bincount(w, minlength=1)[w] if len(w) else np.empty(0)
    return np.concatenate(rows), share, np.concatenate(docs), n_words


class SubwordSoftmax:
    """``table`` (buckets by dimensions), ``weight`` (dimensions by labels) and ``bias``."""

    def __init__(self, buckets: int = 1 << 18, size: int = 4, seed: int = 11):
        self.buckets = buckets
        self.table = np.zeros((buckets, size))  # no saddle to leave: the softmax is random, so the first step moves the table
        self.weight = np.random.default_rng(seed).normal(0, 1, (size, 2))
        self.bias = np.zeros(2)

    def fit(self, texts: list[str], labels: list[int], epochs: int = 12, steps: int = 1600, rate: float = 0.3, seed: int = 5, decay: float = 1e-5) -> SubwordSoftmax:
        """Adagrad over shuffled minibatches of whole texts; a small sample is gone over until about ``steps`` are taken.

        A step updates, and lets decay, the table rows of its texts only.  Rows that no text of the sample has are zero.
        """
        if not texts:
            return self
        rows, shares = [], []
        for text in texts:
            row, share, _, n_words = subwords([text], self.buckets)
            row, where = np.unique(row, return_inverse=True)
            rows.append(row)
            shares.append(np.bincount(where, share, minlength=len(row)) * (_SCALE / max(1, n_words[0])))
        known = np.unique(np.concatenate(rows))
        rows = [np.searchsorted(known, r) for r in rows]
        table = np.ascontiguousarray(self.table[known].T, dtype=np.float32)
        y = np.array(labels)
        rng = np.random.default_rng(seed)
        g_table, g_weight, g_bias = np.full(len(known), 1e-6, np.float32), np.full(self.weight.shape, 1e-6), np.full(2, 1e-6)
        buffer, step, fade, root = np.zeros((32, len(known)), np.float32), np.empty_like(table), np.empty_like(table), np.empty_like(g_table)
        for _ in range(max(epochs, min(300, -(-steps * 32 // len(y))))):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 32):
                some = order[at : at + 32]
                bags = buffer[: len(some)]
                for b, i in zip(bags, some, strict=True):
                    b[rows[i]] = shares[i]
                mean = bags @ table.T
                z = mean @ self.weight + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                err = (np.eye(2)[y[some]] - p) / len(some)
                step_w, step_b = mean.T @ err, err.sum(axis=0)
                np.matmul((self.weight @ err.T).astype(np.float32), bags, out=step)
                np.multiply(table, decay * (step[0] != 0), out=fade)
                step -= fade
                np.multiply(step, step, out=fade)
                g_table += fade.mean(axis=0, out=root)
                np.sqrt(g_table, out=root)
                step /= root
                step *= rate
                table += step
                for b, i in zip(bags, some, strict=True):
                    b[rows[i]] = 0
                g_weight += step_w**2
                self.weight += rate * step_w / np.sqrt(g_weight)
                g_bias += step_b**2
                self.bias += rate * step_b / np.sqrt(g_bias)
        self.table = np.zeros_like(self.table)
        self.table[known] = table.T
        return self

    def shift_prior(self, sample: float, table: float) -> SubwordSoftmax:
        """Moves the bias from the share of label 1 in the sample to its share in the table."""
        if 0 < sample < 1 and 0 < table < 1:
            self.bias[1] += float(np.log(table / (1 - table)) - np.log(sample / (1 - sample)))
        return self

    def logits(self, texts: list[str]) -> np.ndarray:
        """Log odds of label 1; the bias alone decides a text without words.  A long text is averaged over pieces that end between words."""
        row_logit = self.table @ (self.weight[:, 1] - self.weight[:, 0]) * _SCALE
        total, words = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, some in pieces(texts, _PIECE, "alnum"):
            row, share, doc, n_words = subwords(some, self.buckets)
            np.add.at(total, owner, np.bincount(doc, row_logit[row] * share, minlength=len(some)))
            np.add.at(words, owner, n_words)
        return total / np.maximum(words, 1) + (self.bias[1] - self.bias[0])

    def score(self, texts: list[str]) -> list[float]:
        """Probability of label 1."""
        return (1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))).tolist()


def lowest_cut(logits: np.ndarray, labels: np.ndarray, false_alarms: float) -> float:
    """The log odds from which on a text is taken for toxic: as low as at most that share of the other texts allows."""
    x = np.sort(logits[labels == 0])[::-1]
    most = int(false_alarms * len(x))  # so many may stand above
    return float((x[most - 1] + x[most]) / 2 if 0 < most < len(x) else x[0] + 1e-6)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_label: int = 2000, max_chars: int = 20_000, threshold: float = THRESHOLD, false_alarms: float = 0.05) -> SubwordSoftmax:
    """Fits on a bounded sample: about ``per_label`` documents of each label, of ``max_chars`` characters at most, none held out.

    The bias is set on a third of the sample, ids whose crc32 leaves 0 modulo 4, by a model trained on the others, so that
    the share ``false_alarms`` of its other texts reaches ``threshold``, as averages over whole texts dilute single words.
    Then all of the sample is trained on.  If either part lacks a label, the bias follows the table's share of toxic rows.

    Rows of ``labels`` without id or with another label than 0 or 1 are left out; of an id's several labels the largest holds.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = labelled_sample(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), known, "toxic", per_label, max_chars)
    apart = [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in some]
    train, rest = ([r for r, a in zip(some, apart, strict=True) if a == side] for side in (False, True))
    if all(len({r["toxic"] for r in part}) == 2 for part in (train, rest)):
        model = SubwordSoftmax().fit([r["text"] for r in train], [int(r["toxic"]) for r in train])
        cut = lowest_cut(model.logits([r["text"] for r in rest]), np.array([int(r["toxic"]) for r in rest]), false_alarms)
        whole = SubwordSoftmax().fit([r["text"] for r in some], [int(r["toxic"]) for r in some])
        whole.bias[1] += float(np.log(threshold / (1 - threshold))) - cut
        return whole
    share = known.filter(~held_out("doc_id")).agg(F.avg("toxic")).first()[0] or 0.0
    model = SubwordSoftmax().fit([r["text"] for r in some], [int(r["toxic"]) for r in some])
    return model.shift_prior(sum(r["toxic"] for r in some) / max(1, len(some)), share)


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Reads the whole text, however long, in pieces that end between words.  A null, empty or wordless text gets the score
    of the bias, the share of label 1; bytes that are no UTF-8 count as replacement characters.  Equal texts have equal
    scores, rows with the same id stay apart; a null id is kept and not held out; an empty table gives no rows; other
    columns are not read.  An unfitted model (no labels) scores every text near 0.5.
    """

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        scores = model.score([decoded(t) for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(keys_and_text(docs, key, text, held_out(docs[key]).alias("held_out")), work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
