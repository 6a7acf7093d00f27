"""Quality rules: base counts, and a linear-chain conditional random field over a text's lines.

The field labels each line content or boilerplate: emissions are weights of discretised line features, one weight
for each pair of neighbouring labels, decoded by Viterbi.  The share of words in content lines decides retention.

Lines are labelled one by one for the fit.  Lines of documents of good quality are content, but those that several of
them hold between different neighbours are boilerplate, as are lines of documents of bad quality and generated menus,
notices and markup.  Runs of the latter are set into, before and after the former, so that the field learns where a text
changes from one to the other.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .frames import by_batch, held_out, keys_and_text, labelled_sample, table
from .words import SPACED, Words, batches, grams

CONTENT, BOILERPLATE = 0, 1
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASSES = {
    "symbol": _SYMBOL,
    "upper": np.array([0x41 <= b <= 0x5A for b in range(256)]),
    "lower": np.array([0x61 <= b <= 0x7A for b in range(256)]),
    "digit": np.array([0x30 <= b <= 0x39 for b in range(256)]),
    "shout": np.array([b in b"!?" for b in range(256)]),
    "high": np.array([b >= 0xC0 for b in range(256)]),
}
_EDGES = (0.01, 0.05, 0.15, 0.3, 0.6)
#: Binary features of a line: five buckets and one for zero of each of seven ratios, five word counts, and a bias.
WIDTH = 7 * (len(_EDGES) + 1) + 5 + 1


class Lines:
    """Lines with a word of a batch of texts: text of each, words, feature columns that are on."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, SPACED, lower=False)
        self.words = w
        h = w.hashes()
        self.hash = h
        buf = w.buf
        newline = np.flatnonzero(buf == 10)
        start = np.concatenate([[0], newline + 1])
        end = np.concatenate([newline, [len(buf)]])
        doc = np.searchsorted(w.offset, start, "right") - 1
        first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        some = last > first
        self.start, self.end, self.doc, first, last = start[some], end[some], doc[some], first[some], last[some]
        self.n_words = last - first
        size = np.maximum(1, self.end - self.start)
        ratios = []
        for mark in _CLASSES.values():
            total = np.concatenate([[0], np.cumsum(mark[buf], dtype=np.int64)])
            ratios.append((total[self.end] - total[self.start]) / size)
        same = np.concatenate([[0], np.cumsum(np.concatenate([[0], (h[1:] == h[:-1]).astype(np.int64)]))]) if len(h) else np.zeros(1, np.int64)
        ratios.append((same[last] - same[first + 1]) / np.maximum(1, self.n_words))
        cells = []
        base = 0
        for r in ratios:
            cells.append(base + np.where(r == 0, 0, 1 + np.searchsorted(_EDGES, r, "right").clip(0, len(_EDGES) - 1)))
            base += len(_EDGES) + 1
        cells.append(base + np.searchsorted((2, 4, 8, 16), self.n_words, "right"))
        cells.append(np.full(len(size), WIDTH - 1))
        self.cells = np.stack(cells, axis=1) if len(size) else np.zeros((0, 9), dtype=np.int64)

    def of(self) -> tuple[np.ndarray, np.ndarray]:
        """First line of each text and one past it."""
        n = len(self.words.count)
        return np.searchsorted(self.doc, np.arange(n)), np.searchsorted(self.doc, np.arange(n), "right")


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class LineField:
    """Weights of the field: ``emit`` (features by labels) and ``move`` (label to label)."""

    def __init__(self) -> None:
        self.emit = np.zeros((WIDTH, 2))
        self.move = np.zeros((2, 2))

    def fit(self, texts: list[bytes], labels: list[list[int]], rounds: int = 60, rate: float = 1.5, ridge: float = 1e-3) -> LineField:
        """Maximum likelihood by gradient ascent; ``labels`` has a label for each line with a word of each text."""
        if not texts:
            return self
        lines = Lines(texts)
        lo, hi = lines.of()
        longest = 64
        runs = [(at, min(at + longest, b), y[at - a : at - a + longest]) for a, b, y in zip(lo.tolist(), hi.tolist(), labels, strict=True) for at in range(a, b, longest)]
        if not runs:
            return self
        n, t = len(runs), max(b - a for a, b, _ in runs)
        where = np.zeros((n, t), dtype=np.int64)
        live = np.zeros((n, t), dtype=bool)
        gold = np.zeros((n, t), dtype=np.int64)
        for i, (a, b, y) in enumerate(runs):
            where[i, : b - a], live[i, : b - a], gold[i, : b - a] = np.arange(a, b), True, y
        cells = lines.cells[where]
        total = live.sum()
        share = np.array([max(1, (live & (gold == k)).sum()) / total for k in (0, 1)])
        weight = (0.5 / share)[gold] * live
        for _ in range(rounds):
            scores = self.emit[cells].sum(axis=2)
            fore = np.zeros((n, t, 2))
            back = np.zeros((n, t, 2))
            fore[:, 0] = scores[:, 0]
            for i in range(1, t):
                step = _logsum(fore[:, i - 1, :, None] + self.move[None], 1) + scores[:, i]
                fore[:, i] = np.where(live[:, i, None], step, fore[:, i - 1])
            for i in range(t - 2, -1, -1):
                step = _logsum(self.move[None] + (scores[:, i + 1] + back[:, i + 1])[:, None, :], 2)
                back[:, i] = np.where(live[:, i + 1, None], step, 0)
            z = _logsum(fore[:, -1], 1)
            p = np.exp(fore + back - z[:, None, None])
            diff = (np.eye(2)[gold] - p) * weight[:, :, None]
            some = diff[live]
            step = sum(np.stack([np.bincount(on, some[:, k], minlength=WIDTH) for k in (0, 1)], axis=1) for on in cells[live].T)
            both = np.exp(fore[:, :-1, :, None] + self.move + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None])
            seen = np.eye(2)[gold[:, :-1]][:, :, :, None] * np.eye(2)[gold[:, 1:]][:, :, None, :]
            pair = ((seen - both) * (weight[:, 1:] * live[:, 1:])[:, :, None, None]).sum(axis=(0, 1))
            self.emit += rate * (step / total - ridge * self.emit)
            self.move += rate * (pair / total - ridge * self.move)
        return self

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the likeliest labels of one text's lines."""
        if not len(scores):
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = scores.tolist()
        a, b = rows[0]
        back: list[tuple[int, int]] = []
        for x, y in rows[1:]:
            aa, ba, ab, bb = a + m00, b + m10, a + m01, b + m11
            back.append((int(ba > aa), int(bb > ab)))
            a, b = max(aa, ba) + x, max(ab, bb) + y
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def repeated_words(g: np.ndarray, n: int, k: int) -> int:
    """Words in k-word windows that a text holds twice or more; ``g`` has the windows' hashes."""
    if n < k:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(g), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(texts: list[bytes], field: LineField, min_words: int, max_repeat: int, min_content: float, window: int) -> list[dict]:
    """The counts and the verdict on each of a batch of texts."""
    lines = Lines(texts)
    w = lines.words
    g = grams(lines.hash, window)
    lo, hi = lines.of()
    high = (w.buf & 0xC0) == 0x80  # bytes that go on a code point
    total = np.concatenate([[0], np.cumsum(high, dtype=np.int64)])
    chars = (w.end - w.start) - (total[w.end] - total[w.start])
    char_sum = np.concatenate([[0], np.cumsum(chars)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.buf], dtype=np.int64)])
    scores = field.emit[lines.cells].sum(axis=1) if len(lines.cells) else np.zeros((0, 2))
    out = []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        n = b - a
        seen = [w.buf[s:e].tobytes() for s, e in zip(lines.start[lo[i] : hi[i]].tolist(), lines.end[lo[i] : hi[i]].tolist(), strict=True)]
        n_repeat = repeated_words(g[a : a + max(0, n - window + 1)], n, window)
        failed = n < min_words or 100 * n_repeat > max_repeat * n
        labels = np.array(field.decode(scores[lo[i] : hi[i]]), dtype=np.int64)
        content = int(lines.n_words[lo[i] : hi[i]][labels == CONTENT].sum()) / n if n else 0.0
        out.append({
            "n_words": n, "word_chars": int(char_sum[b] - char_sum[a]), "n_symbols": int(symbols[w.offset[i + 1]] - symbols[w.offset[i]]) if i + 1 < len(texts) else int(symbols[-1] - symbols[w.offset[i]]),
            "n_dup_lines": len(seen) - len(set(seen)), "n_repeat_words": n_repeat, "base_failed": failed, "content_share": content, "kept": not failed and content >= min_content,
        })
    return out


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]


def planted_line(rng: random.Random) -> str:
    """An invented menu, notice, link list or line of markup."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    title = lambda: word().capitalize()
    return rng.choice((
        lambda: " | ".join(title() for _ in range(rng.randint(3, 14))), lambda: " > ".join(title() for _ in range(rng.randint(2, 5))), lambda: f"<div class=\"{word()}\"><a href=\"/{word()}\">{title()}</a></div>",
        lambda: f"\u00a9 {rng.randint(1998, 2030)} {title()} {title()} | {title()} & {title()}", lambda: "*** " + " ".join(word().upper() for _ in range(rng.randint(2, 8))) + "!!! ***", lambda: " ".join(f"#{word()}" for _ in range(rng.randint(3, 9))),
        lambda: "| " + " | ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(3, 8))) + " |", lambda: "$$$ " + " $$$ ".join(word() for _ in range(rng.randint(2, 8))) + " $$$",
    ))()


def line_examples(good: list[str], bad: list[str], seed: int = 17, spread: int = 3) -> tuple[list[str], list[list[int]]]:
    """Texts and a label for each of their lines.  A line of ``spread`` good texts with as many different neighbours is boilerplate."""
    rng = random.Random(seed)
    places: dict[str, set] = {}
    for t in dict.fromkeys(good):
        lines = _lines(t)
        for before, line, after in zip([None, *lines], lines, [*lines[1:], None], strict=False):
            places.setdefault(line, set()).add((before, after))
    junk = [_lines(t) for t in dict.fromkeys(bad)]
    junk = [x for x in junk if x]

    def run() -> list[str]:
        if junk and rng.random() < 0.6:
            lines = rng.choice(junk)
            at = rng.randrange(len(lines))
            return lines[at : at + rng.randint(1, 8)]
        return [planted_line(rng) for _ in range(rng.randint(1, 6))]

    texts, labels = [], []
    for t in good:
        lines = _lines(t)
        own = [BOILERPLATE if len(places[x]) >= spread else CONTENT for x in lines]
        for at in sorted({*rng.sample(range(len(lines) + 1), min(len(lines) + 1, rng.randint(0, 2)))}, reverse=True):
            more = run()
            lines[at:at], own[at:at] = more, [BOILERPLATE] * len(more)
        texts.append("\n".join(lines))
        labels.append(own)
    for t in bad:
        texts.append("\n".join(_lines(t)))
        labels.append([BOILERPLATE] * len(_lines(t)))
    return texts, labels


def fit_field(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_label: int = 300, max_chars: int = 20_000) -> LineField:
    """Fits on a bounded sample of about ``per_label`` documents of each quality label, of ``max_chars`` characters at most, none held out; their lines are labelled one by one.

    Rows of ``labels`` without id or with another label than 0 or 1 are left out; of an id's several labels the least holds.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg({"quality": "min"}).toDF("doc_id", "quality")
    some = labelled_sample(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), known, "quality", per_label, max_chars)
    texts, gold = line_examples([r["text"] for r in some if r["quality"] == 1], [r["text"] for r in some if r["quality"] == 0])
    field = LineField().fit([t.encode("utf-8", "surrogatepass") for t in texts], gold)
    share = known.filter(~held_out("doc_id")).agg({"quality": "avg"}).first()[0]
    if share and 0.5 < share < 1:  # the fit weighs both labels alike; most documents are content, but not most lines of the examples
        field.emit[WIDTH - 1, CONTENT] += 0.75 * float(np.log(share / (1 - share)))
    return field


def quality_rules(docs: DataFrame, field: LineField, key: str = "doc_id", text: str = "text", min_words: int = 10, max_repeat: int = 20, min_content: float = 0.5, window: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    A text fails the base with fewer than ``min_words`` words or with more than ``max_repeat`` per cent of its words
    in repeated windows; one that passes is kept if ``min_content`` of its words stand in content lines.  Null and
    empty texts have no words and fail.  Rows with the same id stay apart; a null id is kept; an empty table gives no
    rows; other columns are not read.  A text of any length is read and decoded whole; of equally likely labellings that
    with earlier content lines wins.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found: list[dict] = []
        for _, some in batches(t or b"" for t in batch.column("text").to_pylist()):
            found += judge(some, field, min_words, max_repeat, min_content, window)
        return {"doc_id": batch.column("doc_id"), **{n: [f[n] for f in found] for n in names}}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(keys_and_text(docs, key, text), work, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_field(docs, table(spark, sf_dir, "labels")))
