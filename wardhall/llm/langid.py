"""Language identification with language-bitmask n-gram filters.

Each language contributes its most frequent character n-grams, as many as every other.  One Bloom filter holds
them all, bit-sliced: a slot is a word with one bit for each language, so that the bitwise AND of an n-gram's
slots names all languages that contain it.  A text's n-grams are looked up, the bits of the answers counted by
language (the popcounts), the counts corrected for the filter's false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import cut, decoded, spaced_code_points
from .frames import ROWS, by_batch, fit_sample, held_out, keys_and_text, small_batches, table
from .words import _mix

UNDETERMINED = "und"
_K = 2  # slots of an n-gram


def _code_points(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    return spaced_code_points(texts, "letters")


def _ngrams(cp: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram, text) for each run of n code points within a text; n is at most 3, so 21 bits each fit."""
    m = max(0, len(cp) - n + 1)
    packed = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        packed = (packed << np.uint64(21)) | cp[j : j + m]
    same = doc[:m] == doc[n - 1 : n - 1 + m]
    return packed[same], doc[:m][same]


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)


class LanguageFilters:
    """The fitted filter: slots (words of language bits), languages, false-positive rate and hit rate of each."""

    def __init__(self, languages: list[str], slots: np.ndarray, false_rate: np.ndarray, hit_rate: np.ndarray, n: int):
        self.languages, self.slots, self.false_rate, self.hit_rate, self.n = languages, slots, false_rate, hit_rate, n

    @staticmethod
    def _places(grams: np.ndarray, slots: int) -> list[np.ndarray]:
        h = _mix(grams + np.uint64(1))
        return [(h & np.uint64(slots - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)]

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], n: int = 3, top: int = 600, slots: int = 1 << 16) -> LanguageFilters:
        """Of (text, language) pairs; ``top`` n-grams of each language enter the filter.  A slot has a 64-bit word for every 64 languages."""
        by: dict[str, list[str]] = {}
        for text, lang in rows:
            by.setdefault(lang, []).append(text)
        languages = sorted(by)
        filt = np.zeros((slots, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        counts = []
        for bit, lang in enumerate(languages):
            grams, count = np.unique(_ngrams(*_code_points(by[lang]), n)[0], return_counts=True)
            counts.append((grams, count))
            order = np.lexsort((grams, -count))[:top]
            for place in cls._places(grams[order], slots):
                np.bitwise_or.at(filt[:, bit // 64], place, np.uint64(1) << np.uint64(bit % 64))
        bits = [_bit(filt, b) for b in range(len(languages))]
        false_rate = np.array([float(b.mean()) ** _K for b in bits])
        out = cls(languages, filt, false_rate, np.ones(len(languages)), n)
        for b, (grams, count) in enumerate(counts):
            hit = _bit(out.masks(grams), b)
            raw = float((hit * count).sum()) / max(1, int(count.sum()))
            out.hit_rate[b] = max(1e-6, (raw - false_rate[b]) / (1 - false_rate[b]))
        return out

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the languages that contain each n-gram, false positives included."""
        a, b = self._places(grams, len(self.slots))
        return self.slots[a] & self.slots[b]

    def _hits(self, grams: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        mask = self.masks(grams)
        hits = [np.bincount(doc, weights=_bit(mask, b), minlength=n) for b in range(len(self.languages))]
        return np.bincount(doc, minlength=n).astype(float), np.stack(hits, axis=1) if hits else np.zeros((n, 0))

    def popcounts(self, texts: list[str], limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, hits by language) of each text; a text over ``limit`` is counted in pieces, each n-gram once."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        owner: list[int] = []
        for i, text in enumerate(texts):
            if len(text) > limit:
                total[i], hits[i] = self._long(text, limit)
            else:
                owner.append(i)
            if owner and (i + 1 == len(texts) or sum(len(texts[j]) for j in owner) > limit):
                total[owner], hits[owner] = self._hits(*_ngrams(*_code_points(texts[j] for j in owner), self.n), len(owner))
                owner = []
        if owner:
            total[owner], hits[owner] = self._hits(*_ngrams(*_code_points(texts[j] for j in owner), self.n), len(owner))
        return total, hits

    def _long(self, text: str, limit: int) -> tuple[float, np.ndarray]:
        """One text's counts: the last code points of a piece lead the next, whose first blank they end with."""
        total, hits, tail = 0.0, np.zeros(len(self.languages)), np.empty(0, np.uint64)
        for piece in cut(text, limit, "letters"):
            cp = _code_points([piece])[0]
            cp = np.concatenate([tail, cp[1:]]) if len(tail) else cp
            t, h = self._hits(_ngrams(cp, np.zeros(len(cp), np.int64), self.n)[0], np.zeros(max(0, len(cp) - self.n + 1), np.int64), 1)
            total, hits, tail = total + t[0], hits + h[0], cp[-(self.n - 1) :]
        return total, hits

    def predict(self, texts: list[str | None], batch_chars: int = 1 << 19) -> tuple[list[str], list[float]]:
        """(language or ``und``, share of the evidence) of each text; a longer text is counted piece by piece."""
        texts = [t or "" for t in texts]
        letters = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        total, hits = self.popcounts(texts, batch_chars)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        share = hits / np.maximum(total, 1)[:, None]
        fair = np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1) / self.hit_rate
        best = fair.argmax(axis=1)
        sums = fair.sum(axis=1)
        score = np.where(sums > 0, fair.max(axis=1) / np.where(sums > 0, sums, 1), 1 / len(self.languages))
        langs = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, np.where(letters, np.clip(score, 0, 1), 0.0).tolist()

    def identified(self, texts: list[str | None], min_fit: float) -> list[bool]:
        """Whether a text has letters and hits some language's n-grams at ``min_fit`` of that language's own rate or more.

        Without a learned language nothing can be told apart, and letters alone decide.
        """
        texts = [t or "" for t in texts]
        if not self.languages:
            return [any(map(str.isalpha, t)) for t in texts]
        total, hits = self.popcounts(texts)
        share = hits / np.maximum(total, 1)[:, None]
        fair = (share - self.false_rate) / (1 - self.false_rate) / self.hit_rate
        return [any(map(str.isalpha, t)) and bool(ok) for t, ok in zip(texts, (fair >= min_fit).any(axis=1), strict=True)]


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, max_chars: int = 20_000) -> LanguageFilters:
    """Fits on a bounded sample: about ``per_language`` documents of each language, of ``max_chars`` characters at most, none held out.

    Longer texts are learned from, by their first ``max_chars`` characters, only where a language has no shorter one.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    return LanguageFilters.fit([(r["text"], r["lang"]) for r in fit_sample(rows, "lang", per_language, max_chars)])


def identify_language(docs: DataFrame, model: LanguageFilters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Reads the whole text, however long, in pieces that count every n-gram once.  ``lang_pred`` is ``und`` with score 0
    where the text is null or has no letter; where letters match no language's n-grams, the first language with score
    1 / languages; of languages that fit equally well the first in order.  Bytes that are no UTF-8 count as replacement
    characters.  Repeated ids give repeated rows; a null id is kept and not held out; an empty table gives no rows; other
    columns are not read.
    """
    source = keys_and_text(docs, key, text, held_out(docs[key]).alias("held_out"))

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [decoded(t) for t in batch.column("text").to_pylist()]
        langs, scores = model.predict(texts)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(source, work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageFilters, text: str = "text", min_fit: float = 0.2) -> DataFrame:
    """Rows of ``docs`` whose language is identified, with all columns as they are; only texts travel to be judged.

    Rejected: null texts, texts without a letter, and texts that hit no language's n-grams at a fifth of the rate
    of that language's own texts.  Mixed languages stay.  Where no language was learned, every text with a letter stays.
    Repeated rows are kept or rejected alike, an empty table gives no rows, and columns may have any name.
    """
    small_batches(docs)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        out: list[bool] = []
        for at in range(0, len(texts), ROWS):
            out += model.identified([decoded(t) for t in texts.iloc[at : at + ROWS]], min_fit)
        return pd.Series(out, dtype=bool)

    return docs.filter(known(docs[text].cast("binary")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, fit_languages(docs))
