"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids, an end id after them, are cut at every multiple of the sequence length.  Full pieces are sequences
of their own; the last piece of each document is packed.  Documents are dealt at random into groups of bounded size
and each group is packed by itself: pieces by falling length, each into the first sequence that has room.  A
tournament tree over the free room of the sequences finds that one in logarithmic time.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import decoded
from .frames import by_batch, keys_and_text, table
from .shared import written

LENGTH = 1024
END = 0
GROUP = 4096
_TOKENIZERS: dict = {}
_BEYOND_LATIN = "[^\\x00-\u024f]"
_LONG_BLANK = r"\s{1000}"


class _Ids:
    """Ids of texts by a tokenizer file, as its own library gives them; None is the public 50k byte-level one.

    That vocabulary also exists as ranks, whose encoder gives the same ids more than three times as fast.  It takes texts
    of Latin letters only, where both libraries' Unicode classes agree beyond doubt, and none that spells out a token
    which the file adds to the vocabulary (such as an end mark), nor a run of a thousand blanks, whose pattern goes back
    over the whole run and fails on very long ones; the tokenizer file takes all others.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have tasks of their own
        from tokenizers import Tokenizer

        self.fast = None
        if path is None:
            import public_tokenizers as public
            import tiktoken

            path = public.path("byte_bpe_50k.json")
            with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.beyond = re.compile("|".join([_BEYOND_LATIN, _LONG_BLANK, *(re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values())]))

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not self.beyond.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _tokenizer(path: str | None) -> _Ids:
    """One for each process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Ids(path)
    return _TOKENIZERS[path]


class Tournament:
    """The free room of sequences; an inner node holds the most room below it."""

    def __init__(self, leaves: int, room: int):
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.most = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The first sequence with that much room, which the piece then takes."""
        most, at = self.most, 1
        while at < self.size:
            at *= 2
            if most[at] < need:
                at += 1
        found = at - self.size
        most[at] -= need
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each size, all between 1 and ``room``; ties go by position."""
    tree = Tournament(len(sizes), room)
    used: dict[int, int] = {}
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        where[i] = tree.first_fit(sizes[i])
        offset[i] = used.get(where[i], 0)
        used[where[i]] = offset[i] + sizes[i]
    return where, offset


def tokenized(docs: DataFrame, key: str, text: str, length: int, tokenizer: str | None) -> DataFrame:
    """doc_id, doc_tokens (with the end id) and crcs, the checksum of each piece."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        tok = _tokenizer(tokenizer)
        tokens, crcs = [], []
        for t in batch.column("text").to_pylist():
            ids = np.array([*tok.ids(decoded(t)), END], dtype="<u4")
            tokens.append(len(ids))
            crcs.append([zlib.crc32(ids[at : at + length].tobytes()) for at in range(0, len(ids), length)])
        return {"doc_id": batch.column("doc_id"), "doc_tokens": tokens, "crcs": crcs}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(keys_and_text(docs, key, text), work, f"doc_id {kind}, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, tokenizer: str | None = None, seed: int = 3) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece.  Null and empty texts have the end id only; a text of any length is
    tokenized whole and fills sequences of its own; bytes that are no UTF-8 count as replacement characters.  Of pieces
    of equal size, that of the smaller id is placed first.  Rows with the same id are documents of their own; a null id is
    kept; an empty table gives no rows; other columns are not read.  Groups hold about ``group`` documents whatever their
    ids, so that none grows with the table or with a repeated key.  Tokenized rows are written with their group before
    they are dealt, so a lost executor can't move a document to another group.
    """
    groups = max(1, -(-docs.count() // group))
    kind = docs.schema[key].dataType.simpleString()
    rows = written(tokenized(docs, key, text, length, tokenizer).withColumn("grp", F.floor(F.rand(seed) * groups).cast("long")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_tokens", "doc_id"], kind="stable").reset_index(drop=True)
        base = int(pdf["grp"].iloc[0]) << 32
        tokens = pdf["doc_tokens"].to_numpy()
        full, last = tokens // length, tokens % length
        n = full + (last > 0)
        rest = np.flatnonzero(last)
        where, at = first_fit_decreasing(last[rest].tolist(), length)
        row = np.repeat(np.arange(len(pdf)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(length, tokens[row] - nth * length)
        whole = size == length
        bins = max(where, default=-1) + 1
        seq, offset = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        seq[whole] = base + bins + np.arange(int(whole.sum()))
        seq[~whole] = base + np.array(where, dtype=np.int64)
        offset[~whole] = at
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[row], "start": nth * length, "length": size, "ids_crc32": np.concatenate(pdf["crcs"].to_list()).astype(np.int64),
            "doc_tokens": tokens[row], "sequence_id": seq, "offset": offset,
        })

    return rows.groupBy("grp").applyInPandas(one, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
