"""The pipeline's stages, each on the rows that its predecessor kept, against brute force."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from wardhall.llm import packing
from wardhall.llm.langid import fit_languages
from wardhall.llm.linededup import OP8_SQL

from .test_pairs import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.collect(), docs.columns)]
    for name, f in corpus_pipeline.STAGES:
        df = f(spark, docs, SF)
        rows = df.collect()
        out.append((name, rows, df.columns))
        if name != "packing":
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages_and_columns(stages):
    assert [s[0] for s in stages[1:]] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(s[2] == stages[0][2] for s in stages[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage(spark, stages):
    model = fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    want = {r.doc_id for r in stages[0][1] if r.text and any(map(str.isalpha, r.text)) and model.identified([r.text], 0.2)[0]}
    assert {r.doc_id for r in stages[1][1]} == want and len(want) >= 0.98 * len(stages[0][1])


def test_line_stage(stages):
    import hashlib

    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame([r.asDict() for r in stages[1][1]]))
    want = {r[0]: r[1] for r in c.sql(f"SELECT doc_id, kept_sha256 FROM ({OP8_SQL})").fetchall()}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in stages[2][1]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2][1])


def test_near_duplicate_stage(stages):
    groups = brute_components([(r.doc_id, r.text) for r in stages[2][1]], 5, 80)
    assert {r.doc_id for r in stages[3][1]} == {i for i, (_, c) in groups.items() if c == i}


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in stages[3][1]], items)
    assert {r.doc_id for r in stages[4][1]} == {i for i, h in hits.items() if not h[4]}
    assert any(h[4] for h in hits.values())


def test_packing_stage(stages):
    own = packing._tokenizer(None)
    by: dict = {}
    for r in stages[5][1]:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {r.doc_id for r in stages[4][1]}
    for d in stages[4][1]:
        ids = np.array([*own.ids(d.text), 0], dtype="<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    used = sum(r.length for r in stages[5][1])
    assert used >= 0.97 * packing.LENGTH * len({r.sequence_id for r in stages[5][1]})


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[5][1]))


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
