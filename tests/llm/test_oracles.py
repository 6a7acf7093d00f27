"""Operators against the SQL of their whole contracts, on a small scale and on odd rows."""

import duckdb
import pytest

from wardhall.llm.decontaminate import decontaminate
from wardhall.llm.jaccard import op1_jaccard_join
from wardhall.llm.oracles import OP1_SQL, OP4_SQL, OP5_SQL
from wardhall.llm.queries import ORACLE_SQL, QUERIES
from wardhall.llm.suffixdedup import op5_suffix_dedup

TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "short"), (5, TEXT), (6, TEXT), (7, TEXT.upper() + " fourteen"), (8, "short"), (9, "ü" * 60), (10, "x" + "ü" * 60), (11, "- , ."), (12, "a" * 120), (13, "b" + "a" * 70 + "c" + "a" * 50)]
ITEMS = [(1, TEXT), (2, "short"), (3, None), (4, "- ."), (10, TEXT), (None, "short"), (None, "ü ü"), (12, "-")]


@pytest.fixture()
def odd(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def compare(spark, folder, df, sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark") if folder.startswith("/tmp") else ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    columns = sorted(df.columns)
    want = sorted(map(tuple, c.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
    assert sorted(map(tuple, df.select(*columns).collect())) == want
    return want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_scale(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, folder, QUERIES[name](spark, folder), ORACLE_SQL[name])


def test_odd_rows_joined(spark, odd):
    rows = compare(spark, odd, op1_jaccard_join(spark, odd), OP1_SQL)
    assert {(d, c) for c, d, _ in rows} >= {(1, 1), (3, 3), (6, 5), (7, 5), (8, 4)}


def test_odd_rows_decontaminated(spark, odd):
    docs, bench = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    compare(spark, odd, decontaminate(docs, bench), OP4_SQL)


VECTORS = [(0, [0.5] * 64, 1), (50, [0.25] * 64, 1), (7, [0.26] * 64, 1), (8, [0.2] * 64, 2), (9, [0.2] * 64, 2), (10, [0.11] * 64, 3), (11, None, 1), (12, [None] * 64, 1), (13, [float("nan")] * 64, 1), (14, [0.1] * 64, None), (100, [-0.5] * 64, 2), (150, [float("inf")] * 64, 2)]


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_hard_negatives", "op13_centroid_clustering"])
def test_odd_vectors(spark, tmp_path, name):
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = sorted(map(tuple, c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert want and sorted(map(tuple, df.select(*columns).collect())) == want


def test_odd_rows_cut(spark, odd):
    compare(spark, odd, op5_suffix_dedup(spark, odd), OP5_SQL)
