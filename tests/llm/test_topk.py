import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import topk

from ..conftest import DATA


def brute(rows, step, k):
    """rows: (id, whole components). Each row whose id step divides asks; all other rows answer."""
    out = []
    for a, (qid, q) in enumerate(rows):
        if qid is not None and qid % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i is None, i or 0) for b, (i, v) in enumerate(rows) if a != b)
            out += [(qid, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def whole(rows):
    return [(i, [math.floor(1024 * x) for x in e]) for i, e, *_ in rows]


def test_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(1).tolist()) for i in range(300)] + [(i, [0.5] * 12) for i in range(300, 420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in topk.search(topk.prepare(df), 7).collect()), key=str)
    assert got == brute(whole(rows), 7, 10)


def test_many_shards_and_a_sample(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "SAMPLE", 256)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in topk.search(topk.prepare(df), 200).collect()), key=str) == brute(whole(rows), 200, 10)


@pytest.mark.parametrize("dims,spread", [(16, 300), (64, 120), (3, 5)])
def test_stops_only_on_proof(dims, spread):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(4000, dims)) * spread).astype(np.int64)
    index = topk.Index(v)
    for i in range(20):
        rows, scores = index.search(v[i], 10)
        want = set(np.argsort(-(v @ v[i]), kind="stable")[:10].tolist())
        assert want <= set(rows.tolist())
        assert (scores == v[rows] @ v[i]).all()


def test_searches_skip_postings_and_score_few():
    """On the table of the query: over a quarter of the postings never processed, under a tenth of the vectors scored."""
    con = duckdb.connect()
    path = f"{DATA.replace('sf0.01', 'sf0.1')}/embeddings.parquet"
    v = np.floor(1024 * np.array(con.sql(f"SELECT embedding FROM '{path}' ORDER BY vec_id").fetchnumpy()["embedding"].tolist(), float)).astype(np.int64)
    index = topk.Index(v)
    for i in range(0, len(v), 100):
        index.search(v[i], 10, None, i)
    seen = index.seen
    assert seen["processed"] < 0.75 * seen["postings"] and seen["scored"] < 0.12 * seen["vectors"]


def test_edges(spark):
    rows = [(0, [1.0, 2.0], "z"), (100, [1.0], "z"), (1, None, "z"), (2, [], "z"), (3, [float("nan"), 1.0], "z"), (4, [None, 1.0], "z"), (5, [float("inf"), 1.0], "z"), (None, [1.0, 1.0], "z"), (6, [1e12, 0.0], "z"), (7, [1.0, 1.0], "z"), (7, [1.0, 1.0], "z"), (100, [0.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumns({c: F.lit("clash") for c in ("id", "v", "row", "shard", "query", "floor", "low")})
    got = sorted((tuple(r) for r in topk.search(topk.prepare(df)).collect()), key=str)
    part = [r for r in rows if r[0] not in (1, 3, 4, 5)]
    assert got == brute(whole(part), 100, 10)
    assert [x[2] for x in got if x[0] == 0] == [6, 7, 7, None, 100, 2, 100]  # an empty vector scores 0, as the zero one; no id comes last of its score
    none = topk.prepare(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert topk.search(none).count() == 0


def test_large_components_are_exact_or_an_error(spark):
    big = spark.createDataFrame([(0, [3e6, 1e12]), (100, [1.0, 0.0]), (1, [1e5, -2e12])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.search(topk.prepare(big.where("vec_id <> 1"))).collect()}
    assert got == {(0, 1, 100, 3_000_000 * 1024 * 1024), (100, 1, 0, 3_000_000 * 1024 * 1024)}
    with pytest.raises(Exception, match="larger than a long"):
        topk.search(topk.prepare(big)).collect()
    with pytest.raises(Exception, match="larger than a long"):
        topk.search(topk.prepare(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"))).collect()


def test_query_equals_sql(spark):
    from ledgerloom.llm.catalog import SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = set(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({SQL['op1_topk']})").fetchall())
    assert {tuple(r) for r in topk.op1_topk(spark, DATA).collect()} == want
