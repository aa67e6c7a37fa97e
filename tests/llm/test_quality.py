import zlib

import numpy as np

from ledgerloom.llm import quality
from ledgerloom.llm.common import read

from ..conftest import DATA


def test_held_out_accuracy_and_folds(spark):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, DATA, "labels").collect()}
    rows = quality.op3_quality(spark, DATA).collect()
    assert len(rows) == read(spark, DATA, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.97  # clean documents stay


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    t = quality.train(x, y, trees=8, depth=3)
    for row, got in zip(x[:40], t.score(x[:40])):
        total = t.start
        for f, c, leaf in zip(t.feature, t.cut, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            total += leaf[at - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12
    assert ((t.score(x) > 0.5) == y).mean() > 0.9


def test_edges(spark, edge_docs, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["_score"] for r in quality.score(edge_docs, quality.fit(edge_docs, empty), ["doc_id"]).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(1, None, 1), (None, 1, 1), (3, 0, 0), (35, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(edge_docs, quality.fit(edge_docs, labels), ["doc_id", "score"])
    assert out.count() == edge_docs.count() and out.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert quality.score(no_docs, quality.fit(no_docs, labels)).count() == 0
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score(edge_docs, quality.fit(edge_docs, ones), ["doc_id"]).where("_score < 0.99").count() == 0


def test_sample_is_bounded(spark, edge_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert len(quality.fit(edge_docs, labels, sample=10, held_out=None).leaf) > 0
