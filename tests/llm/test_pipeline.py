from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import decontam, pii, quality, simhash
from ledgerloom.llm.common import read

from ..conftest import DATA
from .conftest import prose


def test_stages_against_their_operators(spark):
    docs = read(spark, DATA, "documents").cache()
    labels = {r["doc_id"]: r["quality"] for r in read(spark, DATA, "labels").collect()}
    one = P.good_quality(spark, docs, DATA)
    kept = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and sum(i in kept for i, y in labels.items() if y == 1) > 0.99 * sum(labels.values())
    assert sum(i in kept for i, y in labels.items() if y == 0) < 0.1 * sum(y == 0 for y in labels.values())
    two = P.near_duplicates(spark, docs, DATA)
    groups = simhash.group(docs).collect()
    assert {r["doc_id"] for r in two.collect()} == {r["component_id"] for r in groups}
    three = P.decontaminated(spark, docs, DATA)
    bad = {r["doc_id"] for r in decontam.overlaps(docs, read(spark, DATA, "benchmark")).collect()}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
    four = {r["doc_id"]: r for r in P.without_pii(spark, docs, DATA).collect()}
    assert all(not [s for s in pii.spans(r["text"]) if s[2] in pii.BASE] and r["n_chars"] == len(r["text"]) for r in four.values())
    assert len(four) == docs.count()


def test_run(spark):
    out = P.run(spark, DATA)
    rows = out.collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]


def test_run_leaves_no_stage_behind(spark):
    import os

    from ledgerloom.llm.common import shared_dir

    where = shared_dir(spark).removeprefix("file://")
    before = {x for x in os.listdir(where) if x.startswith("stage-")}
    assert P.run(spark, DATA).count() > 0
    assert len({x for x in os.listdir(where) if x.startswith("stage-")} - before) == 1  # the one that the result is read from


def test_rows_without_id_or_with_repeated_ids(spark, tmp_path):
    item = read(spark, DATA, "benchmark").where("text is not null").first()["text"]
    one, two = prose(1, 80), prose(2, 80)
    rows = [(1, one), (1, two), (None, one), (None, prose(3, 80)), (2, two), (2, two), (None, prose(4, 30) + " " + item), (7, prose(5, 80)), (7, prose(6, 40) + " " + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):
        got = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, DATA).collect()), key=str)
        assert got == sorted([(1, one), (1, two), (None, prose(3, 80)), rows[6], rows[7], rows[8]], key=str)
        got = sorted(((r["doc_id"], r["text"]) for r in P.decontaminated(spark, docs, DATA).collect()), key=str)
        assert got == sorted([r for i, r in enumerate(rows) if i not in (6, 8)], key=str)


def test_the_shuffle_way_gives_the_same(spark, monkeypatch):
    docs = read(spark, DATA, "documents")
    want = {r["doc_id"] for r in P.near_duplicates(spark, docs, DATA).collect()}
    monkeypatch.setattr(P, "GONE", 0)
    monkeypatch.setattr(simhash, "CLASSED", 0)
    monkeypatch.setattr(P.simhash.shingles, "KNOWN", 0)
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, DATA).collect()} == want


def test_edges(spark, edge_docs, no_docs):
    for _, stage in P.STAGES[1:4]:
        out = stage(spark, edge_docs, DATA)
        assert out.columns == edge_docs.columns
        assert stage(spark, no_docs, DATA).count() == 0
    kept = P.near_duplicates(spark, edge_docs, DATA).collect()
    assert sorted(str(r["doc_id"]) for r in kept if r["doc_id"] is None or r["doc_id"] >= 30) == ["30", "33", "35", "36", "None"]  # the second row without id is empty, like 30
    assert P.good_quality(spark, edge_docs, DATA).columns == edge_docs.columns
    assert P.mixed(spark, edge_docs, DATA).count() == edge_docs.count() and P.mixed(spark, no_docs, DATA).count() == 0
    assert quality.CUT == 0.7
