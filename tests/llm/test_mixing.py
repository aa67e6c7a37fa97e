import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import mixing as M

from ..conftest import DATA


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_less_than_a_block_from_the_share(ws):
    weights = {f"s{i:02}": w for i, w in enumerate(ws)}
    q, had = sum(ws), dict.fromkeys(weights, 0)
    slots = M.schedule(weights)
    assert [x["slot"] for x in slots] == list(range(q))
    for t, x in enumerate(slots, 1):
        had[x["source"]] += 1
        assert all(abs(had[s] - w * t / q) < 1 for s, w in weights.items())
    assert had == weights


def test_bad_weights():
    for w in ({}, {"a": 0}, {"a": M.PERIOD + 1}):
        with pytest.raises(ValueError):
            M.schedule(w)


def test_whole_and_in_proportion(spark):
    out = M.op9_mixing(spark, DATA)
    rows = out.orderBy("position").collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert [r["position"] for r in rows] == list(range(docs)) and len({r["doc_id"] for r in rows}) == docs
    slots = [(r["slot"], r["mix_class"], r["block"]) for r in rows]
    assert [s for s, *_ in slots] == sorted(s for s, *_ in slots) and len(set(slots)) == len({(c, b) for _, c, b in slots})
    present = {c for _, c, _ in slots}
    q = sum(M.WEIGHTS[c] for c in present)
    for t in sorted({r["slot"] + 1 for r in rows if r["in_target"]}):
        for c in present:
            assert abs(len({b for s, k, b in slots if k == c and s < t}) - t * M.WEIGHTS[c] / q) < 1


def test_no_python_in_the_plan(spark):
    plan = M.op9_mixing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark, edge_docs, no_docs):
    out = M.mix(edge_docs, {"src0": 2, "src1": 1, M.OTHER: 1}, block=3)
    rows = out.collect()  # the table's own columns block and position stay as they are
    assert out.columns == [*edge_docs.columns, "mix_class", "block_", "slot", "in_target", "position_"] and {r["block"] for r in rows} == {"clash"}
    assert sorted(r["position_"] for r in rows) == list(range(edge_docs.count()))
    assert {r["mix_class"] for r in rows if r["source"] is None or r["source"] in ("src2", "src9")} == {M.OTHER}
    assert M.mix(no_docs).count() == 0
    assert sorted(r["position_"] for r in M.mix(edge_docs, {"gone": 5}).collect()) == list(range(edge_docs.count()))


def test_clashing_names_of_helpers(spark):
    df = spark.createDataFrame([(i, f"t{i}", "src0", "kept", "kept") for i in range(20)], "doc_id long, text string, source string, _mix_key string, slot string")
    rows = M.mix(df).collect()
    assert {(r["_mix_key"], r["slot"]) for r in rows} == {("kept", "kept")} and sorted(r["position"] for r in rows) == list(range(20)) and all(isinstance(r["slot_"], int) for r in rows)
