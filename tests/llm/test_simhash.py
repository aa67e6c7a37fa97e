import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import simhash as S

from ..conftest import DATA


def plain_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in fps:
        for j, g in fps:
            if i < j and (f ^ g).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in fps}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB é\t\n", max_size=40))
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fp(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_linked_fingerprints_meet_at_a_home(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    both = np.array([x, y], np.uint64).view(np.int64)
    for third in (False, True):
        at, anchor = S.anchors(both, third=third)
        homes = S.home(both, third=third)
        for i in (0, 1):
            mine = set(anchor[at == i].tolist())
            assert set(homes.tolist()) <= mine and len(mine) == (at == i).sum()


def test_golay_is_perfect():
    code = S.Code(*S.GOLAY, 2)
    assert sorted(len(e) for e in code.errors[0]) == [1] * 2048
    assert sum(len(e) for k in range(3) for e in code.errors[k]) == 44552
    code = S.Code(*S.HAMMING, 2)
    assert [len(e) for e in code.errors[0]] == [1] * 16 and sum(len(e) for k in range(3) for e in code.errors[k]) == 1 + 15 + 105 + 455


def _nodes(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in fps], "fp long").repartition(5)


def test_chains_and_dense_groups(spark):
    rng = np.random.default_rng(5)
    fps = {}
    base = int(rng.integers(0, 1 << 62))
    for i in range(40):  # a chain: each two bits from the last
        fps[base := base ^ 3 << (i % 31) * 2] = 1
    centre = int(rng.integers(0, 1 << 62))
    for _ in range(700):  # a dense group, larger than a run
        fps[centre ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64))] = 1
    for _ in range(300):
        fps[int(rng.integers(0, 1 << 64, dtype=np.uint64))] = 1
    for f in list(fps)[-200:]:  # the highest bit, alone and with another
        fps[f ^ 1 << 63] = fps[f ^ 1 << 63 ^ 1 << int(rng.integers(63))] = 1
    fps = [(1000 - i, f) for i, f in enumerate(fps)]
    want, name = plain_components(fps), dict(fps)
    for third in (False, True):
        got = {r["id"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in S.components(S.links(_nodes(spark, fps), third=third)).collect()}
        assert {frozenset(f for g, f in ((got.get(f, f), f) for f in name.values()) if g == h) for h in {got.get(f, f) for f in name.values()}} == {frozenset(name[i] for i in want if want[i] == r) for r in set(want.values())}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    assert {r["root"] for r in S.components(edges).collect()} == {0}


def test_edges(spark, edge_docs, no_docs):
    rows = S.group(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[30]["fp"] == by[31]["fp"] == by[32]["fp"] == 0 and {by[i]["component_id"] for i in (30, 31, 32)} == {30}
    assert by[34]["component_id"] == 3 and sum(r["doc_id"] == 34 for r in rows) == 2
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["fp"] == 0] == [30]  # its text is null, like that of 30
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["fp"] != 0] == [None]
    assert S.group(no_docs).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r["doc_id"], plain_fp(r["text"])) for r in docs]
    want = plain_components(fps)
    got = S.op5_simhash(spark, DATA)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()} == {(i, f"{f:016x}", want[i]) for i, f in fps}
    assert got.where(F.col("component_id") != F.col("doc_id")).count() > 20
