import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import shingles as J
from ledgerloom.llm import simhash as S

from ..conftest import DATA
from .conftest import prose


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(docs):
    """Smallest id of every document's group: similar by shingles, or fingerprints within two bits."""
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, plain_set(t), S.fingerprint(t)) for i, t in docs]
    for k, (i, a, f) in enumerate(known):
        for j, b, g in known[:k]:
            if a == b or (f ^ g).bit_count() <= 2 or (4 * len(a) <= 5 * len(b) and 4 * len(b) <= 5 * len(a) and similar(a, b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in docs}


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = {r["doc_id"] for r in P.near_duplicates(spark, docs, DATA).collect()}
    assert kept == {i for i, x in want.items() if i == x}
    two_bits = S.group(docs, similar=False).where(F.col("doc_id") == F.col("component_id")).count()
    assert len(kept) < two_bits


def _edited(words, rng, k):
    w = list(words)
    for p in rng.choice(len(w), k, replace=False):
        w[p] = f"edit{rng.integers(1 << 40)}"
    return " ".join(w)


def test_near_copies_and_a_common_passage(spark):
    rng = np.random.default_rng(3)
    base, passage = prose(1, 150).split(), prose(2, 40)
    docs = [_edited(base, rng, int(rng.integers(0, 7))) for _ in range(180)]  # similar to some, not to all
    docs += [prose(100 + i, 60) + " " + passage for i in range(60)] + [prose(3, 60)] * 9 + ["", None, " \n", "a b", "A  b", "a c"]
    docs = [(1000 - i, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_groups(docs)
    assert {r["doc_id"]: r["component_id"] for r in S.group(df).collect()} == want
    assert 70 < len(set(want.values())) < 250


def test_the_bound_itself(spark):
    w = prose(9, 49).split()  # 45 shingles; a changed last word leaves 44 of 46, five changed at the end 40 of 50
    docs = [(1, " ".join(w)), (2, " ".join(w[:-5] + list("abcde"))), (3, " ".join(w[:-6] + list("abcdef")))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: plain_set(t) for i, t in docs}
    assert similar(sets[1], sets[2]) and not similar(sets[1], sets[3])
    assert {r["doc_id"]: r["component_id"] for r in S.group(df).collect()} == plain_groups(docs)


def test_blocks_find_what_one_block_finds():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(60, 54, replace=False)) for _ in range(80)]
    n = np.array([len(s) for s in sets])
    i, j = J._forest(n, np.zeros(80, np.int64), sets)
    assert len(i) and all(9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (n[a] + n[b]) for a, b in zip(i, j))
    i, j = J._forest(n, np.arange(80) % 2, sets)
    assert len(i) and all(a % 2 != b % 2 for a, b in zip(i, j))
