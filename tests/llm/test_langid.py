import zlib
from collections import Counter

from ledgerloom.llm import langid as L

from ..conftest import DATA


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    out = Counter()
    for w in filter(None, words):
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def code(g):
    return sum(ord(c) << 21 * i for i, c in enumerate(g))


def test_grams():
    for t in ("Ab, b!", "é 1 é", "", None, "日本 語", "a" * 1000, "İstanbul"):
        codes, counts = L.grams(t)
        assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in plain_grams(t).items()}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    total = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None:
            total.setdefault(r["lang"], Counter()).update({code(g): n for g, n in plain_grams(r["text"]).items()})
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: L.TOP]]
    ranks = {k: {g: i for i, g in enumerate(top(c))} for k, c in total.items()}
    got = {r["doc_id"]: r for r in L.op6_langid(spark, DATA).collect()}
    assert len(got) == len(docs)
    right = held = 0
    for r in docs:
        mine = top({code(g): n for g, n in plain_grams(r["text"]).items()})
        far = {k: sum(abs(i - v[g]) if g in v else L.TOP for i, g in enumerate(mine)) for k, v in ranks.items()}
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if mine:
            best = min(sorted(far), key=lambda k: far[k])
            assert g["lang_pred"] == best and abs(g["score"] - (1 - far[best] / (L.TOP * len(mine)))) < 1e-12
        else:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
        if g["held_out"] and mine:
            held, right = held + 1, right + (g["lang_pred"] == r["lang"])
    assert right / held > 0.97


def test_edges(spark, edge_docs, no_docs):
    p = L.learn(edge_docs)
    out = {r["doc_id"]: r for r in L.identify(edge_docs, p).collect()}
    assert [out[i]["lang_pred"] for i in (30, 31, 32)] == ["und"] * 3 and out[36]["lang_pred"] == "ja"
    assert L.identify(edge_docs, p).count() == edge_docs.count()
    nothing = L.learn(no_docs)
    assert {r["lang_pred"] for r in L.identify(edge_docs, nothing).collect()} == {"und"}
    assert L.identify(no_docs, p).count() == 0
