import random
import re

from ledgerloom.llm import decontam as D

from ..conftest import DATA
from .conftest import prose


def tok(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain(docs, items):
    """Every diagonal of every pair: the best segment with +1 and -4."""
    out = set()
    for d, text in docs:
        w = tok(text)
        for i, b in items:
            for start in range(-len(b) + 1, len(w)):
                s = n = 0
                for k in range(max(0, -start), min(len(b), len(w) - start)):
                    if s <= 0:
                        s = n = 0
                    if w[start + k] == b[k]:
                        s, n = s + 1, n + 1
                        if n >= D.MATCHED:
                            out.add((d, i))
                    else:
                        s -= D.SLIP
    return out


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], tok(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(b[k : k + 4]) for _, b in items for k in range(len(b) - 3)}
    near = [(r["doc_id"], r["text"]) for r in rows if any(tuple(w[k : k + 4]) in grams for w in [tok(r["text"])] for k in range(len(w) - 3))]
    want = plain([x for x in near if len(x[1]) < 4000], items)
    got = D.op4_decontam(spark, DATA).collect()
    short = {i for i, t in near if len(t) < 4000}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] in short} == want and len(want) > 10
    assert all(r["n_equal"] <= r["n_aligned"] and r["n_equal"] >= 0.8 * r["n_aligned"] for r in got)


def test_substitutions_and_positions(spark):
    item = prose(1, 40)
    w = item.split()
    docs = [
        (1, prose(50, 30) + ". " + item.upper() + "! " + prose(51, 30)),
        (2, prose(52, 9) + " " + " ".join("swapped" if k % 7 == 3 else x for k, x in enumerate(w)) + " " + prose(53, 9)),
        (3, prose(54, 200)),
        (4, " ".join(w[:7])),
        (5, " ".join(w[25:]) + " " + prose(55, 20)),
        (6, " ".join(reversed(w))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (None, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.overlaps(d, b).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1]["n_equal"], got[1]["doc_start"], got[1]["item_start"]) == (40, 30, 0)
    assert (got[2]["n_aligned"], got[2]["n_equal"], got[2]["item_start"]) == (34, 30, 4) and got[5]["item_start"] == 25 and got[5]["doc_start"] == 0


def test_shuffle_way_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark"))
    want = {tuple(r) for r in D.overlaps(docs, bench).collect()}
    monkeypatch.setattr(D, "SEEDS", 0)
    assert {tuple(r) for r in D.overlaps(docs, bench).collect()} == want


def test_the_shuffle_carries_no_tokens(spark, monkeypatch):
    monkeypatch.setattr(D, "SEEDS", 0)
    docs, bench = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.overlaps(docs, bench)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    at = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(seed" in x]
    assert len(at) >= 2
    for i in at:  # what is moved by hash: no array, no text
        moved = re.search(r"\[([^\]]*)\]", lines[i + 1])
        assert moved is None or not re.search(r"\b(a|b|text)#", moved[1]), lines[i + 1]


def test_rows_that_share_an_id_or_have_none_on_both_ways(spark, monkeypatch):
    item = prose(1, 40)
    docs = spark.createDataFrame([(1, prose(8, 50)), (1, prose(9, 5) + " " + item), (None, item), (None, "nothing"), (2, item), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    want = sorted(map(tuple, D.overlaps(docs, bench).collect()), key=str)
    assert {r[0] for r in want} == {None, 1, 2} and len(want) == 3
    monkeypatch.setattr(D, "SEEDS", 0)
    assert sorted(map(tuple, D.overlaps(docs, bench).collect()), key=str) == want


def test_recall_by_rate_of_substitution(spark):
    """Of overlaps of 10 to 40 tokens, those that the verification accepts are all found, at each rate."""
    rng = random.Random(11)
    item = [f"w{k}" for k in range(60)]
    docs, want, made = [], {}, {}
    for r, rate in enumerate((0.0, 0.05, 0.1, 0.15, 0.2)):
        for i in range(300):
            n, at = rng.randrange(10, 41), rng.randrange(0, 20)
            text = ["x"] * 3 + [x if rng.random() >= rate else f"s{k}" for k, x in enumerate(item[at : at + n])] + ["y"] * 3
            docs.append((r * 1000 + i, " ".join(text)))
            made[rate] = made.get(rate, 0) + 1
            if whole(text, item):
                want.setdefault(rate, set()).add(r * 1000 + i)
    got = {x["doc_id"] for x in D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == set().union(*want.values())
    assert len(want[0.0]) == made[0.0] and len(want[0.1]) > 0.95 * made[0.1] and len(want[0.2]) > 0.7 * made[0.2]


def test_no_python_in_the_plan(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "benchmark"))
    plan = D.overlaps(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, prose(3, 60)), (2, prose(5, 30))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(edge_docs, bench).collect()}
    assert {(3, 1), (34, 1), (5, 2), (33, 2)} <= got
    assert D.overlaps(no_docs, bench).count() == 0
    assert D.overlaps(edge_docs, bench.where("item_id < 0")).count() == 0


def whole(w, b):
    """Any segment of any diagonal with 8 equal tokens or more at a share of 0.8 or more."""
    for start in range(-len(b) + 1, len(w)):
        eq = [w[start + k] == b[k] for k in range(max(0, -start), min(len(b), len(w) - start))]
        if any(n >= 8 and 5 * n >= 4 * (j - i) for i in range(len(eq)) for j in range(i + 8, len(eq) + 1) for n in [sum(eq[i:j])]):
            return True
    return False


def test_segments_below_the_best_score_and_every_place_of_a_substitution(spark):
    w = prose(1, 40).split()
    item = [f"{x}{k}" for k, x in enumerate(w)]  # no token twice
    runs = {1: (7, 4), 2: (4, 5), 3: (4, 4, 4, 4, 4), 4: (3, 2, 3), 5: (2, 3, 3), 6: (3, 3, 2), 7: (3, 3, 3, 3), 8: (1, 7), 9: (3, 2, 2), 10: (2, 3, 2), 11: (7, 2), 12: (3, 1, 3, 3), 13: (6, 0, 2)}
    docs = []
    for i, lens in runs.items():
        at, out = 3, ["before"] * 5
        for k, n in enumerate(lens):
            out += ([f"swap{k}"] if k else []) + item[at + bool(k) : at + bool(k) + n]
            at += n + bool(k)
        docs.append((i, " ".join(out + ["after"] * 5)))
    rng = random.Random(7)
    for i in range(100, 400):
        n = rng.randrange(9, 24)
        docs.append((i, " ".join(["before", *(x if rng.random() < 0.8 else "other" for x in item[5 : 5 + n]), "after"])))
    want = {i for i, t in docs if whole(t.split(), item)}
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {1, 2, 3, 4, 5, 6, 7, 8, 11} <= want and not want & {9, 10} and len(want) > 100
    assert {r["doc_id"] for r in got} == want
    assert all(r["n_equal"] >= 8 and 5 * r["n_equal"] >= 4 * r["n_aligned"] for r in got)
    one = {r["doc_id"]: (r["n_equal"], r["n_aligned"], r["doc_start"], r["item_start"]) for r in got}
    assert one[1] == (11, 12, 5, 3) and one[2] == (9, 10, 5, 3) and one[3] == (8, 9, 5, 3)
