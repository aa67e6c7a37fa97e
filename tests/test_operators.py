"""Properties of merge, history, overlay, matching, queue and replay on made-up rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import diff, documents, match, merge, overlay, queue, rank, replay
from ledgerloom.sources.tables import load, page, scan

from .conftest import SMALL

RANKS = {"scheduled": 0, "live": 1, "postponed": 1, "final": 2}
statuses = st.one_of(st.none(), st.sampled_from(sorted(RANKS)))
few = settings(max_examples=12, deadline=None)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@few
@given(b=st.dictionaries(st.integers(0, 8), st.tuples(statuses, st.one_of(st.none(), st.integers(0, 9))), max_size=8), d=st.dictionaries(st.integers(0, 8), st.tuples(statuses, st.one_of(st.none(), st.integers(0, 9)), st.booleans()), max_size=8))
def test_merge_against_dictionaries(spark, b, d):
    base = frame(spark, [(k, *v) for k, v in b.items()], "k int, status string, home int")
    delta = frame(spark, [(k, *v) for k, v in d.items()], "k int, status string, home int, explicit boolean")
    out = merge.merge(base, delta, ["k"], {"status": merge.forward_only(RANKS, F.col("d.explicit")), "home": merge.never_null})
    got = {r["k"]: (r["status"], r["home"]) for r in out.collect()}
    want = dict(b)
    for k, (s, h, explicit) in d.items():
        s0, h0 = b.get(k, (None, None))
        back = s is not None and s0 is not None and RANKS[s0] > RANKS[s] and not explicit
        want[k] = (s0 if s is None or back else s, h0 if h is None else h)
    assert got == want


def test_merge_cases(spark):
    base = frame(spark, [(1, "final"), (2, "final")], "k int, status string")
    delta = frame(spark, [(1, "live", False), (2, "scheduled", True)], "k int, status string, explicit boolean")
    out = merge.merge(base, delta, ["k"], {"status": merge.forward_only(RANKS, F.col("d.explicit"))})
    assert {r["k"]: r["status"] for r in out.collect()} == {1: "final", 2: "scheduled"}


def test_reconcile_with_nothing_seen_changes_nothing(spark):
    base = frame(spark, [("a", 1, True), ("a", 2, False), ("b", 1, True)], "team string, id int, active boolean")
    none = frame(spark, [], "team string, id int")
    out = merge.reconcile(base, none, ["team"], ["id"])
    assert {tuple(r)[:3] for r in out.select("team", "id", "active").collect()} == {tuple(r) for r in base.collect()} and out.where("left_now").count() == 0
    seen = frame(spark, [("a", 7)], "team string, id int")
    assert {(r["team"], r["id"]): (r["active"], r["left_now"]) for r in merge.reconcile(base, seen, ["team"], ["id"]).collect()} == {("a", 1): (False, True), ("a", 2): (False, False), ("b", 1): (True, False)}


def test_history_is_empty_for_equal_snapshots(spark):
    x = frame(spark, [(1, 2, None), (2, 0, 5)], "k int, g int, e int")
    assert diff.changes(x, x, ["k"], ["g", "e"]).count() == 0
    y = frame(spark, [(1, 2, 7), (3, 0, None)], "k int, g int, e int")
    loud = {tuple(r) for r in diff.changes(x, y, ["k"], ["g", "e"], absent={"g": 0}).collect()}
    assert loud == {(1, "e", None, 7), (2, "e", 5, None)}
    quiet = {tuple(r) for r in diff.changes(x, y, ["k"], ["g", "e"], quiet=True).collect()}
    assert quiet == loud


def test_replace_and_prune(spark):
    base = frame(spark, [(1, "a"), (1, "b"), (2, "c")], "p int, c string")
    assert {tuple(r) for r in merge.replace_children(base, frame(spark, [(1, "z")], "p int, c string"), ["p"]).collect()} == {(1, "z"), (2, "c")}
    fresh = frame(spark, [(1, "a"), (1, "x")], "p int, c string")
    assert {tuple(r) for r in merge.prune(base, fresh, ["p"], "c", 2, F.lit(True)).collect()} == {(1, "a"), (2, "c")}
    assert merge.prune(base, fresh, ["p"], "c", 3, F.lit(True)).count() == 3


def test_overlay_falls_back(spark):
    m = "map<string,int>"
    rows = [(1, {"goals": 2, "penalties": 1, "yellows": 1, "entered": 60, "short": 1}, {}, {}), (2, {"goals": 2, "penalties": 1, "yellows": 1}, {"goals": 3, "yellows": 0, "entered": 75}, {"goals": 9, "yellows": 5}), (3, {"penalties": 1}, {"goals": 0}, {})]
    got = {r["k"]: r for r in overlay.effective(frame(spark, rows, f"k int, c {m}, o {m}, m {m}"), "c", "o", "m").collect()}
    assert (got[1]["goals"], got[1]["penalties"], got[1]["yellows"], got[1]["short"]) == (2, 1, 1, True)
    assert (got[2]["goals"], got[2]["penalties"], got[2]["yellows"], got[2]["short"]) == (9, 1, 5, True)
    assert (got[3]["goals"], got[3]["penalties"]) == (0, 0)


def test_official_layer_with_a_duplicate_mapping(spark):
    rows = frame(spark, [(1, "p", "t"), (1, "q", "t"), (1, "r", "u"), (2, "p", None)], "m int, p string, team string")
    official = frame(spark, [(1, "p", "t", 1), (1, "p", "t", 2), (1, None, "t", 5), (2, None, None, 4)], "m int, p string, team string, g int")
    got = {(r["m"], r["p"]): r["layer"] for r in overlay.build_official(rows, official, ["m", "p"], "team", F.lit(True), ["g"]).collect()}
    assert got == {(1, "p"): {}, (1, "q"): {}, (1, "r"): {"g": 0}, (2, "p"): {}}


@few
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 5), st.integers(0, 3)), max_size=25, unique_by=lambda r: r[:3]))
def test_greedy_is_one_to_one_and_leaves_no_free_pair(spark, rows):
    got = [tuple(r) for r in match.greedy_pairs(frame(spark, [(b, x, y, float(s)) for b, x, y, s in rows], "b int, x int, y int, s double"), "b", "x", "y", "s").collect()]
    ls, rs = {(b, x) for b, x, *_ in got}, {(b, y) for b, _, y, _ in got}
    assert len(ls) == len(rs) == len(got)
    assert all((b, x) in ls or (b, y) in rs for b, x, y, _ in rows)


def test_linking_tiers(spark):
    roster = [("m", 1, "joaosilva", "joao silva", 11), ("m", 2, "ruisilva", "rui silva", 12), ("m", 3, "anareis", "ana reis", 13), ("m", 4, "twin", "twin", None), ("m", 5, "twin", "twin", None), ("m", 6, "pedro", "pedro", 16)]
    ratings = [("m", 1, "x", "x", 11, None), ("m", 2, "silva", "silva", None, None), ("m", 3, "anareis", "ana reis", None, None), ("m", 4, "twin", "twin", None, None), ("m", 5, "who", "who", None, 6), ("m", 6, "reis", "reis", None, None), ("n", 1, "x", "x", None, None)]
    out = match.link_in_order(frame(spark, ratings, "b string, pos int, name string, words string, ext_id long, alias_id long"), frame(spark, roster, "b string, id long, name string, words string, ext_id long"), "b")
    got = {(r["b"], r["pos"]): (r["id"], r["tier"], r["n_candidates"]) for r in out.collect()}
    assert got == {("m", 1): (1, 1, 1), ("m", 2): (2, 4, 1), ("m", 3): (3, 3, 1), ("m", 4): (None, None, 0), ("m", 5): (6, 2, 1), ("m", 6): (None, None, 0), ("n", 1): (None, None, 0)}


def test_ambiguity_leaves_a_gap(spark):
    left = frame(spark, [(1, "t", 5), (2, "t", 9), (3, "u", 5)], "l int, t string, a int")
    right = frame(spark, [(10, "t", 5), (11, "t", 5), (12, "t", 9)], "r int, t string, b int")
    got = {tuple(r) for r in match.tiered(left, right, ["t"], [F.col("a") == F.col("b")], "l", "r").collect()}
    assert got == {(1, None, 1, 2), (2, 12, 1, 1), (3, None, None, 0)}


def test_coalescing_leaves_one_pending_row_for_each_key(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(6), rng.random() < 0.2, rng.choice([None, 1.0, 2.0])) for i in range(200)]
    e = frame(spark, rows, "i int, k int, d boolean, r double")
    got = {r["k"]: r for r in queue.coalesce_events(e, "k", ["i"], F.col("d"), "r").collect()}
    for k in range(6):
        mine = [x for x in rows if x[1] == k]
        last = max((x[0] for x in mine if x[2]), default=-1)
        open_ = [x for x in mine if not x[2] and x[0] > last]
        assert (k in got) == bool(open_)
        if open_:
            assert (got[k]["n"], got[k]["first_i"], got[k]["last_i"], got[k]["r"]) == (len(open_), open_[0][0], open_[-1][0], next((x[3] for x in reversed(open_) if x[3] is not None), None))


def test_reclaim_and_wake(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    jobs = frame(spark, [(1, "running", "round", 1, 3, "2024-01-01 00:00:00"), (2, "running", "round", 3, 3, "2024-01-01 00:00:00"), (3, "running", "watch", 1, 3, "2024-01-03 00:00:00"), (4, "pending", "round", 0, 3, None)], "id int, status string, kind string, attempts int, max_attempts int, l string").withColumn("lease_expires_at", F.col("l").cast("timestamp"))
    got = {r["id"]: (r["status"], r["lease_expires_at"] is not None) for r in queue.reclaim(jobs, at("2024-01-02")).collect()}
    assert got == {1: ("pending", False), 2: ("error", False), 3: ("running", True), 4: ("pending", False)}
    assert queue.wake(jobs, at("2024-01-01 23:59:00"), at("2024-01-02")).first()["wake"] is True
    assert queue.wake(jobs, at("2024-01-01 23:59:30"), at("2024-01-02")).first()["wake"] is False


def test_replay_ends_at_the_targets(spark):
    t = frame(spark, [(i, i % 3, i % 5) for i in range(30)], "k int, day int, target int")
    out = replay.replay(t, F.col("day"), F.col("target"), [0, 100, 204, 201, 300, 900], 300)
    assert out.where("elapsed = 900 AND (shown <> target OR state <> 'final')").count() == 0
    two = {r["elapsed"]: r["shown"] for r in out.where("k = 12").collect()}  # target 2 on the first day
    assert (two[0], two[100], two[204]) == (0, 1, 2)
    assert replay.transitions(out, ["k"], ["state", "shown"]).groupBy("k", "elapsed").count().where("count > 1").count() == 0


def test_scans_and_snapshots(spark, tmp_path):
    orders = load(spark, SMALL, "orders")
    assert dict(orders.dtypes)["o_orderdate"] == "timestamp"
    assert scan(orders, {"o_orderstatus": ("neq", "F"), "o_custkey": ("wild", 3)}).where("o_custkey <> 3 AND o_custkey IS NOT NULL").count() == 0
    assert page(orders, ["o_orderkey"], 10, 3).first()["o_orderkey"] == 30
    documents.write_snapshot(orders.limit(3).select("o_orderkey"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("schema_version = 2").count() == 3


def test_pushdown(spark):
    plan = scan(load(spark, SMALL, "orders"), {"o_orderstatus": "F"}, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_comment" not in plan and "o_totalprice" not in plan


def test_bad_registration():
    import ledgerloom.plans.catalog  # noqa: F401  the names are taken once it is loaded
    from ledgerloom.plans.registry import query

    with pytest.raises(ValueError):
        query("SELECT 1", "source_diff")(lambda t: None)


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6), st.integers(0, 6), st.integers(0, 4)), max_size=40))
@settings(max_examples=5, deadline=None)
def test_rounds_give_the_pairs_of_the_plain_loop(spark, rows):
    df = frame(spark, [(b, x, y, float(s)) for b, x, y, s in rows], "b int, x int, y int, s double")
    plain = match.greedy_pairs(df, "b", "x", "y", "s")
    assert sorted(map(tuple, match.greedy_pairs(df, "b", "x", "y", "s", small=0).collect())) == sorted(map(tuple, plain.collect()))


def test_greedy_leaves_out_pairs_without_a_score(spark):
    df = frame(spark, [(1, 1, 1, None), (1, 1, 2, 0.5), (None, 3, 3, 1.0)], "b int, x int, y int, s double")
    for small in (0, 9):
        assert [tuple(r) for r in match.greedy_pairs(df, "b", "x", "y", "s", small=small).collect()] == [(1, 1, 2, 0.5)]


@given(st.lists(st.sets(st.sampled_from("abcde"), max_size=4), max_size=8), st.lists(st.sets(st.sampled_from("abcde"), max_size=4), max_size=8))
@settings(max_examples=5, deadline=None)
def test_containing_is_every_pair_of_nested_sets(spark, ls, rs):
    l, r = (frame(spark, [(i, sorted(w)) for i, w in enumerate(x)], f"{n} int, w array<string>") for x, n in ((ls, "i"), (rs, "j")))
    want = {(i, j) for i, a in enumerate(ls) for j, b in enumerate(rs) if a and b and (a <= b or b <= a)}
    got = [tuple(x) for x in match.containing(l, r, "i", "j", "w").collect()]
    assert sorted(got) == sorted(want)


def test_squad_ties_and_shirts(spark):
    kind = "t int, {} int, words array<string>, age int, shirt int"
    right = frame(spark, [(1, 10, ["rui", "silva"], 20, 7), (1, 11, ["rui", "costa"], 25, 9), (1, 12, ["joao"], None, 4), (1, 13, ["ze"], 40, 4)], kind.format("b"))
    left = frame(spark, [(1, 1, ["rui"], 25, 1), (1, 2, ["rui"], None, 9), (1, 3, ["rui"], 0, 4), (1, 4, ["silva"], 99, 1), (1, 5, [], 30, 4), (2, 6, ["rui", "silva"], 20, 7)], kind.format("a"))
    got = {r.a: (r.b, r.how) for r in match.squad_link(left, right, "t", "a", "b").collect()}
    # A tie that age leaves open goes on to the shirt; of two rows with one shirt the last counts, refused by age.
    assert got == {1: (11, "age"), 2: (11, "shirt"), 3: (None, None), 4: (10, "name"), 5: (None, None), 6: (None, None)}


@given(st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.sampled_from([None, -3.0, -0.0, 0.0, 0.25, 7.0, 1e6, float("inf"), float("nan")])), max_size=25))
@settings(max_examples=5, deadline=None)
def test_cume_dist_as_the_window(spark, rows):
    from pyspark.sql import Window

    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, k string, v double")
    want = {r.i: r.s for r in df.withColumn("s", F.cume_dist().over(Window.partitionBy("k").orderBy("v"))).collect()}
    assert {r.i: r.s for r in rank.cume_dist(df, "k", "v", 0.5, "s").collect()} == want


@pytest.mark.parametrize("name, rows", [("squad_link", 200), ("squad_enrichment", 10)])
def test_linking_of_squads_broadcasts_nothing(spark, name, rows):
    """The planner takes the size of compressed files for that of the rows: their broadcasts filled the driver."""
    from ledgerloom.plans.catalog import QUERIES

    df = QUERIES[name](spark, SMALL)
    assert len(df.collect()) == rows
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_routing_is_dealt_over_a_grid(spark, monkeypatch):
    """Many cells give the pairs of one, and no side is broadcast."""
    monkeypatch.setattr(queue, "CELL", 8, raising=False)
    rows = frame(spark, [(i, None if i == 5 else i % 3) for i in range(20)], "a int, k int")
    subs = frame(spark, [(i, None if i % 4 == 0 else i % 3, i != 7) for i in range(12)], "b int, w int, active boolean")
    df = queue.route(rows, subs, "k", "w")
    want = sorted((a, b) for a in range(20) for b in range(12) if b != 7 and (b % 4 == 0 or (a != 5 and a % 3 == b % 3)))
    assert sorted((r.a, r.b) for r in df.collect()) == want
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
