"""Queries: source diff, history, merge, overlay, soft delete (families D, E, F, H, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.layers import overlaid, put, without
from ..operators import diff, merge, overlay
from ..sources.tables import Tables, source_a, source_b
from .registry import query

KEY = ["l_orderkey", "l_suppkey"]
A_SQL = """a AS (SELECT l_orderkey, l_suppkey, count(*)::INT AS g, sum((l_returnflag = 'R')::INT)::INT AS y, min(l_linenumber) FILTER (l_tax >= 0.04) AS e
  FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2)"""
B_SQL = A_SQL.replace("a AS", "b AS", 1).replace("<> 7", "<> 1").replace("0.04", "0.05")
SNAP_SQL = "s AS (SELECT l_orderkey, l_suppkey, g, CASE WHEN l_orderkey % 7 = 0 THEN y + 1 ELSE y END AS y, e FROM a)"
DIFF_SQL = f"""WITH {A_SQL}, {B_SQL}, {SNAP_SQL},
d AS (SELECT coalesce(s.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(s.l_suppkey, b.l_suppkey) AS l_suppkey,
  coalesce(s.g, 0) AS a_g, coalesce(b.g, 0) AS b_g, coalesce(s.y, 0) AS a_y, coalesce(b.y, 0) AS b_y, s.e AS a_e, b.e AS b_e,
  s.l_orderkey IS NULL AS a_missing, s.e IS DISTINCT FROM b.e AS minutes_differ
  FROM s FULL JOIN b ON s.l_orderkey = b.l_orderkey AND s.l_suppkey = b.l_suppkey),
f AS (SELECT *, (a_g <> b_g OR a_y <> b_y OR minutes_differ) AS differs FROM d)"""


def _snapshot(t: Tables):
    """Source a, overlaid by what its crawl snapshot holds."""
    a = source_a(t)
    snap = F.when(F.col("l_orderkey") % 7 == 0, F.create_map(F.lit("y"), F.col("y") + 1)).otherwise(F.create_map().cast("map<string,int>"))
    return a.withColumn("y", overlaid(snap, "y", F.col("y")))


def _diff(t: Tables):
    return diff.source_diff(_snapshot(t), source_b(t), KEY, ["g", "y"], ["e"])


@query(f"{DIFF_SQL} SELECT * FROM f")
def source_diff(t: Tables):
    return _diff(t)


@query(f"""{DIFF_SQL}, x AS (
  SELECT l_orderkey, l_suppkey, 'g' AS stat, a_g AS a_value, b_g AS b_value FROM f WHERE differs
  UNION ALL SELECT l_orderkey, l_suppkey, 'y', a_y, b_y FROM f WHERE differs
  UNION ALL SELECT l_orderkey, l_suppkey, 'e', a_e, b_e FROM f WHERE differs)
SELECT * FROM x WHERE a_value IS DISTINCT FROM b_value""")
def diff_exploded(t: Tables):
    return diff.explode_diff(_diff(t), KEY, ["g", "y", "e"])


@query(f"{DIFF_SQL} SELECT a_missing, differs, minutes_differ, count(*) AS n, count(*) FILTER (a_e IS NULL) AS no_minute FROM f GROUP BY ALL")
def diff_counts(t: Tables):
    return _diff(t).groupBy("a_missing", "differs", "minutes_differ").agg(F.count("*").alias("n"), F.count_if(F.col("a_e").isNull()).alias("no_minute"))


HISTORY_SQL = f"""WITH {A_SQL}, {B_SQL}, j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
  a.g AS ag, b.g AS bg, a.y AS ay, b.y AS by_, a.e AS ae, b.e AS be FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey),
x AS (SELECT l_orderkey, l_suppkey, 'g' AS stat, {{0}}(ag{{1}}) AS old_value, {{0}}(bg{{1}}) AS new_value FROM j
  UNION ALL SELECT l_orderkey, l_suppkey, 'y', {{0}}(ay{{1}}), {{0}}(by_{{1}}) FROM j
  UNION ALL SELECT l_orderkey, l_suppkey, 'e', ae, be FROM j)
SELECT * FROM x WHERE {{2}}"""


@query(HISTORY_SQL.format("coalesce", ", 0", "old_value IS DISTINCT FROM new_value"))
def change_history(t: Tables):
    return diff.changes(source_a(t), source_b(t), KEY, ["g", "y", "e"], absent={"g": 0, "y": 0})


@query(HISTORY_SQL.format("", "", "coalesce(old_value, 0) <> coalesce(new_value, 0)"))
def change_history_quiet(t: Tables):
    return diff.changes(source_a(t), source_b(t), KEY, ["g", "y", "e"], quiet=True)


STATUS = {"O": 0, "P": 1, "F": 2}
DELTA_STATUS_SQL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'F' WHEN '2' THEN 'P' ELSE 'O' END"
MERGE_SQL = f"""WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, epoch(o_orderdate)::BIGINT AS day FROM orders WHERE o_totalprice < 400000),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 1 END AS o_custkey, {DELTA_STATUS_SQL} AS status, epoch(o_orderdate)::BIGINT + 86400 AS day,
  (o_orderkey % 11 = 0 AND {DELTA_STATUS_SQL} = 'O') AS explicit FROM orders WHERE o_totalprice >= 100000),
j AS (SELECT coalesce(b.o_orderkey, d.o_orderkey) AS o_orderkey, b.o_orderkey IS NOT NULL AS in_b, d.o_orderkey IS NOT NULL AS in_d,
  b.o_custkey AS bc, d.o_custkey AS dc, b.status AS bs, d.status AS ds, b.day AS bd, d.day AS dd, coalesce(explicit, false) AS explicit
  FROM b FULL JOIN d ON b.o_orderkey = d.o_orderkey)"""


def _base_delta(t: Tables):
    day = F.unix_timestamp("o_orderdate")
    base = t.orders.where("o_totalprice < 400000").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), day.alias("day"))
    first = F.substring("o_orderpriority", 1, 1)
    status = F.when(first == "1", "F").when(first == "2", "P").otherwise("O")
    delta = t.orders.where("o_totalprice >= 100000").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 1).alias("o_custkey"), status.alias("status"), (day + 86400).alias("day"), ((F.col("o_orderkey") % 11 == 0) & (status == "O")).alias("explicit")
    )
    return base, delta


@query(f"""{MERGE_SQL} SELECT o_orderkey, coalesce(dc, bc) AS o_custkey,
  CASE WHEN NOT in_d OR (in_b AND NOT explicit AND instr('OPF', bs) > instr('OPF', ds)) THEN bs ELSE ds END AS status, CASE WHEN in_d THEN dd ELSE bd END AS day FROM j""")
def merge_forward_status(t: Tables):
    base, delta = _base_delta(t)
    rules = {"status": merge.forward_only(STATUS, F.col("d.explicit")), "o_custkey": merge.never_null}
    return merge.merge(base, delta, ["o_orderkey"], rules).drop("explicit")


@query(f"{MERGE_SQL} SELECT o_orderkey, coalesce(dc, bc) AS o_custkey, bs AS status, coalesce(dd, bd) AS day FROM j")
def merge_schedule_only(t: Tables):
    base, delta = _base_delta(t)
    return merge.restricted(base, delta, ["o_orderkey"], ["o_custkey", "day"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'""")
def patch_and_delete(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority").where("o_orderpriority <> '5-LOW'")
    return merge.patch(rows.drop("o_orderpriority"), F.col("o_orderkey") % 9 == 0, {"o_orderstatus": F.lit("X"), "o_custkey": F.lit(0).cast("long")})


@query("""SELECT l_orderkey, l_linenumber, l_quantity, 'old' AS origin FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40 AND l_linenumber <= 3)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2, 'new' FROM lineitem WHERE l_quantity >= 40 AND l_linenumber <= 3""")
def replace_children(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    delta = lines.where("l_quantity >= 40 AND l_linenumber <= 3").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("l_quantity"), F.lit("new").alias("origin"))
    return merge.replace_children(lines.withColumn("origin", F.lit("old")), delta, ["l_orderkey"])


@query("""WITH b AS (SELECT l_orderkey, l_suppkey, max(l_linenumber) > 5 AS bench FROM lineitem GROUP BY 1, 2),
f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 4),
w AS (SELECT l_orderkey FROM f GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3)
SELECT b.* FROM b WHERE NOT (NOT bench AND l_orderkey IN (SELECT l_orderkey FROM w) AND NOT EXISTS (SELECT 1 FROM f WHERE f.l_orderkey = b.l_orderkey AND f.l_suppkey = b.l_suppkey))""")
def prune_stale(t: Tables):
    base = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg((F.max("l_linenumber") > 5).alias("bench"))
    fresh = t.lineitem.where("l_linenumber <= 4").select("l_orderkey", "l_suppkey").distinct()
    return merge.prune(base, fresh, ["l_orderkey"], "l_suppkey", 3, ~F.col("bench"))


LAYERS_SQL = """WITH k AS (SELECT l_orderkey, l_suppkey, count(*)::INT AS g, sum((l_returnflag = 'R')::INT)::INT AS y, min(l_linenumber) FILTER (l_tax >= 0.04) AS e FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, g AS c_goals, y AS c_pens, (y % 2) AS c_assists, y AS c_yellows, e * 15 AS c_entered, (l_orderkey % 2 = 0) AS c_short,
  l_orderkey % 3 = 0 AS has_o, g + 1 AS o_goals, g AS o_yellows, l_orderkey % 6 = 0 AS has_oe, CASE WHEN l_suppkey % 2 = 0 THEN e * 20 END AS o_entered, l_orderkey % 10 = 0 AS has_m, 7 AS m_goals FROM k)"""


def _layers(t: Tables):
    k = source_like(t)
    m = lambda cond, *kv: F.when(cond, F.create_map(*[x if i % 2 else F.lit(x) for i, x in enumerate(kv)])).otherwise(F.create_map().cast("map<string,int>"))
    key = F.col("l_orderkey")
    crawled = F.create_map(F.lit("goals"), F.col("g"), F.lit("penalties"), F.col("y"), F.lit("assists"), F.col("y") % 2, F.lit("yellows"), F.col("y"), F.lit("entered"), F.col("e") * 15, F.lit("short"), F.when(key % 2 == 0, 1).otherwise(0))
    official = F.map_concat(m(key % 3 == 0, "goals", F.col("g") + 1, "yellows", F.col("g")), m(key % 6 == 0, "entered", F.when(F.col("l_suppkey") % 2 == 0, F.col("e") * 20).cast("int")))
    return k.select("l_orderkey", "l_suppkey", crawled.alias("crawled"), official.alias("official"), m(key % 10 == 0, "goals", F.lit(7)).alias("manual"))


def source_like(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").cast("int").alias("g"), F.sum((F.col("l_returnflag") == "R").cast("int")).cast("int").alias("y"), F.min(F.when(F.col("l_tax") >= 0.04, F.col("l_linenumber"))).alias("e"))


@query(f"""{LAYERS_SQL} SELECT l_orderkey, l_suppkey,
  CASE WHEN has_m THEN m_goals WHEN has_o THEN o_goals - least(coalesce(c_pens, 0), o_goals) ELSE c_goals END AS goals,
  CASE WHEN has_o THEN least(coalesce(c_pens, 0), o_goals) ELSE c_pens END AS penalties, c_assists AS assists,
  CASE WHEN has_o THEN o_yellows ELSE c_yellows END AS yellows, CASE WHEN has_oe THEN o_entered ELSE c_entered END AS entered,
  CASE WHEN has_oe THEN coalesce(o_entered >= 70, false) ELSE c_short END AS short FROM l""")
def overlay_precedence(t: Tables):
    out = overlay.effective(_layers(t), "crawled", "official", "manual")
    return out.select("l_orderkey", "l_suppkey", "goals", "penalties", "assists", "yellows", "entered", "short")


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) % 2 AS team FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2),
o0 AS (SELECT l_orderkey, CASE WHEN l_suppkey % 17 <> 0 THEN l_suppkey END AS l_suppkey, min(l_linenumber) % 2 AS team, count(*)::INT AS goals, nullif(sum((l_returnflag = 'R')::INT), 0)::INT AS yellows
  FROM lineitem WHERE l_linenumber <> 1 AND l_tax > 0 GROUP BY l_orderkey, lineitem.l_suppkey),
o AS (SELECT * FROM o0 UNION ALL SELECT * FROM o0 WHERE goals > 1 AND l_suppkey IS NOT NULL),
m AS (SELECT l_orderkey, l_suppkey, count(*) AS n, min(goals) AS goals, min(yellows) AS yellows FROM o WHERE l_suppkey IS NOT NULL GROUP BY 1, 2)
SELECT r.l_orderkey, r.l_suppkey, CASE
  WHEN r.l_orderkey % 8 = 1 OR r.l_orderkey NOT IN (SELECT l_orderkey FROM o) OR m.n > 1 THEN 'empty'
  WHEN m.n = 1 THEN 'goals=' || m.goals || coalesce(',yellows=' || m.yellows, '')
  WHEN EXISTS (SELECT 1 FROM o WHERE o.l_suppkey IS NULL AND o.l_orderkey = r.l_orderkey AND o.team IS NOT DISTINCT FROM r.team) THEN 'empty'
  ELSE 'goals=0,yellows=0' END AS layer
FROM r LEFT JOIN m ON r.l_orderkey = m.l_orderkey AND r.l_suppkey = m.l_suppkey""")
def overlay_build(t: Tables):
    rows = t.lineitem.where("l_linenumber <> 7").groupBy("l_orderkey", "l_suppkey").agg((F.min("l_linenumber") % 2).alias("team"))
    o = t.lineitem.where("l_linenumber <> 1 AND l_tax > 0").groupBy("l_orderkey", "l_suppkey").agg(
        (F.min("l_linenumber") % 2).alias("team"), F.count("*").cast("int").alias("goals"), F.nullif(F.sum((F.col("l_returnflag") == "R").cast("int")).cast("int"), F.lit(0)).alias("yellows")
    )
    o = o.withColumn("l_suppkey", F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey")))
    o = o.unionByName(o.where("goals > 1 AND l_suppkey IS NOT NULL"))
    built = overlay.build_official(rows, o, KEY, "team", F.col("l_orderkey") % 8 != 1, ["goals", "yellows"])
    said = F.array_join(F.transform(F.array_sort(F.map_entries("layer")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return built.select("l_orderkey", "l_suppkey", F.when(F.size("layer") == 0, "empty").otherwise(said).alias("layer"))


@query("""SELECT l_orderkey, l_suppkey, CASE WHEN l_orderkey % 4 = 0 THEN 'goals' WHEN l_orderkey % 10 = 0 AND l_orderkey % 3 <> 0 THEN 'goals' END AS has_key,
  CASE WHEN l_orderkey % 4 = 0 THEN 9 WHEN l_orderkey % 10 = 0 AND l_orderkey % 3 <> 0 THEN 7 END AS value FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""")
def overlay_manual_edit(t: Tables):
    key, name = F.col("l_orderkey"), F.lit("goals")
    m = F.col("manual")
    edited = F.when(key % 4 == 0, put(m, name, F.lit(9))).when(key % 3 == 0, without(m, name)).otherwise(m)
    return _layers(t).select(*KEY, edited.alias("m")).select(*KEY, F.get(F.map_keys("m"), F.lit(0)).alias("has_key"), F.try_element_at("m", name).alias("value"))


SEEN_SQL = """WITH b AS (SELECT o_custkey, o_orderpriority, count(*) % 4 <> 0 AS active FROM orders GROUP BY 1, 2),
s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice >= 300000 AND o_orderpriority <> '5-LOW')"""


def _members(t: Tables):
    base = t.orders.groupBy("o_custkey", "o_orderpriority").agg((F.count("*") % 4 != 0).alias("active"))
    seen = t.orders.where("o_totalprice >= 300000 AND o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderpriority").distinct()
    return base, seen


@query(f"""{SEEN_SQL} SELECT b.o_custkey, b.o_orderpriority, active AND NOT (b.o_orderpriority IN (SELECT o_orderpriority FROM s) AND s.o_custkey IS NULL) AS active,
  active AND b.o_orderpriority IN (SELECT o_orderpriority FROM s) AND s.o_custkey IS NULL AS left_now FROM b LEFT JOIN s ON b.o_custkey = s.o_custkey AND b.o_orderpriority = s.o_orderpriority""")
def soft_delete_reconcile(t: Tables):
    return merge.reconcile(*_members(t), ["o_orderpriority"], ["o_custkey"])


@query(f"{SEEN_SQL} SELECT o_custkey, o_orderpriority, 'not a member' AS reason FROM s ANTI JOIN (SELECT * FROM b WHERE active) x USING (o_custkey, o_orderpriority)")
def reject_unrostered(t: Tables):
    base, seen = _members(t)
    return seen.join(base.where("active"), ["o_custkey", "o_orderpriority"], "left_anti").withColumn("reason", F.lit("not a member"))


@query("""WITH x AS (SELECT *, CASE WHEN o_totalprice < 50000 THEN 'too small' WHEN o_orderstatus = 'P' THEN 'provisional' END AS reason FROM orders)
SELECT o_orderkey, o_orderstatus, reason FROM x WHERE reason IS NOT NULL""")
def upsert_rejects(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    _, bad = merge.upsert_checked(rows, {"too small": F.col("o_totalprice") < 50000, "provisional": F.col("o_orderstatus") == "P"})
    return bad.select("o_orderkey", "o_orderstatus", "reason")


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS seg FROM customer WHERE c_acctbal > 5000)
SELECT c.c_custkey, coalesce(d.seg, c.c_mktsegment) AS c_mktsegment, coalesce(d.seg <> c.c_mktsegment, false) AS changed FROM customer c LEFT JOIN d USING (c_custkey)""")
def join_update(t: Tables):
    base = t.customer.select("c_custkey", "c_mktsegment")
    other = t.customer.where("c_acctbal > 5000").select("c_custkey", "c_mktsegment").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("NEW"))
    return merge.update_from(base, other, ["c_custkey"], ["c_mktsegment"])
