"""Queries: linking, documents, queues, replay and worklists (families C, K, L, Q, V, O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import queue, replay
from ..operators.documents import nulls_last, ordered, to_json
from ..operators.diff import source_diff as compare
from ..operators.rank import cume_dist
from ..sources.tables import Tables, source_a, source_b
from .reconcile import A_SQL, B_SQL, KEY
from .registry import query


# Linking
@query("""WITH r AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, (l_linenumber = 2) AS best, (l_linenumber = 1) AS star, l_quantity AS score FROM lineitem),
f AS (SELECT *, bool_or(best) OVER (PARTITION BY l_orderkey) AS any_best, row_number() OVER (PARTITION BY l_orderkey, CASE WHEN best THEN 2 WHEN star THEN 1 ELSE 0 END ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM r)
SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM f WHERE rn = 1 AND (best OR (star AND NOT any_best))""")
def mvp_resolution(t: Tables):
    """One standout for each match: a 'best' label beats a 'star', whose highest score counts."""
    rank = F.when(F.col("l_linenumber") == 2, 2).when(F.col("l_linenumber") == 1, 1)
    best = F.max_by(F.struct("l_suppkey", "l_linenumber", "l_partkey"), F.struct(rank, "l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey")))
    return t.lineitem.where("l_linenumber <= 2").groupBy("l_orderkey").agg(best.alias("m")).select("l_orderkey", "m.*")


# Documents
@query("""WITH e AS (SELECT l_orderkey, '[' || string_agg('{"n":' || l_linenumber || ',"p":' || l_partkey || ',"r":' || CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '"' || l_returnflag || '"' END || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"order":{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"},"customer":"' || c_name || '","lines":' || coalesce(lines, '[]') || '}' AS doc FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON l_orderkey = o_orderkey""")
def match_document(t: Tables):
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.nullif("l_returnflag", F.lit("N")).alias("r"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(ordered([F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], item).alias("lines"))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, "o_orderkey", "left")
    empty = F.array().cast("array<struct<n:int,p:bigint,r:string>>")
    doc = F.struct(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("order"), F.col("c_name").alias("customer"), F.coalesce("lines", empty).alias("lines"))
    return j.select("o_orderkey", to_json(doc).alias("doc"))


@query("""SELECT n_nationkey, '{"team":"' || n_name || '","roster":[' || coalesce(string_agg('{"k":' || c_custkey || ',"g":' || coalesce('"' || nullif(c_mktsegment, 'MACHINERY') || '"', 'null') || '}', ',' ORDER BY nullif(c_mktsegment, 'MACHINERY') NULLS LAST, c_custkey), '') || ']}' AS doc
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def roster_document(t: Tables):
    group = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    r = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(ordered([*nulls_last(group), F.col("c_custkey")], F.struct(F.col("c_custkey").alias("k"), group.alias("g"))).alias("roster"))
    j = t.nation.join(r, "n_nationkey", "left")
    return j.select("n_nationkey", to_json(F.struct(F.col("n_name").alias("team"), F.coalesce("roster", F.array().cast("array<struct<k:bigint,g:string>>")).alias("roster"))).alias("doc"))


@query("""SELECT r_regionkey, '{"id":' || r_regionkey || ',"name":"' || r_name || '","teams":[' || coalesce(string_agg('"' || n_name || '"', ',' ORDER BY n_name), '') || '],"counts":{"teams":' || count(n_name) || ',"players":' || coalesce(sum(players), 0)::BIGINT || '}}' AS doc
FROM region LEFT JOIN (SELECT n_name, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS players FROM nation) n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def competition_document(t: Tables):
    players = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("players"))
    teams = t.nation.join(players, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("teams"), F.coalesce(F.sum("players"), F.lit(0)).alias("players"))
    j = t.region.join(teams, "r_regionkey", "left").withColumn("teams", F.coalesce("teams", F.array().cast("array<string>")))
    doc = F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "teams", F.struct(F.size("teams").alias("teams"), F.coalesce("players", F.lit(0)).alias("players")).alias("counts"))
    return j.select("r_regionkey", to_json(doc).alias("doc"))


@query("""SELECT c_custkey, '{"player":{"id":' || c_custkey || ',"name":"' || c_name || '"},"team":' || coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 0)::VARCHAR, 'null') || '}' AS doc FROM customer""")
def player_document(t: Tables):
    team = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("team"))
    doc = F.struct(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("player"), "team")
    return t.customer.join(team, "c_nationkey", "left").select("c_custkey", to_json(doc).alias("doc"))


@query("""SELECT 'competition' AS kind, r_regionkey::VARCHAR AS id, r_name AS name FROM region UNION ALL SELECT 'team', n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'player', c_custkey::VARCHAR, c_name FROM customer
UNION ALL SELECT 'fixture', o_orderkey::VARCHAR, o_orderstatus FROM orders UNION ALL SELECT 'stats', l_orderkey || ':' || l_suppkey, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def export_snapshot(t: Tables):
    one = lambda df, kind, key, name: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), name.cast("string").alias("name"))
    stats = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    out = one(t.region, "competition", F.col("r_regionkey"), F.col("r_name"))
    for df, kind, key, name in ((t.nation, "team", "n_nationkey", "n_name"), (t.customer, "player", "c_custkey", "c_name"), (t.orders, "fixture", "o_orderkey", "o_orderstatus")):
        out = out.unionByName(one(df, kind, F.col(key), F.col(name)))
    return out.unionByName(one(stats, "stats", F.concat_ws(":", "l_orderkey", "l_suppkey"), F.col("n")))


# Queues
@query("""WITH d AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), e AS (SELECT e.* FROM events e LEFT JOIN d USING (user_id) WHERE event_type <> 'purchase' AND (last IS NULL OR (ts, event_id) > last))
SELECT user_id, count(*) AS n, min(event_id) AS first_event_id, max(event_id) AS last_event_id, max_by(value, event_id) FILTER (event_type = 'click') AS route FROM e GROUP BY 1""")
def outbox_coalesce(t: Tables):
    e = t.events.withColumn("route", F.when(F.col("event_type") == "click", F.col("value")))
    out = queue.coalesce_events(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "route")
    return out.select("user_id", "n", "first_event_id", "last_event_id", "route")


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS c FROM orders)
SELECT o_orderkey FROM orders JOIN d USING (o_orderkey) WHERE o_orderstatus IS DISTINCT FROM s OR o_custkey IS DISTINCT FROM c""")
def outbox_noop_filter(t: Tables):
    from ..functions.layers import differs

    o = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    d = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("c"))
    return o.join(d, "o_orderkey").where(differs([F.col("o_orderstatus"), F.col("o_custkey")], [F.col("s"), F.col("c")])).select("o_orderkey")


@query("SELECT DISTINCT c_custkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 8000 AND o_orderstatus <> 'F'")
def player_fanout(t: Tables):
    c = t.customer.where("c_acctbal > 8000").select("c_custkey")
    return c.join(t.orders.where("o_orderstatus <> 'F'"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderpriority").distinct()


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS league FROM supplier WHERE s_acctbal > 0), r AS (SELECT c_custkey, nullif(c_nationkey, 4) AS league FROM customer)
SELECT c_custkey, s_suppkey FROM r JOIN s ON s.league IS NULL OR s.league = r.league""")
def route_subscribers(t: Tables):
    s = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey")).alias("sub_league"), (F.col("s_acctbal") > 0).alias("active"))
    r = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(4)).alias("league"))
    return queue.route(r, s, "league", "sub_league").select("c_custkey", "s_suppkey")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber + 1 AS attempts, l_returnflag <> 'R' AS payload, l_quantity::INT % 3 AS listeners, l_quantity::INT % 2 AS failures FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, s AS status, CASE WHEN s = 'pending' THEN 1704067200 + least(5 * (2 ** (attempts - 1)), 300)::BIGINT END AS next_at FROM (SELECT *, CASE WHEN NOT payload OR listeners = 0 OR failures = 0 THEN 'delivered' WHEN attempts >= 8 THEN 'failed' ELSE 'pending' END AS s FROM x)""")
def retry_schedule(t: Tables):
    q = F.col("l_quantity").cast("int")
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") + 1).alias("attempts"), (F.col("l_returnflag") != "R").alias("p"), (q % 3).alias("l"), (q % 2).alias("f"))
    out = queue.delivered(x, F.col("p"), F.col("l"), F.col("f"), F.lit("2024-01-01").cast("timestamp"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "status", F.unix_timestamp("next_attempt_at").alias("next_at"))


JOBS_SQL = """jobs AS (SELECT event_id AS id, user_id::VARCHAR AS dedupe_key, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' ELSE 'done' END AS status, CASE WHEN event_id % 9 = 0 THEN 'watch' ELSE 'round' END AS kind,
 (event_id % 4)::INT AS attempts, 3 AS max_attempts, epoch(date_trunc('second', ts))::BIGINT + 300 AS lease FROM events)"""


def _jobs(t: Tables):
    e = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("dedupe_key"), F.when(e == "click", "pending").when(e == "view", "running").otherwise("done").alias("status"),
        F.when(F.col("event_id") % 9 == 0, "watch").otherwise("round").alias("kind"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.date_trunc("second", F.col("ts") + F.make_interval(mins=F.lit(5))).alias("lease_expires_at"),
    )


AS_OF = "2024-01-15"


@query(f"WITH {JOBS_SQL} SELECT w.dedupe_key, min(id) AS existing_id FROM (SELECT DISTINCT (c_custkey % 300)::VARCHAR AS dedupe_key FROM customer) w LEFT JOIN (SELECT * FROM jobs WHERE status IN ('pending', 'running')) j USING (dedupe_key) GROUP BY 1")
def job_enqueue_dedupe(t: Tables):
    return queue.enqueue(_jobs(t), t.customer.select((F.col("c_custkey") % 300).cast("string").alias("dedupe_key")))


@query(f"""WITH {JOBS_SQL} SELECT id, CASE WHEN status = 'running' AND lease < 1705276800 THEN CASE WHEN attempts >= 3 THEN 'error' ELSE 'pending' END ELSE status END AS status, CASE WHEN NOT (status = 'running' AND lease < 1705276800) THEN lease END AS lease FROM jobs""")
def job_reclaim(t: Tables):
    out = queue.reclaim(_jobs(t), F.lit(AS_OF).cast("timestamp"))
    return out.select("id", "status", F.unix_timestamp("lease_expires_at").alias("lease"))


@query(f"WITH {JOBS_SQL} SELECT id, CASE WHEN status <> 'running' THEN status WHEN id % 2 = 0 THEN 'done' WHEN attempts >= 3 THEN 'error' ELSE 'pending' END AS status FROM jobs")
def job_finish(t: Tables):
    return queue.finish(_jobs(t), F.col("id") % 2 == 1).select("id", "status")


@query(f"""WITH {JOBS_SQL}, g AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running' AND lease >= 1705276800 AND kind <> 'watch') AS draining FROM jobs)
SELECT pending, draining, pending > 0 AND draining = 0 AS wake FROM g""")
def wake_decision(t: Tables):
    return queue.wake(_jobs(t), F.lit("2024-01-14 23:59:00").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))


@query(f"WITH {JOBS_SQL} SELECT kind, count(*) AS stalled, min(id) AS oldest FROM jobs WHERE status = 'pending' AND lease < 1705276800 GROUP BY 1")
def stalled_queue(t: Tables):
    j = _jobs(t).where((F.col("status") == "pending") & (F.col("lease_expires_at") < F.lit(AS_OF).cast("timestamp")))
    return j.groupBy("kind").agg(F.count("*").alias("stalled"), F.min("id").alias("oldest"))


@query(f"""WITH {JOBS_SQL}, p AS (SELECT *, count(*) FILTER (status = 'pending') OVER (PARTITION BY dedupe_key) AS n FROM jobs)
SELECT id, CASE WHEN id % 10 = 3 THEN CASE WHEN n - (status = 'pending')::INT > 0 THEN 'delivered' ELSE 'pending' END ELSE status END AS status FROM p""")
def requeue_one(t: Tables):
    return queue.requeue(_jobs(t), F.col("id") % 10 == 3, "dedupe_key").select("id", "status")


@query(f"WITH {JOBS_SQL} SELECT c_custkey::VARCHAR AS dedupe_key FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT dedupe_key FROM jobs WHERE status = 'pending')")
def replay_all(t: Tables):
    wanted = t.customer.select(F.col("c_custkey").cast("string").alias("dedupe_key"))
    return wanted.join(_jobs(t).where("status = 'pending'"), "dedupe_key", "left_anti")


@query("""SELECT event_type, CASE event_type WHEN 'click' THEN 'watch' WHEN 'view' THEN 'match' ELSE 'backfill' END AS kind, CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 50 ELSE 90 END AS priority, count(*) AS n FROM events GROUP BY 1""")
def job_plan(t: Tables):
    kind = F.when(F.col("event_type") == "click", "watch").when(F.col("event_type") == "view", "match").otherwise("backfill")
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("kind", kind)
    return g.select("event_type", "kind", F.try_element_at(F.create_map(*[F.lit(x) for kv in queue.PRIORITY.items() for x in kv]), F.col("kind")).alias("priority"), "n")


@query("""WITH g AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS done, bool_or(o_orderstatus = 'P') AS live, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'DEACTIVATE' WHEN done THEN 'SKIP' WHEN live AND n > 10 THEN 'CRAWL_PHASE' WHEN live THEN 'CRAWL' ELSE 'SKIP' END AS decision FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def sweep_decision(t: Tables):
    g = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("done"), F.bool_or(F.col("o_orderstatus") == "P").alias("live"), F.count("*").alias("n"))
    j = t.customer.select("c_custkey").join(g, "c_custkey", "left")
    d = F.when(F.col("n").isNull(), "DEACTIVATE").when(F.col("done"), "SKIP").when(F.col("live") & (F.col("n") > 10), "CRAWL_PHASE").when(F.col("live"), "CRAWL").otherwise("SKIP")
    return j.select("c_custkey", d.alias("decision"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2)""")
def unscored_finished(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_suppkey")
    both = lines.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n >= 2")
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey").join(lines.where("l_returnflag = 'N'"), "o_orderkey", "left_semi").join(both, "o_orderkey", "left_anti")


@query("""WITH r AS (SELECT o_custkey, unnest(range(1, 8)) AS round FROM (SELECT DISTINCT o_custkey FROM orders)), h AS (SELECT o_custkey, (o_orderkey % 7 + 1) AS round, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1, 2)
SELECT o_custkey, round::INT AS round, (row_number() OVER (PARTITION BY o_custkey ORDER BY round) + 7)::INT AS step FROM r LEFT JOIN h USING (o_custkey, round) WHERE NOT coalesce(done, false)""")
def backfill_plan(t: Tables):
    rounds = t.orders.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("round"))
    done = t.orders.groupBy("o_custkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("round")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("done")).where("done")
    left = rounds.join(done, ["o_custkey", "round"], "left_anti")
    return left.withColumn("step", F.row_number().over(Window.partitionBy("o_custkey").orderBy("round")) + 7)


# Replay and live
TICKS, WINDOW = list(range(0, 9001, 1500)), 300
REPLAY_SQL = """t AS (SELECT event_id, user_id, (dense_rank() OVER (ORDER BY ts::DATE) - 1)::BIGINT AS day, (event_id % 5)::INT AS target FROM events),
r AS (SELECT *, (elapsed - day * 300) / 300.0::DOUBLE AS f FROM t, (SELECT unnest(range(0, 9001, 1500))::INT AS elapsed)),
s AS (SELECT event_id, user_id, elapsed, CASE WHEN f < 0 THEN 'scheduled' WHEN f < 1 THEN 'live' ELSE 'final' END AS state, least(target, floor(greatest(least(f, 1), 0) * (target + 1)))::INT AS shown, floor(greatest(least(f, 1), 0) * 94)::INT AS clock FROM r)"""


def _replay(t: Tables):
    days = t.events.select(F.to_date("ts").alias("d")).distinct().withColumn("day", F.dense_rank().over(Window.orderBy("d")).cast("long") - 1)
    targets = t.events.withColumn("d", F.to_date("ts")).join(days, "d").select("event_id", "user_id", "day", (F.col("event_id") % 5).cast("int").alias("target"))
    return replay.replay(targets, F.col("day"), F.col("target"), TICKS, WINDOW)


@query(f"WITH {REPLAY_SQL} SELECT * FROM s")
def replay_state(t: Tables):
    return _replay(t).select("event_id", "user_id", "elapsed", "state", "shown", "clock")


@query(f"WITH {REPLAY_SQL} SELECT user_id, elapsed, sum(CASE WHEN event_id % 2 = 0 THEN shown ELSE 0 END)::BIGINT AS home, sum(CASE WHEN event_id % 2 = 1 THEN shown ELSE 0 END)::BIGINT AS away FROM s GROUP BY 1, 2")
def replay_scoreline(t: Tables):
    side = F.col("event_id") % 2
    return _replay(t).groupBy("user_id", "elapsed").agg(F.sum(F.when(side == 0, F.col("shown")).otherwise(0)).alias("home"), F.sum(F.when(side == 1, F.col("shown")).otherwise(0)).alias("away"))


@query(f"WITH {REPLAY_SQL}, m AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN (event_id * 13 % 95)::INT END AS minute FROM s) SELECT event_id, elapsed, clock, CASE WHEN clock >= minute THEN minute END AS sub_minute, state = 'live' AND coalesce(clock >= minute, false) AS on_field FROM m")
def replay_reveal(t: Tables):
    """Substitutions show once the clock has reached their minute."""
    minute = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") * 13 % 95).cast("int"))
    x = _replay(t).select("event_id", "elapsed", "clock", "state", minute.alias("minute"))
    shown = replay.revealed(F.col("clock"), F.col("minute"), F.col("minute"))
    return x.select("event_id", "elapsed", "clock", shown.alias("sub_minute"), ((F.col("state") == "live") & shown.isNotNull()).alias("on_field"))


@query(f"""WITH {REPLAY_SQL}, p AS (SELECT *, lag(state) OVER w AS ps, lag(shown) OVER w AS pn FROM s WINDOW w AS (PARTITION BY event_id ORDER BY elapsed))
SELECT event_id, elapsed, state, shown FROM p WHERE state IS DISTINCT FROM ps OR shown IS DISTINCT FROM pn""")
def replay_transitions(t: Tables):
    return replay.transitions(_replay(t), ["event_id"], ["state", "shown"]).select("event_id", "elapsed", "state", "shown")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts >= timestamp '2024-01-15 00:00:00' - INTERVAL 90 MINUTE AND ts <= timestamp '2024-01-15 00:00:00' + INTERVAL 5 MINUTE")
def kickoff_window(t: Tables):
    as_of = F.lit(AS_OF).cast("timestamp")
    due = F.col("ts").between(as_of - F.make_interval(mins=F.lit(90)), as_of + F.make_interval(mins=F.lit(5)))
    return t.events.where((F.col("event_type") == "view") & due).select("event_id")


@query("SELECT user_id, max(ts) < timestamp '2024-01-30 00:00:00' AS dead FROM events GROUP BY 1")
def liveness(t: Tables):
    return t.events.groupBy("user_id").agg((F.max("ts") < F.lit("2024-01-30").cast("timestamp")).alias("dead"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts, lag(ts) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'final' WHEN before IS NULL THEN 'first' WHEN ts - before >= INTERVAL 6 HOUR THEN 'reseed' WHEN event_type <> was THEN 'full' ELSE 'light' END AS action FROM e""")
def watch_actions(t: Tables):
    """What a watcher does at each poll: final, first sight, reseed after a gap, full on a change, else light."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, was = F.lag("ts").over(w), F.lag("event_type").over(w)
    action = F.when(F.col("event_type") == "purchase", "final").when(before.isNull(), "first").when(F.col("ts") - before >= F.expr("INTERVAL '6' HOUR"), "reseed").when(F.col("event_type") != was, "full").otherwise("light")
    return t.events.select("user_id", "event_id", action.alias("action"))


@query("""SELECT o_orderkey, CASE WHEN d < 0 THEN 'wait' WHEN d = 0 THEN 'hourly' WHEN d <= 1 THEN 'once' WHEN d <= 14 THEN 'settle' ELSE 'stop' END AS cadence FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-06-15') AS d FROM orders)""")
def recheck_cadence(t: Tables):
    d = F.datediff(F.lit("1998-06-15").cast("date"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", F.when(d < 0, "wait").when(d == 0, "hourly").when(d <= 1, "once").when(d <= 14, "settle").otherwise("stop").alias("cadence"))


# Worklists
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def v_live_matches(t: Tables):
    return t.orders.where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("""SELECT coalesce(r_name, 'Miscellaneous') AS league, o_orderpriority AS round, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 0) r ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def v_matches_by_league(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.coalesce("r_name", F.lit("Miscellaneous")).alias("league"), F.col("o_orderpriority").alias("round")).agg(F.count("*").alias("n"))


COVER_SQL = "g AS (SELECT l_orderkey, count(*) AS players, count(*) FILTER (l_returnflag = 'A') AS linked, bool_or(l_linenumber = 1) AS has_mvp, bool_or(l_linenumber = 1 AND l_returnflag = 'N') AS no_score FROM lineitem GROUP BY 1)"


def _cover(t: Tables):
    one = F.col("l_linenumber") == 1
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("players"), F.count_if(F.col("l_returnflag") == "A").alias("linked"), F.bool_or(one).alias("has_mvp"), F.bool_or(one & (F.col("l_returnflag") == "N")).alias("no_score"))


@query(f"WITH {COVER_SQL} SELECT l_orderkey, CASE WHEN linked = players THEN 'full' WHEN linked = 0 THEN 'none' WHEN has_mvp THEN 'partial' ELSE 'no mvp' END AS badge FROM g")
def v_round_badges(t: Tables):
    badge = F.when(F.col("linked") == F.col("players"), "full").when(F.col("linked") == 0, "none").when(F.col("has_mvp"), "partial").otherwise("no mvp")
    return _cover(t).select("l_orderkey", badge.alias("badge"))


@query(f"WITH {COVER_SQL} SELECT l_orderkey, players, linked FROM g WHERE linked > 0 AND linked < players")
def v_linking_issues(t: Tables):
    return _cover(t).where("linked > 0 AND linked < players").select("l_orderkey", "players", "linked")


@query(f"WITH {COVER_SQL} SELECT l_orderkey, CASE WHEN NOT has_mvp THEN 'no mvp' ELSE 'mvp without score' END AS issue FROM g WHERE NOT has_mvp OR no_score")
def v_mvp_issues(t: Tables):
    return _cover(t).where("NOT has_mvp OR no_score").select("l_orderkey", F.when(~F.col("has_mvp"), "no mvp").otherwise("mvp without score").alias("issue"))


@query(f"""WITH {A_SQL}, {B_SQL}, d AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.g, 0) <> coalesce(b.g, 0) AS dg, coalesce(a.y, 0) <> coalesce(b.y, 0) AS dy FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey)
SELECT o_orderpriority AS round, count(DISTINCT l_orderkey) FILTER (dg OR dy) AS matches, count(*) FILTER (dg) AS goals, count(*) FILTER (dy) AS yellows FROM d JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def v_official_diff(t: Tables):
    d = compare(source_a(t).drop("e"), source_b(t).drop("e"), KEY, ["g", "y"], [])
    j = d.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("round")), "l_orderkey")
    g, y = F.col("a_g") != F.col("b_g"), F.col("a_y") != F.col("b_y")
    return j.groupBy("round").agg(F.countDistinct(F.when(g | y, F.col("l_orderkey"))).alias("matches"), F.count_if(g).alias("goals"), F.count_if(y).alias("yellows"))


@query("SELECT event_type, value, round(100 * cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS percentile, event_id FROM events")
def v_rating_distribution(t: Tables):
    x = cume_dist(t.events.select("event_type", "value", "event_id"), "event_type", "value", 0.5, "share")
    return x.select("event_type", "value", F.round(100 * F.col("share"), 6).alias("percentile"), "event_id")


@query("""SELECT r_regionkey, r_name, count(DISTINCT n_nationkey) AS teams, count(c_custkey) AS players FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def v_competitions(t: Tables):
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("players"))
    g = t.nation.join(n, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("teams"), F.sum("players").alias("players"))
    return t.region.join(g, "r_regionkey", "left").select("r_regionkey", "r_name", F.coalesce("teams", F.lit(0)).alias("teams"), F.coalesce("players", F.lit(0)).alias("players"))


@query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 0 DESC, c_mktsegment, coalesce(nullif(c_custkey % 30, 0), 99), c_custkey) AS place FROM customer""")
def v_team_roster(t: Tables):
    shirt = F.coalesce(F.nullif(F.col("c_custkey") % 30, F.lit(0)), F.lit(99))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc(F.col("c_acctbal") > 0), "c_mktsegment", shirt, "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM orders")
def v_membership_history(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("newest"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)")
def v_unlinked_leftovers(t: Tables):
    linked = t.lineitem.where("l_returnflag = 'A' AND l_linenumber = 1").select("l_partkey")
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber").join(linked, "l_partkey", "left_anti")


@query(f"WITH {JOBS_SQL} SELECT kind, status, count(*) AS n, max(id) AS latest FROM jobs GROUP BY 1, 2")
def v_runs_panel(t: Tables):
    return _jobs(t).groupBy("kind", "status").agg(F.count("*").alias("n"), F.max("id").alias("latest"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 8")
def discovery_verified(t: Tables):
    """Candidates count only if they hold eight entries or more."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 8").select("l_orderkey")


@query("SELECT user_id, max_by(event_id, event_id) AS run, max_by(event_type, event_id) AS outcome, count(*) AS runs FROM events GROUP BY 1")
def run_log_latest(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("run"), F.max_by("event_type", "event_id").alias("outcome"), F.count("*").alias("runs"))
