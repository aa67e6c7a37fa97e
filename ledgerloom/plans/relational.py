"""Queries: scans, joins, aggregates, windows, order, sets (families A, P, J, G, W, S, U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.layers import bucket, parse_ranges
from ..functions.text import tokens
from ..operators import match
from ..operators.rank import cume_dist
from ..operators.documents import ordered, to_json
from ..sources.tables import Tables, page, scan
from .registry import query


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 100000 AND o_orderpriority ILIKE '%high%'""")
def filtered_scan(t: Tables):
    return scan(t.orders, {"o_orderstatus": ("in", ["O", "F"]), "o_totalprice": ("gte", 100000), "o_orderpriority": ("ilike", "%high%")}, ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_scan(t: Tables):
    return page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25, 2)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) x ON l_orderkey = o_orderkey")
def in_list_lookup(t: Tables):
    ids = t.orders.where("o_totalprice > 450000").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(ids, "l_orderkey", "left_semi")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def exact_count(t: Tables):
    return t.orders.where("o_orderstatus <> 'F'").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 350000 THEN 'hi' WHEN o_totalprice <= 100000 THEN 'lo' END AS band FROM orders")
def value_band(t: Tables):
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") >= 350000, "hi").when(F.col("o_totalprice") <= 100000, "lo").alias("band"))


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n_regionkey = r_regionkey""")
def star_details(t: Tables):
    # The dimensions' sizes are known to the planner, which broadcasts those that are small.
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.join(t.region.where("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT s_suppkey, s_name, n_name, coalesce(nullif(s_nationkey, 3), c_nationkey) AS nation, greatest(s_acctbal, c_acctbal) AS latest
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN customer ON c_custkey = s_suppkey * 2""")
def roster_details(t: Tables):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.customer, F.col("c_custkey") == F.col("s_suppkey") * 2, "left")
    return j.select("s_suppkey", "s_name", "n_name", F.coalesce(F.nullif("s_nationkey", F.lit(3)), "c_nationkey").alias("nation"), F.greatest("s_acctbal", "c_acctbal").alias("latest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, cn.n_name AS home, sn.n_name AS away FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey""")
def double_role_join(t: Tables):
    role = lambda key, name: t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(role("c_nationkey", "home"), "c_nationkey").join(role("s_nationkey", "away"), "s_nationkey")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "home", "away")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_open_rounds(t: Tables):
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unseen(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT c_custkey, n, last_day FROM customer, LATERAL (SELECT count(*) AS n, max(epoch(o_orderdate))::BIGINT AS last_day FROM orders WHERE o_custkey = c_custkey) x""")
def lateral_derived(t: Tables):
    g = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.unix_timestamp("o_orderdate")).alias("last_day"))
    return t.customer.select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_day")


@query("""SELECT e.event_id, p_partkey, p_name FROM (SELECT event_id, unnest([json_extract(props, '$.k')::BIGINT, user_id]) AS k FROM events) e JOIN part ON p_partkey = k""")
def lateral_unnest(t: Tables):
    ids = F.explode(F.concat(F.array(F.get_json_object("props", "$.k").cast("long")), F.array("user_id")))
    return t.events.select("event_id", ids.alias("p_partkey")).join(t.part.select("p_partkey", "p_name"), "p_partkey").select("event_id", "p_partkey", "p_name")


RANGES = {"0-100000": 4, "100000-200000": 5, "200000-300000": 6.4, "300000-600000": 7, "oops": 1}


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN NULL WHEN o_totalprice < 100000 THEN 4 WHEN o_totalprice < 200000 THEN 5 WHEN o_totalprice < 300000 THEN 6
WHEN o_totalprice <= 600000 THEN 7 END AS score FROM orders""")
def bucket_score(t: Tables):
    return t.orders.select("o_orderkey", bucket(F.col("o_totalprice"), parse_ranges(RANGES)).alias("score"))


@query("""WITH m AS (SELECT o_orderkey, timestamp '2024-01-01' + INTERVAL (o_orderkey % 30) DAY AS since FROM orders),
e AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase')
SELECT o_orderkey, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM m JOIN e ON ts >= since AND ts <= since + INTERVAL 2 DAY GROUP BY 1""")
def interval_match(t: Tables):
    m = t.orders.select("o_orderkey", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("o_orderkey") % 30).cast("int"))).alias("since"))
    return match.first_in_window(m, t.events.where("event_type = 'purchase'"), "o_orderkey", "since", "ts", 2, "event_id")


@query("""WITH p AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM part),
q AS (SELECT DISTINCT on (w) p_brand || p_type AS id, w FROM (SELECT p_brand, p_type, list_sort(list_distinct([lower(p_type), list_extract(string_split(p_name, ' '), 1)])) AS w FROM part) ORDER BY w, id)
SELECT p_partkey, CASE WHEN count(*) = 1 THEN min(q.id) END AS id, count(*)::INT AS n_candidates FROM p JOIN q ON (list_has_all(q.w, p.w) OR list_has_all(p.w, q.w)) AND list_has_any(p.w, q.w) GROUP BY 1""")
def token_subset_join(t: Tables):
    p = t.part.select("p_partkey", tokens(F.col("p_name")).alias("w"))
    q = t.part.select(F.concat("p_brand", "p_type").alias("id"), F.array_sort(F.array_distinct(F.array(F.lower("p_type"), F.split("p_name", " ")[0]))).alias("w"))
    return match.unique_subset(p, q.groupBy("w").agg(F.min("id").alias("id")), "p_partkey", "id", "w")


@query("SELECT nationkey, n_name FROM (SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier) JOIN nation ON nationkey = n_nationkey")
def role_union_distinct(t: Tables):
    both = t.customer.select(F.col("c_nationkey").alias("nationkey")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nationkey"))).distinct()
    return both.join(t.nation, F.col("nationkey") == F.col("n_nationkey")).select("nationkey", "n_name")


@query("SELECT o_orderkey, fixed FROM orders JOIN (VALUES ('1-URGENT', 'a'), ('2-HIGH', 'b')) v(p, fixed) ON o_orderpriority = p")
def values_join(t: Tables):
    v = t.spark.sql("SELECT * FROM VALUES ('1-URGENT', 'a'), ('2-HIGH', 'b') AS v(o_orderpriority, fixed)")
    return t.orders.join(v, "o_orderpriority").select("o_orderkey", "fixed")


@query("""SELECT conv_id, count(*) FILTER (role <> 'system') AS players, count(*) FILTER (role <> 'system' AND length(text) > 200) AS linked, bool_or(role = 'system') AS fetched,
coalesce(max(CASE WHEN role = 'assistant' THEN length(text) END), 0)::INT AS best FROM conversations GROUP BY 1""")
def coverage(t: Tables):
    played = F.col("role") != "system"
    return t.conversations.groupBy("conv_id").agg(
        F.count_if(played).alias("players"),
        F.count_if(played & (F.length("text") > 200)).alias("linked"),
        F.bool_or(F.col("role") == "system").alias("fetched"),
        F.coalesce(F.max(F.when(F.col("role") == "assistant", F.length("text"))), F.lit(0)).alias("best"),
    )


@query("SELECT count(*) FILTER (l_tax > 0.02) AS taxed, sum(CASE WHEN l_tax > 0.02 THEN l_linenumber ELSE 0 END)::BIGINT AS lines FROM lineitem")
def filtered_sum(t: Tables):
    return t.lineitem.agg(F.count_if(F.col("l_tax") > 0.02).alias("taxed"), F.sum(F.when(F.col("l_tax") > 0.02, F.col("l_linenumber")).otherwise(0)).alias("lines"))


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS suppliers FROM nation""")
def parent_counts(t: Tables):
    c = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    j = t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return j.select("n_nationkey", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def status_counts(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_changed(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"))


SCORE_SQL = """SELECT l_orderkey, coalesce(sum(CASE WHEN l_suppkey % 2 = 0 THEN (l_returnflag = 'R')::INT ELSE (l_returnflag = 'A')::INT END), 0)::BIGINT AS home,
coalesce(sum(CASE WHEN l_suppkey % 2 = 1 THEN (l_returnflag = 'R')::INT ELSE (l_returnflag = 'A')::INT END), 0)::BIGINT AS away FROM lineitem GROUP BY 1"""


@query(SCORE_SQL)
def cross_team_score(t: Tables):
    own, other = (F.col("l_returnflag") == "R").cast("int"), (F.col("l_returnflag") == "A").cast("int")
    side = F.col("l_suppkey") % 2
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(side == 0, own).otherwise(other)).alias("home"), F.sum(F.when(side == 1, own).otherwise(other)).alias("away"))


@query("SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, round(avg(p_size), 4) AS mean FROM part GROUP BY 1")
def min_max_avg(t: Tables):
    return t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.round(F.avg("p_size"), 4).alias("mean"))


@query("SELECT c_nationkey, list(DISTINCT c_mktsegment ORDER BY c_mktsegment)::VARCHAR AS segments FROM customer GROUP BY 1")
def distinct_array(t: Tables):
    joined = F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ")
    return t.customer.groupBy("c_nationkey").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("segments"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_final, bool_or(o_orderstatus = 'P') AS any_live, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1")
def status_map(t: Tables):
    return t.orders.groupBy("o_custkey").agg(
        F.bool_and(F.col("o_orderstatus") == "F").alias("all_final"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_live"),
        F.array_join(ordered([F.col("o_orderkey")], F.col("o_orderstatus")), "").alias("statuses"),
    )


def _dedupe_sql(order: str) -> str:
    return f"SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {order}) AS rn FROM events) WHERE rn = 1"


@query(_dedupe_sql("DESC"))
def dedupe_last(t: Tables):
    return match.dedupe(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], first=False)


@query(_dedupe_sql("ASC"))
def dedupe_first(t: Tables):
    return match.dedupe(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"], first=True)


@query("""WITH e AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS d FROM events)
SELECT user_id, (value * 100)::INT % 10 AS score, min(event_id) AS event_id, min_by(d, event_id) FILTER (d IS NOT NULL) AS described, bool_or(event_type = 'error') AS flagged FROM e GROUP BY 1, 2""")
def dedupe_merge(t: Tables):
    e = t.events.withColumn("d", F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))).withColumn("score", F.round(F.col("value") * 100).cast("int") % 10)
    return e.groupBy("user_id", "score").agg(F.min("event_id").alias("event_id"), F.min_by("d", F.when(F.col("d").isNotNull(), F.col("event_id"))).alias("described"), F.bool_or(F.col("event_type") == "error").alias("flagged"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 100000) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmax_first_tie(t: Tables):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.floor(F.col("o_totalprice") / 100000), -F.col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(best.alias("m")).select("o_custkey", "m.o_orderkey", "m.o_totalprice")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_owners(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def single_owner(t: Tables):
    return match.single_owner(t.lineitem.where("l_quantity > 45"), "l_partkey", "l_suppkey")


@query("""SELECT c_nationkey, c_custkey, rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY rank, c_name, c_custkey) AS place FROM (SELECT *, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 9 END AS rank
FROM customer)""")
def group_order(t: Tables):
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit("MACHINERY"), F.lit(0), F.lit("BUILDING"), F.lit(1), F.lit("AUTOMOBILE"), F.lit(2)), F.col("c_mktsegment")), F.lit(9))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("rank", "c_name", "c_custkey"))
    return t.customer.withColumn("rank", rank).select("c_nationkey", "c_custkey", "rank", place.cast("long").alias("place"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY ts::DATE) - 1 AS day_index FROM events")
def day_index(t: Tables):
    # Days are few: they are ranked among themselves, then joined, so that no task holds all events.
    days = t.events.select(F.to_date("ts").alias("d")).distinct()
    ranked = days.withColumn("day_index", F.dense_rank().over(Window.orderBy("d")).cast("long") - 1)
    return t.events.select("event_id", F.to_date("ts").alias("d")).join(ranked, "d").select("event_id", "day_index")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def count_over(t: Tables):
    return t.events.select("event_id", F.count("*").over(Window.partitionBy("user_id")).alias("n"))


@query("SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def top1_per_key(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_partkey")
    return match.top_per_key(rows, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop("l_partkey")


@query("SELECT o_orderkey, round(100 * cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 6) AS percentile FROM orders")
def percentile_rank(t: Tables):
    x = cume_dist(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", 1000.0, "share")
    return x.select("o_orderkey", F.round(100 * F.col("share"), 6).alias("percentile"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM conversations""")
def fill_forward_context(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("context"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, bool_and(o_totalprice > 60000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS ok FROM orders) WHERE ok""")
def lookahead_until_fail(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.withColumn("ok", F.bool_and(F.col("o_totalprice") > 60000).over(w)).where("ok").select("o_custkey", "o_orderkey")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, o_orderkey, rn::INT AS step FROM o WHERE rn = 1 OR (rn = 2 AND o_orderstatus = 'P')""")
def first_open_phase(t: Tables):
    o = t.orders.where("o_orderstatus <> 'F'").withColumn("step", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return o.where("step = 1 OR (step = 2 AND o_orderstatus = 'P')").select("o_custkey", "o_orderkey", "step")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def claim_next(t: Tables):
    return t.orders.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, 'sending' AS status, 1 AS attempts FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50")
def claim_batch(t: Tables):
    from ..operators.queue import claim

    due = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("attempts"))
    return claim(due, F.col("status") == "P", ["o_orderkey"], 50)


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def latest_runs(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "event_type")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(p_size, 7), 9999), p_type = 'SMALL' DESC, p_name, p_partkey) AS place FROM part""")
def lineup_order(t: Tables):
    place = F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(9999))
    w = Window.partitionBy("p_brand").orderBy(place, F.desc(F.col("p_type") == "SMALL"), "p_name", "p_partkey")
    return t.part.select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT * FROM (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS moment, 'event' AS origin FROM events UNION ALL SELECT o_orderkey, epoch(o_orderdate)::BIGINT, 'order' FROM orders)""")
def merged_timeline(t: Tables):
    e = t.events.select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("moment"), F.lit("event").alias("origin"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("moment"), F.lit("order").alias("origin"))
    return e.unionByName(o).orderBy(F.desc("moment"), "id", "origin")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def set_union_keys(t: Tables):
    return t.customer.select(F.col("c_nationkey").cast("long").alias("k")).union(t.supplier.select("s_suppkey")).distinct()


@query("SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_minus(t: Tables):
    return t.orders.select("o_custkey").subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_overlap(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [p_type, 'red', 'bolt'] AS b FROM part)
SELECT p_partkey, list_has_any(a, b) AS shares, list_has_all(b, a) AS within_b, len(list_intersect(a, b))::INT AS common, len(a || b)::INT AS total FROM w""")
def array_sets(t: Tables):
    w = t.part.select("p_partkey", F.split("p_name", " ").alias("a"), F.array("p_type", F.lit("red"), F.lit("bolt")).alias("b"))
    return w.select("p_partkey", F.arrays_overlap("a", "b").alias("shares"), (F.size(F.array_except("a", "b")) == 0).alias("within_b"), F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.concat("a", "b")).alias("total"))


@query("""SELECT o_custkey, '[' || string_agg('{"k":' || o_orderkey || ',"p":"' || o_orderpriority || '","s":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}', ',' ORDER BY o_orderdate, o_orderkey) || ']' AS orders FROM orders GROUP BY 1""")
def ordered_collect(t: Tables):
    item = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return t.orders.groupBy("o_custkey").agg(to_json(ordered([F.col("o_orderdate"), F.col("o_orderkey")], item)).alias("orders"))
