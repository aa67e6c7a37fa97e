"""Queries: whole runs, composed of the operators (family O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layers import bucket
from ..operators import match, queue
from ..sources.tables import Tables
from .linking import SQUAD_SQL, squads
from .registry import query

# Scores of quantity ranges.
SCORES = [(1.0, 11.0, 4), (11.0, 21.0, 5), (21.0, 41.0, 6), (41.0, 46.0, 7)]

RATINGS_SQL = """line AS (SELECT l_orderkey AS game, l_suppkey % 2 AS team, l_partkey AS player, l_linenumber AS n, l_quantity AS raw FROM lineitem),
combined AS (SELECT game, team, player, raw FROM line WHERE n <= 3 AND game % 3 <> 0), own AS (SELECT game, team, player, raw FROM line WHERE n >= 3),
every AS (SELECT *, 'combined' AS page FROM combined UNION ALL SELECT *, 'own' FROM own ANTI JOIN (SELECT DISTINCT game, team FROM combined) USING (game, team)),
ratings AS (SELECT game, team, player, max(raw) AS raw, min(page) AS page FROM every GROUP BY 1, 2, 3)"""


def ratings(t: Tables) -> DataFrame:
    """The ratings of each game: two team pages for the large clubs; else one page for both sides, and
    for a side that it lacks the side's own page. A player's highest rating counts."""
    line = t.lineitem.select(F.col("l_orderkey").alias("game"), (F.col("l_suppkey") % 2).alias("team"), F.col("l_partkey").alias("player"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("raw"))
    # One pass: whether a side stands on the shared page is an aggregate of its own rows.
    shared = (F.col("n") <= 3) & (F.col("game") % 3 != 0)
    g = line.groupBy("game", "team", "player").agg(F.max(F.when(shared, F.col("raw"))).alias("c"), F.max(F.when(F.col("n") >= 3, F.col("raw"))).alias("o"))
    has = F.max(F.col("c").isNotNull()).over(Window.partitionBy("game", "team"))
    page = F.when(has, "combined").otherwise("own")
    x = g.withColumn("page", page).withColumn("raw", F.when(F.col("page") == "combined", F.col("c")).otherwise(F.col("o")))
    return x.where("raw is not null").select("game", "team", "player", "raw", "page")


@query(f"WITH {RATINGS_SQL} SELECT * FROM ratings")
def match_ratings(t: Tables):
    return ratings(t)


@query(f"""WITH {RATINGS_SQL}, s AS (SELECT game, raw, CASE WHEN raw < 11 THEN 4 WHEN raw < 21 THEN 5 WHEN raw < 41 THEN 6 WHEN raw <= 46 THEN 7 END AS score FROM ratings SEMI JOIN (SELECT o_orderkey AS game FROM orders WHERE o_orderstatus = 'F') USING (game))
SELECT game, count(*) AS rated, count(score) AS mapped, sum(score)::BIGINT AS total, max(raw) AS best FROM s GROUP BY 1""")
def rating_sync(t: Tables):
    """One run over all finished games: assembled, mapped to scores, counted; raw values beyond the ranges have no score."""
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("game"))
    s = ratings(t).join(done, "game", "left_semi").withColumn("score", bucket(F.col("raw"), SCORES))
    return s.groupBy("game").agg(F.count("*").alias("rated"), F.count("score").alias("mapped"), F.sum("score").alias("total"), F.max("raw").alias("best"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_quantity END, l_linenumber::DOUBLE) AS raw FROM lineitem")
def raw_scores(t: Tables):
    """A source without raw values: its final score stands for them."""
    raw = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(raw, F.col("l_linenumber").cast("double")).alias("raw"))


ENRICH_SQL = f"""{SQUAD_SQL}, teams AS (SELECT DISTINCT team, CASE WHEN team % 3 = 0 THEN 500000 + team END AS stored, CASE WHEN team % 4 <> 1 THEN 500000 + team END AS named FROM w)"""
COUNTS_SQL = """SELECT team, coalesce(stored, named) AS ext, stored IS NULL AND named IS NOT NULL AS learned, count(*) AS players, count(*) FILTER (how = 'name') AS by_name, count(*) FILTER (how = 'age') AS by_age, count(*) FILTER (how = 'shirt') AS by_shirt
FROM teams JOIN l USING (team) LEFT JOIN j USING (k)"""


def _enriched(t: Tables, chosen: str) -> DataFrame:
    """Teams with chosen members: resolved by the stored id, else by name; members linked within them; counts."""
    left, right = squads(t)
    left = left.where(chosen)
    tag = F.concat(F.lit("t"), F.col("team").cast("string"))
    teams = left.select("team").distinct()
    listed = right.select("team").distinct().where("team % 4 <> 1").select((F.col("team") + 500000).alias("ext"), F.array(tag).alias("words"))
    names = teams.select("team", F.lit(0).alias("pos"), F.array(tag, F.lit("united")).alias("words"))
    found = match.token_link(names.where("team % 3 <> 0"), listed, "team", "ext").drop("how").withColumnRenamed("ext", "named")
    teams = teams.join(found.hint("merge"), "team", "left").withColumn("stored", F.when(F.col("team") % 3 == 0, F.col("team") + 500000))
    teams = teams.select("team", F.coalesce("stored", "named").alias("ext"), (F.col("stored").isNull() & F.col("named").isNotNull()).alias("learned"))
    links = match.squad_link(left.join(teams.where("ext is not null").select("team", "ext").hint("merge"), "team"), right.withColumn("ext", F.col("team") + 500000).drop("team"), "ext", "p_partkey", "other")
    x = left.select("team", "p_partkey").join(links.hint("merge"), "p_partkey", "left")
    g = x.groupBy("team").agg(F.count("*").alias("players"), *[F.count_if(F.col("how") == h).alias(f"by_{h}") for h in ("name", "age", "shirt")])
    return teams.join(g.hint("merge"), "team")


@query(f"WITH {ENRICH_SQL} {COUNTS_SQL.replace('(how', '(coalesce(stored, named) IS NOT NULL AND how')} GROUP BY 1, 2, 3")
def squad_enrichment(t: Tables):
    """Every squad enriched from the other source; ids of teams found by name are learned."""
    return _enriched(t, "true")


@query(f"WITH {ENRICH_SQL} {COUNTS_SQL.replace('(how', '(coalesce(stored, named) IS NOT NULL AND how')} WHERE k % 9 = 0 AND team % 2 = 0 GROUP BY 1, 2, 3")
def departures_enrichment(t: Tables):
    """The same for members that left, and only for teams that have some."""
    return _enriched(t, "p_partkey % 9 = 0 AND team % 2 = 0")


@query("""SELECT o_orderkey, coalesce(nullif('C' || o_custkey % 4, 'C0'), CASE o_orderpriority WHEN '1-URGENT' THEN 'PO1' WHEN '2-HIGH' THEN 'ES1' END) AS code, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 2020 END, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END)::INT AS season FROM orders""")
def config_resolution(t: Tables):
    """A stored code wins over the seed map, a stored season over the one that the date gives."""
    stored = F.nullif(F.concat(F.lit("C"), (F.col("o_custkey") % 4).cast("string")), F.lit("C0"))
    seed = F.when(F.col("o_orderpriority") == "1-URGENT", "PO1").when(F.col("o_orderpriority") == "2-HIGH", "ES1")
    derived = F.year("o_orderdate") - (F.month("o_orderdate") < 7).cast("int")
    return t.orders.select("o_orderkey", F.coalesce(stored, seed).alias("code"), F.coalesce(F.when(F.col("o_custkey") % 3 == 0, F.lit(2020)), derived).alias("season"))


@query("""WITH w AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'ratings:' WHEN 'P' THEN 'watch:' ELSE 'gap:' END || o_orderkey AS dedupe_key FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'N') n ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' OR l_orderkey IS NOT NULL),
j AS (SELECT 'watch:' || o_orderkey AS dedupe_key FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT 'ratings:' || o_orderkey FROM orders WHERE o_orderkey % 7 = 1) SELECT dedupe_key FROM w ANTI JOIN j USING (dedupe_key)""")
def chained_followups(t: Tables):
    """What a run asks for next: ratings after a final game that lacks some, the watcher for a live one, else its gaps; once while a job with the key lives."""
    key = lambda kind: F.concat(F.lit(kind + ":"), F.col("o_orderkey").cast("string"))
    open_ = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    final = t.orders.where("o_orderstatus = 'F'").join(open_, "o_orderkey", "left_semi").select(key("ratings").alias("dedupe_key"))
    other = t.orders.where("o_orderstatus <> 'F'").select(F.when(F.col("o_orderstatus") == "P", key("watch")).otherwise(key("gap")).alias("dedupe_key"))
    jobs = t.orders.where("o_orderkey % 7 < 2").select(F.when(F.col("o_orderkey") % 7 == 0, key("watch")).otherwise(key("ratings")).alias("dedupe_key"), F.lit("pending").alias("status"), F.col("o_orderkey").alias("id"))
    return queue.enqueue(jobs, final.unionByName(other)).where("existing_id is null").select("dedupe_key")


@query("""WITH b AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"code":' || o_custkey || ',"message":"refused"}' WHEN 1 THEN '{"code":7}' WHEN 2 THEN '{"data":[{"id":' || o_custkey || '}]}' ELSE '<html>' END AS body FROM orders)
SELECT o_orderkey, json_valid(body) AND (json_extract_string(body, '$.code') IS NULL OR json_extract_string(body, '$.message') IS NULL) AS ok, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.message') END AS message FROM (SELECT o_orderkey, body FROM b WHERE o_orderkey % 4 <> 3) UNION ALL SELECT o_orderkey, false, NULL FROM b WHERE o_orderkey % 4 = 3""")
def api_errors(t: Tables):
    """Bodies of an interface that reports its errors in them: a code with a message, or no JSON at all."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"code":'), c, F.lit(',"message":"refused"}'))).when(k == 1, F.lit('{"code":7}')).when(k == 2, F.concat(F.lit('{"data":[{"id":'), c, F.lit("}]}"))).otherwise(F.lit("<html>"))
    b = t.orders.select("o_orderkey", body.alias("body"))
    field = lambda x: F.get_json_object("body", "$." + x)
    ok = F.get_json_object("body", "$").isNotNull() & (field("code").isNull() | field("message").isNull())
    return b.select("o_orderkey", ok.alias("ok"), field("message").alias("message"))


@query("""WITH a AS (SELECT user_id, ts, timestamp '2024-01-01' + INTERVAL (user_id % 20) DAY AS played, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) // 20 AS page FROM events),
p AS (SELECT user_id, page, played, min(ts) AS oldest, count(*) FILTER (ts >= played AND ts <= played + INTERVAL 2 DAY) AS found FROM a GROUP BY 1, 2, 3)
SELECT user_id, least(count(*) FILTER (oldest >= played) + 1, count(*)) AS pages, sum(found)::BIGINT AS found FROM p GROUP BY 1""")
def article_feed(t: Tables):
    """A feed walked from its newest page until a page reaches back before the game; articles of two days count."""
    played = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("user_id") % 20).cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    a = t.events.select("user_id", "ts", played.alias("played"), F.floor(place / 20).alias("page"))
    inside = F.col("ts").between(F.col("played"), F.col("played") + F.make_interval(days=F.lit(2)))
    p = a.groupBy("user_id", "page", "played").agg(F.min("ts").alias("oldest"), F.count_if(inside).alias("found"))
    return p.groupBy("user_id").agg(F.least(F.count_if(F.col("oldest") >= F.col("played")) + 1, F.count("*")).alias("pages"), F.sum("found").alias("found"))
