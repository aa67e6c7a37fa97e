"""Queries: records out of markup, link write-back, sinks as pure frames (families A, C, D, E, F, P, K-S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layers
from ..functions import parse as R
from ..operators import merge
from ..sources.tables import Tables
from .registry import query


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS m, l_returnflag AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE r WHEN 'R' THEN 'penalty' WHEN 'A' THEN 'own_goal' ELSE 'goal' END AS kind, m AS minute, NULL::INT AS extra FROM x
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'goal', 90, l_linenumber FROM x""")
def minute_tokens(t: Tables):
    """Several minutes behind one icon, with annotations."""
    note = F.when(F.col("l_returnflag") == "R", " (g.p.)").when(F.col("l_returnflag") == "A", " (p.b.)").otherwise("")
    s = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("'"), note, F.lit(" 90+"), F.col("l_linenumber").cast("string"), F.lit("'"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.inline(R.minute_tokens(s)))


@query("""SELECT p_partkey, CASE WHEN p_size > 10 AND p_size % 4 <> 1 THEN NULL WHEN p_size % 4 = 3 THEN NULL ELSE p_name END AS name,
CASE p_size % 4 WHEN 1 THEN 0 WHEN 3 THEN NULL ELSE CASE WHEN p_size <= 10 THEN p_size END END AS score FROM part""")
def rating_layouts(t: Tables):
    n, name = F.col("p_size").cast("string"), F.col("p_name")
    k = F.col("p_size") % 4
    line = F.when(k == 0, F.concat(name, F.lit(" ("), n, F.lit(")"))).when(k == 1, F.concat(name, F.lit(" (-)"))).when(k == 2, F.concat(n, F.lit(" - "), name)).otherwise(F.concat(name, F.lit(": none")))
    return t.part.select("p_partkey", R.rated(line).alias("r")).select("p_partkey", "r.name", "r.score")


@query("""SELECT p_partkey, p_partkey::VARCHAR AS id, p_name AS name, p_size % 5 = 0 AS captain, CASE WHEN p_size < 40 THEN p_size END AS shirt, p_type = 'SMALL' AS inactive FROM part WHERE p_size % 7 <> 0""")
def player_cards(t: Tables):
    """Cards to players; cards without an id are dropped."""
    k = F.col("p_partkey").cast("string")
    ident = F.when(F.col("p_size") % 7 == 0, F.lit("")).when(F.col("p_size") % 2 == 0, F.concat(F.lit(' href="/player/'), k, F.lit('"'))).otherwise(F.concat(F.lit(' data-id="'), k, F.lit('"')))
    card = F.concat(F.when(F.col("p_type") == "SMALL", '<div class="inactive x">').otherwise("<div>"), F.lit("<a"), ident, F.lit(">"), "p_name", F.when(F.col("p_size") % 5 == 0, " (C)").otherwise(""), F.lit("</a><b>"), F.when(F.col("p_size") < 40, F.col("p_size").cast("string")).otherwise("-"), F.lit("</b></div>"))
    return t.part.select("p_partkey", R.player(card).alias("p")).where("p is not null").select("p_partkey", "p.*")


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '') AS head, CASE WHEN page_id % 2 = 0 THEN (page_id % 5)::INT END AS home, CASE WHEN page_id % 2 = 0 THEN (page_id % 3)::INT END AS away FROM pages""")
def page_header(t: Tables):
    said = F.when(F.col("page_id") % 2 == 0, F.concat((F.col("page_id") % 5).cast("string"), F.lit(" - "), (F.col("page_id") % 3).cast("string"))).otherwise("20:30")
    head = F.nullif(F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), F.lit(""))
    return t.pages.select("page_id", head.alias("head"), R.score(said).alias("s")).select("page_id", "head", "s.home", "s.away")


@query("""WITH b AS (SELECT page_id, generate_subscripts(k, 1) AS pos, unnest(k) AS kind, unnest(v) AS body FROM (SELECT page_id, regexp_extract_all(html, '<(h1|h2|p|li)>([^<]*)', 1) AS k, regexp_extract_all(html, '<(h1|h2|p|li)>([^<]*)', 2) AS v FROM pages)),
c AS (SELECT *, last_value(CASE WHEN kind LIKE 'h%' THEN body END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM b)
SELECT page_id, (pos - 1)::INT AS pos, section, length(body)::INT AS chars FROM c WHERE kind NOT LIKE 'h%' AND section IS NOT NULL AND body <> ''""")
def article_sections(t: Tables):
    """Blocks in document order, each under the heading that stands before it."""
    part = lambda i: F.regexp_extract_all("html", F.lit("<(h1|h2|p|li)>([^<]*)"), i)
    b = t.pages.select("page_id", F.posexplode(F.arrays_zip(part(1).alias("kind"), part(2).alias("body"))).alias("pos", "x")).select("page_id", "pos", "x.kind", "x.body")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.startswith("kind", F.lit("h"))
    c = b.withColumn("section", F.last(F.when(head, F.col("body")), ignorenulls=True).over(w))
    return c.where(~head & F.col("section").isNotNull() & (F.col("body") != "")).select("page_id", "pos", "section", F.length("body").alias("chars"))


@query("""WITH n AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h FROM pages) SELECT page_id, 'https://site.example' || x AS url FROM (SELECT page_id, unnest(list_distinct(list_filter(h, lambda u: starts_with(u, '/')))) AS x FROM n)""")
def absolute_links(t: Tables):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1))
    x = t.pages.select("page_id", F.explode(F.filter(found, lambda u: u.startswith("/"))).alias("u"))
    return x.select("page_id", R.absolute(F.col("u"), "https://site.example").alias("url"))


@query("""SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 3 <> 0 THEN p_size END AS age FROM part""")
def labelled_values(t: Tables):
    s = F.concat(F.lit("<span>Brand</span> <b>"), "p_brand", F.lit("</b><span>Age</span> <b>"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).otherwise(" "), F.lit("</b>"))
    return t.part.select("p_partkey", R.labelled(s, "Brand").alias("brand"), R.labelled(s, "Age").try_cast("int").alias("age"))


def _page(df, key, order: str, piece):
    """One text for each key: the pieces of its rows in order. Keys hold 20 rows at most."""
    return df.groupBy(key.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece.alias("x")))), lambda r: r["x"]), "").alias("html"))


@query("""WITH b AS (SELECT p_partkey // 10 AS page, p_partkey AS k, p_name AS name, lower(replace(p_name, ' ', '')) AS key, CASE WHEN p_partkey % 4 < 3 THEN p_size % 11 END AS score FROM part WHERE p_partkey % 6 <> 0)
SELECT page, min_by(name, k) AS name, coalesce(min_by(score, k) FILTER (score IS NOT NULL AND k = f), min_by(score, k) FILTER (score IS NOT NULL))::INT AS score
FROM (SELECT *, min(k) OVER (PARTITION BY page, key) AS f FROM b) GROUP BY page, key""")
def standout_boxes(t: Tables):
    """Standout boxes in four layouts, among lines that are none; equal names fold into one."""
    k, n, name = F.col("p_partkey") % 4, (F.col("p_size") % 11).cast("string"), F.col("p_name")
    box = F.when(k == 0, F.concat(n, F.lit(" | MVP: "), name)).when(k == 1, F.concat(F.lit("MVP: "), name, F.lit(" ("), n, F.lit(")"))).when(k == 2, F.concat(name, F.lit(" - MVP: "), n)).otherwise(F.concat(F.lit("MVP - "), name))
    line = F.concat(F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("What "), name, F.lit(" did"))).otherwise(box), F.lit("\n"))
    x = _page(t.part, F.floor(F.col("p_partkey") / 10), "p_partkey", line)
    return x.select("page", F.inline(R.standouts(F.col("html"))))


@query("""SELECT s_suppkey // 20 AS page, s_suppkey::VARCHAR AS id, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey::VARCHAR || ' M' ELSE '' END AS value FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0""")
def league_teams(t: Tables):
    """Teams from the rows of a table; youth and reserve sides are left out, rows without a link too."""
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.concat("s_name", F.lit(" U19"))).when(k % 7 == 0, F.concat("s_name", F.lit(" B"))).otherwise(F.col("s_name"))
    value = F.when(k % 4 != 0, F.concat(F.col("s_nationkey").cast("string"), F.lit(" M"))).otherwise("")
    row = F.concat(F.lit('<tr class="odd"><td><a href="/team/'), k.cast("string"), F.lit('" title="x">'), name, F.lit("</a></td><td> <b>"), value, F.lit("</b> </td></tr><tr><td>no link</td></tr>"))
    x = _page(t.supplier, F.floor(k / 20), "s_suppkey", row)
    x = x.select("page", F.inline(R.senior(R.table_rows(F.col("html")))))
    return x.select("page", "id", "name", F.get("cells", 1).alias("value"))


@query("""SELECT c_custkey // 20 AS page, c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_acctbal < 0""")
def departures(t: Tables):
    """The rows of one section of a page."""
    k = F.col("c_custkey")
    row = F.concat(F.lit('<tr><td><a href="/player/'), k.cast("string"), F.lit('">'), "c_name", F.lit("</a></td></tr>"))
    c = t.customer.withColumn("gone", (F.col("c_acctbal") < 0).cast("int"))
    x = c.groupBy(F.floor(k / 20).alias("page")).agg(F.array_sort(F.collect_list(F.struct("gone", "c_custkey", row.alias("x")))).alias("r"))
    part = lambda g: F.array_join(F.transform(F.filter("r", lambda r: r["gone"] == g), lambda r: r["x"]), "")
    html = F.concat(F.lit("<h2>Squad</h2><table>"), part(0), F.lit("</table><h2>Departures</h2><table>"), part(1), F.lit("</table><h2>Staff</h2>"))
    return x.select("page", F.inline(R.table_rows(R.section_of(html, "Departures")))).select("page", "id", "name")


@query("""SELECT o_orderkey // 20 AS page, o_orderkey::VARCHAR AS id, 'a-b-' || o_orderkey AS slug, o_orderdate::DATE::VARCHAR AS date, 'T' || o_custkey AS home, o_custkey AS home_id, 'T' || (o_custkey + 1) AS away, o_custkey + 1 AS away_id,
CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END::INT AS home_score, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END::INT AS away_score, CASE WHEN o_orderkey % 3 = 0 THEN '20:30' END AS kickoff, CASE WHEN o_orderkey % 3 <> 0 THEN 'final' ELSE 'scheduled' END AS status FROM orders WHERE o_orderkey % 11 <> 0""")
def round_fixtures(t: Tables):
    """A round's table to fixtures: result or kick-off time, the id from the row or its link, the first row of an id, rows of two teams."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    team = lambda x: F.concat(F.lit('<td><a href="/team/'), s(x), F.lit('">T'), s(x), F.lit("</a></td>"))
    said = F.when(k % 3 != 0, F.concat(F.lit('<td class="result">'), s(k % 5), F.lit(" - "), s(k % 4), F.lit("</td>"))).otherwise('<td class="vs">20:30</td>')
    link = F.concat(F.lit('<a href="/game/a-b-'), s(k), F.lit('">x</a>'))
    row = F.concat(F.when(k % 7 == 0, F.lit("<tr>")).otherwise(F.concat(F.lit('<tr id="game-'), s(k), F.lit('">'))), F.lit("<td>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</td>"), team(c), said, F.when(k % 11 != 0, team(c + 1)).otherwise(""), link, F.lit("</tr>"))
    again = F.when(k % 4 == 0, F.concat(F.lit('<tr id="game-'), s(k), F.lit('">'), team(c), F.lit('<td class="result">9 - 9</td>'), team(c), F.lit("</tr>"))).otherwise("")
    x = _page(t.orders, F.floor(k / 20), "o_orderkey", F.concat(row, F.when(k % 11 != 0, again).otherwise("")))
    return x.select("page", F.inline(R.fixtures(F.col("html")))).withColumn("date", F.col("date").cast("string"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS ext FROM customer), n AS (SELECT c_custkey, c_nationkey, (c_custkey * 7) % 500 AS new FROM customer WHERE c_acctbal > 0),
g AS (SELECT n.*, c.ext, count(*) OVER (PARTITION BY n.c_nationkey, new) AS k FROM n JOIN c USING (c_custkey))
SELECT c_custkey, new AS ext FROM g WHERE ext IS NULL AND k = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.c_nationkey = g.c_nationkey AND c.ext = g.new)""")
def learn_external_ids(t: Tables):
    """A new external id is learned only by a player without one, if no teammate has it and the page names it once."""
    c = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("ext"))
    n = t.customer.where("c_acctbal > 0").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7) % 500).alias("new"))
    once = n.withColumn("k", F.count("*").over(Window.partitionBy("c_nationkey", "new"))).where("k = 1")
    free = once.join(c.where("ext is null").select("c_custkey"), "c_custkey", "left_semi")
    taken = c.where("ext is not null").select("c_nationkey", F.col("ext").alias("new"))
    return free.join(taken, ["c_nationkey", "new"], "left_anti").select("c_custkey", F.col("new").alias("ext"))


@query("""WITH l AS (SELECT l_suppkey AS ext, min(l_partkey) AS id FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS was, CASE WHEN l_linenumber = 1 THEN id ELSE l_partkey END AS now FROM lineitem JOIN l ON ext = l_suppkey""")
def remap_learned(t: Tables):
    """Rows kept without a player get the id that was learned elsewhere."""
    learned = t.lineitem.groupBy("l_suppkey").agg(F.min("l_partkey").alias("id"))
    was = F.when(F.col("l_linenumber") != 1, F.col("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", was.alias("was")).join(learned, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "was", F.coalesce("was", "id").alias("now"))


@query("""SELECT o_custkey, o_orderkey, o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS mvp FROM orders""")
def set_unique_mvp(t: Tables):
    """Setting the standout of a match clears every other."""
    best = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b"))
    return t.orders.select("o_custkey", "o_orderkey").join(best, "o_custkey").select("o_custkey", "o_orderkey", (F.col("o_orderkey") == F.col("b")).alias("mvp"))


@query("""WITH g AS (SELECT l_orderkey, count(*) FILTER (l_suppkey % 2 = 0) AS h, count(*) FILTER (l_suppkey % 2 = 1) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN h >= 4 AND a < 4 THEN 'home' WHEN a >= 4 AND h < 4 THEN 'away' END AS side FROM g""")
def page_side(t: Tables):
    """Which side a page carries: enough entries of exactly one."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_suppkey") % 2 == 0).alias("h"), F.count_if(F.col("l_suppkey") % 2 == 1).alias("a"))
    return g.select("l_orderkey", F.when((F.col("h") >= 4) & (F.col("a") < 4), "home").when((F.col("a") >= 4) & (F.col("h") < 4), "away").alias("side"))


@query("""SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag <> 'R' OR l_orderkey % 3 <> 0) AS shown FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'R' OR l_orderkey % 3 <> 0) > 0""")
def hidden_events(t: Tables):
    """Timeline entries whose kind is overridden aren't shown."""
    from ..operators.documents import ordered

    hidden = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("R"))).otherwise(F.array().cast("array<string>"))
    g = t.lineitem.groupBy("l_orderkey").agg(ordered([F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("k"))).alias("e"))
    kept = F.filter("e", lambda x: ~F.array_contains(hidden, x["k"]))
    return g.select("l_orderkey", kept.alias("e")).where(F.size("e") > 0).select("l_orderkey", F.array_join(F.transform("e", lambda x: x["n"].cast("string")), ",").alias("shown"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN coalesce(n, 0) WHEN c_acctbal > 0 AND n IS NULL THEN 0 END AS assists FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def tri_state_assists(t: Tables):
    n = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    j = t.customer.join(n, "c_custkey", "left")
    return j.select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.coalesce("n", F.lit(0))).when((F.col("c_acctbal") > 0) & F.col("n").isNull(), F.lit(0)).alias("assists"))


@query("""SELECT o_orderkey, list_position(list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o_orderkey)::INT - 1 AS order_index FROM orders""")
def position_index(t: Tables):
    arr = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    g = t.orders.groupBy("o_custkey").agg(arr.alias("a"))
    return g.select(F.posexplode("a").alias("order_index", "x")).select(F.col("x.o_orderkey").alias("o_orderkey"), "order_index")


@query("""SELECT p_partkey, p_size % 3 <> 2 AS ok FROM part""")
def range_syntax(t: Tables):
    s = F.when(F.col("p_size") % 3 == 0, "4-5.5, 5.5-6").when(F.col("p_size") % 3 == 1, "10-20").otherwise("4 to 5")
    return t.part.select("p_partkey", R.valid_ranges(s).alias("ok"))


@query("""SELECT o_orderkey, sha256(from_hex(repeat('5c', 64))::BLOB || from_hex(sha256(from_hex(repeat('36', 64))::BLOB || encode(o_orderkey || ':' || o_orderstatus)))) AS unsigned_key FROM orders""")
def signed_deliveries(t: Tables):
    """HMAC-SHA256 of the payload (here with an empty secret)."""
    payload = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderstatus")
    return t.orders.select("o_orderkey", R.hmac_sha256(b"", payload).alias("unsigned_key"))


@query("""WITH u AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS status FROM orders),
c AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ANTI JOIN u ON l_orderkey = u.o_orderkey UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem SEMI JOIN u ON l_orderkey = u.o_orderkey WHERE l_linenumber <= 2),
k AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::DOUBLE AS q FROM c GROUP BY 1) SELECT o_orderkey, status, coalesce(n, 0) AS n, q FROM p LEFT JOIN k ON l_orderkey = o_orderkey""")
def replica_apply(t: Tables):
    """A received document: the parent is merged, its children are replaced."""
    base = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    parent = merge.merge(base, urgent.withColumn("status", F.lit("F")), ["o_orderkey"])
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    touched = lines.join(urgent, "o_orderkey", "left_semi")
    fresh = touched.where("l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1)
    # Parents whose new list is empty lose their children too.
    children = lines.join(touched.select("o_orderkey").distinct(), "o_orderkey", "left_anti").unionByName(fresh)
    k = children.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return parent.join(k, "o_orderkey", "left").select("o_orderkey", "status", F.coalesce("n", F.lit(0)).alias("n"), "q")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE coalesce(nullif(o_custkey % 9, 0), o_custkey) END AS seed FROM orders""")
def seed_header(t: Tables):
    """Fields of a page header, where it has none those of the seed that led to it."""
    head = F.when(F.col("o_orderkey") % 4 != 0, F.nullif(F.col("o_custkey") % 9, F.lit(0)))
    return t.orders.select("o_orderkey", F.coalesce(head, "o_custkey").alias("seed"))


@query("""SELECT p_partkey, p_size - least(coalesce(nullif(p_size % 4, 3), 0), p_size) AS goals, least(coalesce(nullif(p_size % 4, 3), 0), p_size) AS penalties FROM part""")
def goal_split(t: Tables):
    goals, pens = layers.split_goals(F.col("p_size"), F.nullif(F.col("p_size") % 4, F.lit(3)))
    return t.part.select("p_partkey", goals.alias("goals"), pens.alias("penalties"))


@query("""WITH f AS (SELECT l_orderkey AS round, l_suppkey AS a, l_partkey AS b, max((l_quantity / 50)::DOUBLE) AS s FROM lineitem WHERE l_quantity >= 25 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY s DESC, a, b) AS rn FROM f) SELECT round, a, b FROM r WHERE rn = 1""")
def best_fixture(t: Tables):
    """The best-scored pair of each round: where a greedy pairing starts."""
    f = t.lineitem.where("l_quantity >= 25").groupBy(F.col("l_orderkey").alias("round"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max(F.col("l_quantity") / 50).alias("s"))
    return f.groupBy("round").agg(F.max_by(F.struct("a", "b"), F.struct("s", -F.col("a"), -F.col("b"))).alias("m")).select("round", "m.*")


@query("""SELECT page_id, i::INT AS section, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS side, i < 2 AS starter, length(s[i + 2])::INT AS chars
FROM (SELECT page_id, s, unnest(range(0, least(len(s) - 1, 4))) AS i FROM (SELECT page_id, string_split(html, '<li>') AS s FROM pages))""")
def lineup_sections(t: Tables):
    """The first four sections of a page are starters and bench of both sides."""
    from ..sources.pages import sections

    x = sections(t.pages, "<li>", 4).withColumn("r", R.lineup_role(F.col("section")))
    return x.select("page_id", "section", "r.side", "r.starter", F.length("body").alias("chars"))


@query("""SELECT p_partkey // 20 AS page, p_partkey::VARCHAR AS id, p_name AS name, (['Goalkeepers', 'Defenders', 'Midfielders', 'Forwards'])[p_size % 5 + 1] AS section, CASE WHEN p_size < 40 THEN p_size END::INT AS shirt, p_partkey % 9 = 0 AS departed FROM part WHERE p_size % 5 < 4""")
def squad_page(t: Tables):
    """Players of a squad page: four sections count, the id comes from the link or the photo, the first card of an id wins, some have left."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size")
    ident = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<img src="/photos/x/'), k, F.lit('.png">'))).otherwise(F.concat(F.lit('<a href="/player/'), k, F.lit('">')))
    card = F.concat(F.lit('<div class="card player'), F.when(F.col("p_partkey") % 9 == 0, " departed").otherwise(""), F.lit(' x">'), ident, F.lit("<b>"), "p_name", F.lit("</b><i>"), F.when(z < 40, z.cast("string")).otherwise("-"), F.lit("</i></div>"))
    again = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit('<div class="player"><a href="/player/'), k, F.lit('"><b>again</b></div>'))).otherwise("")
    x = t.part.groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", (z % 5).alias("s"), card.alias("x"), again.alias("y")))).alias("r"))
    part = lambda i, title, y: F.concat(F.lit(f"<h2>{title}</h2>"), F.array_join(F.transform(F.filter("r", lambda r: r["s"] == i), lambda r: r[y]), ""))
    html = F.concat(*[part(i, title, "x") for i, title in enumerate((*R.SQUAD, "Staff"))], F.lit("<h2>Forwards</h2>"), *[F.array_join(F.transform(F.filter("r", lambda r: r["s"] == i), lambda r: r["y"]), "") for i in range(4)])
    return x.select("page", F.inline(R.squad(html)))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), x AS (SELECT p_partkey, w || CASE WHEN list_has_any(w, ['red', 'rouge']) THEN ['red', 'rouge'] ELSE [] END || CASE WHEN list_has_any(w, ['bolt', 'screw']) THEN ['bolt', 'screw'] ELSE [] END AS w FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(w)), ' ') AS words FROM x""")
def alias_tokens(t: Tables):
    from ..functions.text import with_aliases

    return t.part.select("p_partkey", F.array_join(with_aliases(F.split("p_name", " "), [["red", "rouge"], ["bolt", "screw"]]), " ").alias("words"))


@query("""WITH p AS (SELECT l_orderkey, min(l_shipdate) AS shipped, bool_or(l_suppkey % 2 = 0) AND bool_or(l_suppkey % 2 = 1) AS both_sides FROM lineitem GROUP BY 1)
SELECT o_custkey, min_by(l_orderkey, (shipped, l_orderkey)) AS page FROM orders JOIN p ON l_orderkey = o_orderkey WHERE both_sides AND shipped >= o_orderdate AND shipped <= o_orderdate + INTERVAL 90 DAY GROUP BY 1""")
def page_assignment(t: Tables):
    """The earliest page in the window whose teams cover both sides."""
    side = F.col("l_suppkey") % 2
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("at"), (F.bool_or(side == 0) & F.bool_or(side == 1)).alias("both_sides")).where("both_sides")
    j = t.orders.join(p, "o_orderkey").where((F.col("at") >= F.col("o_orderdate")) & (F.col("at") <= F.col("o_orderdate") + F.make_interval(days=F.lit(90))))
    return j.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("at", "o_orderkey")).alias("page"))


@query("""SELECT user_id::VARCHAR AS dedupe_key, min(event_id) AS first_final FROM events WHERE event_type = 'purchase' AND user_id::VARCHAR NOT IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'error' AND value > 60) GROUP BY 1""")
def final_followups(t: Tables):
    """What turned final gets one follow-up job, unless one with its key is pending."""
    key = F.col("user_id").cast("string").alias("dedupe_key")
    done = t.events.where("event_type = 'purchase'").groupBy(key).agg(F.min("event_id").alias("first_final"))
    return done.join(t.events.where("event_type = 'error' AND value > 60").select(key), "dedupe_key", "left_anti")
