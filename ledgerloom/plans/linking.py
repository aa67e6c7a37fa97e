"""Queries: entity resolution by tiers, and one-to-one assignment (families C and S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_overlap
from ..operators import match
from ..sources.tables import Tables
from .registry import query

# Pairs in order of a block, taken while both sides are free: state is what was taken so far.
GREEDY_SQL = """p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, l, r) AS rn FROM scored),
g AS (SELECT DISTINCT block, 0::BIGINT AS rn, []::BIGINT[] AS ls, []::BIGINT[] AS rs, false AS took FROM scored
UNION ALL SELECT block, rn, CASE WHEN ok THEN list_append(ls, l) ELSE ls END, CASE WHEN ok THEN list_append(rs, r) ELSE rs END, ok
FROM (SELECT p.*, ls, rs, NOT list_contains(ls, l) AND NOT list_contains(rs, r) AS ok FROM g JOIN p ON p.block = g.block AND p.rn = g.rn + 1)),
taken AS (SELECT p.block, l, r, score FROM g JOIN p USING (block, rn) WHERE took)"""


@query(f"""WITH RECURSIVE scored AS (SELECT c_custkey // 75 AS block, c_custkey AS l, s_suppkey AS r, -abs(c_acctbal - s_acctbal) AS score FROM customer JOIN supplier ON c_custkey // 75 = s_suppkey // 5),
{GREEDY_SQL} SELECT block AS district, l AS c_custkey, r AS s_suppkey, score FROM taken""")
def greedy_pairs(t: Tables):
    """Customers and suppliers of a district paired one to one, the closest balances first."""
    c = t.customer.select(F.floor(F.col("c_custkey") / 75).alias("district"), "c_custkey", "c_acctbal")
    s = t.supplier.select(F.floor(F.col("s_suppkey") / 5).alias("district"), "s_suppkey", "s_acctbal")
    scored = c.join(s, "district").withColumn("score", -F.abs(F.col("c_acctbal") - F.col("s_acctbal")))
    return match.greedy_pairs(scored, "district", "c_custkey", "s_suppkey", "score")


def _similar(a: str, b: str) -> str:
    same = "x = y OR (least(length(x), length(y)) >= 3 AND (starts_with(x, y) OR starts_with(y, x)))"
    return f"len([x FOR x IN {a} IF len([y FOR y IN {b} IF {same}]) > 0]) / greatest(len({a}), len({b}))"


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey AS k, p_partkey // 8 AS block, string_split(p_name, ' ') AS home, [lower(p_type), lower(p_brand)] AS away, p_size AS ext FROM part),
m AS (SELECT k, block, CASE WHEN k % 3 = 0 THEN [home[1], 'united'] ELSE home END AS home, away, CASE WHEN k % 4 = 0 THEN ext END AS ext FROM w),
scored AS (SELECT * FROM (SELECT w.block, w.k AS l, m.k AS r, CASE WHEN w.ext = m.ext THEN 2.0::DOUBLE ELSE {_similar('w.home', 'm.home')} END AS h, {_similar('w.away', 'm.away')} AS a, h + a AS score FROM w JOIN m USING (block)) WHERE h >= 0.5 AND a >= 0.5),
{GREEDY_SQL} SELECT block AS round, l AS fixture, r AS other, round(score, 6) AS score FROM taken""")
def fixture_pairs(t: Tables):
    """Fixtures of two sources within a round: a side scores 2 by a known id, else its similarity; both
    sides from 0.5 on; one to one by the sum. A round holds few fixtures."""
    w = t.part.select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 8).alias("round"), F.split("p_name", " ").alias("home"), F.array(F.lower("p_type"), F.lower("p_brand")).alias("away"), F.col("p_size").alias("ext"))
    home = F.when(F.col("k") % 3 == 0, F.array(F.col("home")[0], F.lit("united"))).otherwise(F.col("home"))
    m = w.select("round", F.col("k").alias("other"), home.alias("home2"), F.col("away").alias("away2"), F.when(F.col("k") % 4 == 0, F.col("ext")).alias("ext2"))
    j = w.withColumnRenamed("k", "fixture").join(m, "round")
    h = F.when(F.col("ext") == F.col("ext2"), F.lit(2.0)).otherwise(token_overlap(F.col("home"), F.col("home2")))
    scored = j.select("round", "fixture", "other", h.alias("h"), token_overlap(F.col("away"), F.col("away2")).alias("a")).where("h >= 0.5 AND a >= 0.5")
    return match.greedy_pairs(scored.withColumn("score", F.col("h") + F.col("a")), "round", "fixture", "other", "score").withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
roster AS MATERIALIZED (SELECT l_orderkey, l_partkey AS id, min(p_name) AS words, replace(min(p_name), ' ', '') AS name, min(l_suppkey) AS ext FROM li GROUP BY 1, 2),
x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos, CASE WHEN l_linenumber % 3 = 0 THEN string_split(p_name, ' ')[2] ELSE p_name END AS words, CASE WHEN l_linenumber = 1 THEN l_suppkey END AS ext, CASE WHEN l_linenumber = 2 THEN l_partkey END AS alias_id FROM li),
rating AS MATERIALIZED (SELECT *, replace(words, ' ', '') AS name FROM x),
names AS (SELECT l_orderkey, name FROM rating GROUP BY 1, 2 HAVING count(*) > 1 UNION SELECT l_orderkey, name FROM roster GROUP BY 1, 2 HAVING count(*) > 1),
ids AS (SELECT l_orderkey, ext FROM rating WHERE ext IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 UNION SELECT l_orderkey, ext FROM roster GROUP BY 1, 2 HAVING count(*) > 1),
good AS (SELECT * FROM roster ANTI JOIN names USING (l_orderkey, name)), named AS (SELECT * FROM rating ANTI JOIN names USING (l_orderkey, name)),
t1 AS (SELECT l_orderkey, pos, id AS by_ext FROM rating JOIN roster USING (l_orderkey, ext) ANTI JOIN ids USING (l_orderkey, ext)),
t2 AS (SELECT rating.l_orderkey, pos, alias_id AS by_alias FROM rating JOIN roster ON roster.l_orderkey = rating.l_orderkey AND id = alias_id),
t3 AS (SELECT l_orderkey, pos, id AS by_name FROM named JOIN good USING (l_orderkey, name)),
t4 AS (SELECT n.l_orderkey, pos, list(id) AS found FROM named n JOIN good g ON g.l_orderkey = n.l_orderkey AND (contains(n.name, g.name) OR contains(g.name, n.name) OR string_split(n.words, ' ')[-1] = string_split(g.words, ' ')[-1] OR list_sort(list_distinct(string_split(n.words, ' '))) = list_sort(list_distinct(string_split(g.words, ' ')))) GROUP BY 1, 2),
c AS MATERIALIZED (SELECT * FROM rating LEFT JOIN t1 USING (l_orderkey, pos) LEFT JOIN t2 USING (l_orderkey, pos) LEFT JOIN t3 USING (l_orderkey, pos) LEFT JOIN t4 USING (l_orderkey, pos)),
g AS (SELECT DISTINCT l_orderkey, 0 AS pos, []::BIGINT[] AS used, NULL::BIGINT AS id, NULL::INT AS tier, 0::INT AS n_candidates FROM rating
UNION ALL SELECT l_orderkey, pos, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit, tier, n FROM (
SELECT *, CASE tier WHEN 1 THEN by_ext WHEN 2 THEN by_alias WHEN 3 THEN by_name WHEN 4 THEN CASE WHEN len(open) = 1 THEN open[1] END END AS hit, CASE WHEN tier < 4 THEN 1 WHEN tier = 4 THEN len(open)::INT ELSE 0 END AS n FROM (
SELECT *, CASE WHEN by_ext IS NOT NULL AND NOT list_contains(used, by_ext) THEN 1 WHEN by_alias IS NOT NULL AND NOT list_contains(used, by_alias) THEN 2 WHEN by_name IS NOT NULL AND NOT list_contains(used, by_name) THEN 3 WHEN len(open) > 0 THEN 4 END::INT AS tier FROM (
SELECT c.*, used, list_filter(found, lambda f: NOT list_contains(used, f)) AS open FROM g JOIN c ON c.l_orderkey = g.l_orderkey AND c.pos = g.pos + 1))))
SELECT l_orderkey, pos, id, tier, n_candidates FROM g WHERE pos > 0""")
def tiered_link(t: Tables):
    """Ratings (part names within an order) to roster rows of the same order, each used once."""
    lines, again = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")) for _ in range(2))
    roster = again.groupBy("l_orderkey", F.col("l_partkey").alias("id")).agg(F.min("p_name").alias("words"), F.min("l_suppkey").alias("ext_id"))
    roster = roster.select("l_orderkey", "id", F.regexp_replace("words", " ", "").alias("name"), "words", "ext_id")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    words = F.when(F.col("l_linenumber") % 3 == 0, F.split("p_name", " ")[1]).otherwise(F.col("p_name"))
    ratings = lines.select("l_orderkey", pos.cast("int").alias("pos"), words.alias("words"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("ext_id"), F.when(F.col("l_linenumber") == 2, F.col("l_partkey")).alias("alias_id"))
    return match.link_in_order(ratings.withColumn("name", F.regexp_replace("words", " ", "")), roster, "l_orderkey")


def squads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The squads of both sources, twenty players each."""
    k, w, z = F.col("p_partkey"), F.split("p_name", " "), F.col("p_size")
    words = F.when(k % 5 == 0, F.array(w[0])).when(k % 5 == 1, w).when(k % 5 == 2, F.array(F.lit("nobody"))).when(k % 5 == 3, F.concat(w, F.array(F.lit("junior")))).otherwise(F.array(w[1]))
    team = F.floor(k / 20).alias("team")
    left = t.part.select("p_partkey", team, words.alias("words"), F.when(z % 7 != 0, z % 30).alias("age"), (k % 20).alias("shirt"))
    right = t.part.select(k.alias("other"), team, w.alias("words"), F.when(z % 11 != 0, (z + (k % 3 == 0).cast("int")) % 30).alias("age"), (k % 17).alias("shirt"))
    return left, right


SQUAD_SQL = """w AS (SELECT p_partkey AS k, p_partkey // 20 AS team, string_split(p_name, ' ') AS w, p_size AS z FROM part),
l AS (SELECT k, team, CASE k % 5 WHEN 0 THEN [w[1]] WHEN 1 THEN w WHEN 2 THEN ['nobody'] WHEN 3 THEN w || ['junior'] ELSE [w[2]] END AS w, CASE WHEN z % 7 <> 0 THEN z % 30 END AS age, k % 20 AS shirt FROM w),
r AS (SELECT k AS other, team, w, CASE WHEN z % 11 <> 0 THEN (z + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) % 30 END AS age, k % 17 AS shirt FROM w),
x AS (SELECT k, count(*) AS n, min(other) AS one, count(*) FILTER (l.age <> 0 AND l.age = r.age) AS m, min(other) FILTER (l.age <> 0 AND l.age = r.age) AS aged FROM l JOIN r ON l.team = r.team AND (list_has_all(l.w, r.w) OR list_has_all(r.w, l.w)) GROUP BY 1),
s AS (SELECT team, shirt, other AS worn, age AS wage FROM r QUALIFY row_number() OVER (PARTITION BY team, shirt ORDER BY other DESC) = 1),
j AS (SELECT k, one, aged, worn, CASE WHEN n = 1 THEN 'name' WHEN n > 1 AND m = 1 THEN 'age' WHEN worn IS NOT NULL AND coalesce(abs(age - wage) <= 1, true) THEN 'shirt' END AS how FROM l LEFT JOIN x USING (k) LEFT JOIN s USING (team, shirt))"""


@query(f"""WITH {SQUAD_SQL}
SELECT k AS p_partkey, CASE how WHEN 'name' THEN one WHEN 'age' THEN aged WHEN 'shirt' THEN worn END AS other, how FROM j""")
def squad_link(t: Tables):
    """Rows of a squad to another source's rows of the same squad: words, then age, then shirt."""
    return match.squad_link(*squads(t), "team", "p_partkey", "other")


@query("""WITH sup AS (SELECT s_suppkey AS id, s_suppkey // 2 AS k, lower(n_name) AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey), cus AS (SELECT c_custkey, c_custkey // 30 AS k, lower(n_name) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey),
names AS (SELECT c_custkey, 0 AS pos, list_sort(CASE WHEN c_custkey % 3 = 0 THEN [nation, 's' || k] WHEN c_custkey % 3 = 1 THEN ['s' || k] ELSE ['s' || k, 'club', nation] END) AS w FROM cus UNION ALL SELECT c_custkey, 1, list_sort(['germany', 's' || k]) FROM cus WHERE c_custkey % 4 = 0),
one AS (SELECT id, list_sort([nation, 's' || k]) AS w FROM sup), two AS (SELECT DISTINCT 1000000 + k AS id, ['s' || k] AS w FROM sup WHERE k % 2 = 0),
e1 AS (SELECT c_custkey, id FROM names JOIN one USING (w) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos, id) = 1), n1 AS (SELECT c_custkey, min(id) AS id FROM names JOIN one ON list_has_all(names.w, one.w) OR list_has_all(one.w, names.w) GROUP BY 1 HAVING count(DISTINCT id) = 1),
e2 AS (SELECT c_custkey, id FROM names JOIN two USING (w) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos, id) = 1), n2 AS (SELECT c_custkey, min(id) AS id FROM names JOIN two ON list_has_all(names.w, two.w) OR list_has_all(two.w, names.w) GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT c_custkey, coalesce(e1.id, n1.id, e2.id, n2.id) AS id, CASE WHEN e1.id IS NOT NULL THEN 'exact' WHEN n1.id IS NOT NULL THEN 'subset' WHEN e2.id IS NOT NULL THEN 'second exact' WHEN n2.id IS NOT NULL THEN 'second subset' END AS how FROM cus LEFT JOIN e1 USING (c_custkey) LEFT JOIN n1 USING (c_custkey) LEFT JOIN e2 USING (c_custkey) LEFT JOIN n2 USING (c_custkey)""")
def team_link(t: Tables):
    """Teams by their names and aliases: an equal word set, the only partner by containment, then the same on a second list."""
    nation = t.nation.select("n_nationkey", F.lower("n_name").alias("nation"))
    sup = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 2).alias("k"), "nation")
    tag = F.concat(F.lit("s"), F.col("k").cast("string"))
    cus = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.floor(F.col("c_custkey") / 30).alias("k"), "nation")
    m = F.col("c_custkey") % 3
    said = F.when(m == 0, F.array("nation", tag)).when(m == 1, F.array(tag)).otherwise(F.array(tag, F.lit("club"), "nation"))
    alias = cus.where("c_custkey % 4 = 0").select("c_custkey", F.lit(1).alias("pos"), F.array_sort(F.array(F.lit("germany"), tag)).alias("words"))
    names = cus.select("c_custkey", F.lit(0).alias("pos"), F.array_sort(said).alias("words")).unionByName(alias)
    one = match.token_link(names, sup.select("id", F.array_sort(F.array("nation", tag)).alias("words")), "c_custkey", "id")
    second = sup.where("k % 2 = 0").select((F.lit(1000000) + F.col("k")).alias("id"), F.array(tag).alias("words")).distinct()
    two = match.token_link(names.join(one, "c_custkey", "left_anti"), second, "c_custkey", "id").withColumn("how", F.concat(F.lit("second "), "how"))
    return cus.select("c_custkey").join(one.unionByName(two), "c_custkey", "left")


@query("""WITH g AS (SELECT l_orderkey, l_suppkey % 2 AS team, l_suppkey AS ext, min((l_linenumber, l_partkey)) AS m FROM lineitem GROUP BY ALL), x AS (SELECT l_orderkey, team, ext, m[1] AS shirt, m[2] AS id, string_split(p_name, ' ') AS w FROM (SELECT l_orderkey, team, ext, [m[1], m[2]] AS m FROM g) JOIN part ON p_partkey = m[2]),
o AS (SELECT l_orderkey, team, ext, CASE id % 4 WHEN 1 THEN shirt + 1 WHEN 3 THEN NULL ELSE shirt END AS shirt, CASE id % 4 WHEN 0 THEN ['legal', 'name'] WHEN 3 THEN [w[1]] ELSE w END AS w FROM x),
k AS (SELECT s_suppkey AS ext, 900000 + s_suppkey AS known FROM supplier WHERE s_suppkey % 5 = 0),
j AS (SELECT o.l_orderkey, o.team, o.ext, x.id, x.shirt = o.shirt AS worn, len([a FOR a IN o.w IF len(a) >= 3 AND len([b FOR b IN x.w IF a = b OR (len(b) >= 3 AND (starts_with(a, b) OR starts_with(b, a)))]) > 0]) > 0 AS alike FROM o JOIN x ON o.l_orderkey = x.l_orderkey AND o.team = x.team),
a AS (SELECT l_orderkey, team, ext, max(id) FILTER (worn) AS hit, count(*) FILTER (alike) AS n, min(id) FILTER (alike) AS one, max(id) FILTER (worn AND alike) AS hit_alike FROM j GROUP BY 1, 2, 3),
h AS (SELECT *, CASE WHEN hit IS NOT NULL AND (hit = hit_alike OR n = 0) THEN 'shirt' WHEN known IS NOT NULL THEN 'known' WHEN n = 1 THEN 'name' END AS how FROM a LEFT JOIN k USING (ext))
SELECT l_orderkey, team, ext, CASE how WHEN 'shirt' THEN hit WHEN 'known' THEN known WHEN 'name' THEN one END AS id, how, coalesce(how IN ('shirt', 'name'), false) AS learned FROM h""")
def official_link(t: Tables):
    """An official list's players to rows of the same match and team: shirt, known id, name."""
    g = t.lineitem.groupBy("l_orderkey", (F.col("l_suppkey") % 2).alias("team"), F.col("l_suppkey").alias("ext")).agg(F.min(F.struct(F.col("l_linenumber").alias("shirt"), F.col("l_partkey").alias("id"))).alias("m"))
    x = g.select("l_orderkey", "team", "ext", "m.*").join(t.part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words")), "id")
    k, w = F.col("id") % 4, F.col("words")
    shirt = F.when(k == 1, F.col("shirt") + 1).when(k != 3, F.col("shirt"))
    words = F.when(k == 0, F.array(F.lit("legal"), F.lit("name"))).when(k == 3, F.array(w[0])).otherwise(w)
    people = x.select("l_orderkey", "team", "ext", shirt.alias("shirt"), words.alias("words"))
    known = t.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("ext"), (F.lit(900000) + F.col("s_suppkey")).alias("id"))
    return match.official_link(people, x, known, ["l_orderkey", "team"])


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey // 40 AS page, o_orderdate::DATE AS d, o_orderstatus = 'P' AS ours, ['t' || o_orderkey % 3] || CASE WHEN o_orderkey % 5 = 0 THEN ['city'] ELSE [] END AS home, ['u' || o_orderkey // 3 % 3] AS away FROM orders),
c AS (SELECT k, page, d, CASE WHEN k % 2 = 1 THEN away ELSE home END AS a, CASE WHEN k % 2 = 1 THEN home ELSE away END AS b FROM o WHERE NOT ours),
s AS (SELECT o.k, c.k AS other, CASE WHEN a = home THEN 2 WHEN list_has_any(a, home) THEN 1 ELSE 0 END AS ah, CASE WHEN b = away THEN 2 WHEN list_has_any(b, away) THEN 1 ELSE 0 END AS ba, CASE WHEN a = away THEN 2 WHEN list_has_any(a, away) THEN 1 ELSE 0 END AS aa, CASE WHEN b = home THEN 2 WHEN list_has_any(b, home) THEN 1 ELSE 0 END AS bh FROM o JOIN c ON o.page = c.page AND abs(date_diff('day', o.d, c.d)) <= 1 WHERE ours)
SELECT k AS o_orderkey, other, score::INT AS score FROM (SELECT k, other, greatest(least(ah, ba), least(aa, bh)) AS score FROM s) WHERE score >= 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, other) = 1""")
def match_discovery(t: Tables):
    """Our matches on a page of fixtures: a day apart at most, the better of both orientations, which
    counts as its weaker side; the first of the best wins."""
    k = F.col("o_orderkey")
    home = F.concat(F.array(F.concat(F.lit("t"), (k % 3).cast("string"))), F.when(k % 5 == 0, F.array(F.lit("city"))).otherwise(F.array().cast("array<string>")))
    o = t.orders.select(k, F.floor(F.col("o_custkey") / 40).alias("page"), F.to_date("o_orderdate").alias("d"), "o_orderstatus", home.alias("home"), F.array(F.concat(F.lit("u"), (F.floor(k / 3) % 3).cast("string"))).alias("away"))
    swap = k % 2 == 1
    a, b = F.when(swap, F.col("away")).otherwise(F.col("home")), F.when(swap, F.col("home")).otherwise(F.col("away"))
    days = F.explode(F.array(*[F.date_add("d", i) for i in (-1, 0, 1)]))
    c = o.where("o_orderstatus <> 'P'").select(k.alias("other"), "page", a.alias("a"), b.alias("b"), days.alias("d"))
    return match.discover(o.where("o_orderstatus = 'P'"), c, ["page", "d"], "o_orderkey", "other")
