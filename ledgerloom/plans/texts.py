"""Queries: text, time and extraction (families A, B, N, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers
from ..functions import text as X
from ..sources import pages as P
from ..sources.tables import Tables
from .registry import query

NORM = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]', '', 'g')"
TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(lower(strip_accents({0})), '[^a-z0-9]+'), lambda w: w <> '')))"


@query(f"SELECT doc_id, {NORM.format('text')} AS key FROM documents")
def norm_key(t: Tables):
    return t.documents.select("doc_id", X.norm_key(F.col("text")).alias("key"))


@query("SELECT page_id, trim(regexp_replace(lower(strip_accents(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugify(t: Tables):
    return t.pages.select("page_id", X.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(160), ' '), '[ \\t\\r\\n]+', ' ', 'g')) AS name FROM pages""")
def clean_name(t: Tables):
    return t.pages.select("page_id", X.clean_name(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("name"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def strip_tags(t: Tables):
    return t.pages.select("page_id", X.strip_tags(F.col("html")).alias("body"))


@query(f"""WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '') AS e FROM part),
k AS (SELECT *, list_filter(e, lambda w: length(w) >= 4 AND w <> 'blue') AS f FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN len(f) = 0 THEN e ELSE f END)), ' ') AS words FROM k""")
def token_sets(t: Tables):
    return t.part.select("p_partkey", F.array_join(X.tokens(F.col("p_name"), 4, ("blue",)), " ").alias("words"))


PAIRS_SQL = """WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS an, b.p_name || CASE WHEN b.p_partkey % 3 = 0 THEN 's' ELSE '' END AS bn FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size % 5 + 1)"""


def _pairs(t: Tables):
    a = t.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("an"), (F.col("p_partkey") + F.col("p_size") % 5 + 1).alias("b"))
    bn = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "s").otherwise(""))
    return a.join(t.part.select(F.col("p_partkey").alias("b"), bn.alias("bn")), "b")


@query(f"""{PAIRS_SQL}, w AS (SELECT a, b, string_split(an, ' ') AS x, string_split(bn, ' ') AS y FROM p)
SELECT a, b, len(list_filter(x, lambda u: len(list_filter(y, lambda v: u = v OR (length(u) >= 3 AND length(v) >= 3 AND (starts_with(u, v) OR starts_with(v, u))))) > 0))::DOUBLE / greatest(len(x), len(y)) AS share FROM w""")
def token_overlap(t: Tables):
    return _pairs(t).select("a", "b", X.token_overlap(F.split("an", " "), F.split("bn", " ")).alias("share"))


@query("SELECT p_partkey, list_extract(string_split(lower(p_name), ' '), -1) AS last, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') AS words FROM part")
def last_word_set(t: Tables):
    return t.part.select("p_partkey", X.last_word(F.col("p_name")).alias("last"), F.array_join(X.tokens(F.col("p_name")), " ").alias("words"))


@query(f"""{PAIRS_SQL}, k AS (SELECT a, b, replace(an, ' ', '') AS x, replace(bn, ' ', '') AS y FROM p)
SELECT a, b, levenshtein(x, y) <= 1 AS edit1, contains(x, y) OR contains(y, x) AS inside,
  x = y OR (least(length(x), length(y)) >= 4 AND (contains(x, y) OR contains(y, x))) OR (greatest(length(x), length(y)) >= 8 AND levenshtein(x, y) <= 1) AS same FROM k""")
def names_match(t: Tables):
    k = _pairs(t).select("a", "b", X.norm_key(F.col("an")).alias("x"), X.norm_key(F.col("bn")).alias("y"))
    x, y = F.col("x"), F.col("y")
    return k.select("a", "b", X.edit_within_one(x, y).alias("edit1"), X.contains_either(x, y).alias("inside"), X.names_match(x, y).alias("same"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN l_quantity::INT || '+' || l_linenumber WHEN 2 THEN 'late' ELSE (l_quantity::INT)::VARCHAR END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(regexp_extract(s, '^([0-9]{1,3})', 1) AS INT) AS minute, TRY_CAST(regexp_extract(s, '\\+([0-9]{1,2})', 1) AS INT) AS extra, CASE WHEN l_linenumber <> 2 THEN s END AS label FROM m""")
def minute_parse(t: Tables):
    q = F.col("l_quantity").cast("int").cast("string")
    s = F.when(F.col("l_linenumber") == 1, F.concat(q, F.lit("+"), F.col("l_linenumber").cast("string"))).when(F.col("l_linenumber") == 2, "late").otherwise(q)
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.minute(s).alias("m"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "m.minute", "m.extra", X.minute_label(F.col("m.minute"), F.col("m.extra")).alias("label"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE p_size END AS rating FROM part""")
def rating_parse(t: Tables):
    s = F.when(F.col("p_size") % 4 == 0, "(-)").when(F.col("p_size") % 4 == 1, " ").otherwise(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")))
    return t.part.select("p_partkey", X.rating(s).alias("rating"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size END AS thousands FROM part""")
def unit_parse(t: Tables):
    n = F.col("p_size").cast("string")
    s = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit(",50 M €"))).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" mil €"))).otherwise("-")
    return t.part.select("p_partkey", X.amount_in_thousands(s).alias("thousands"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' WHEN 'purchase' THEN 'P' END AS code, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' WHEN 'purchase' THEN 'P' ELSE event_type END AS export FROM events""")
def code_map(t: Tables):
    table = {"click": "C", "view": "V", "purchase": "P"}
    kind = F.col("event_type")
    return t.events.select("event_id", X.code(kind, table).alias("code"), X.code(kind, table, kind).alias("export"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(p_name), '\\b(red|bolt)\\b')")
def variant_exclude(t: Tables):
    return t.part.where(~F.lower("p_name").rlike(r"\b(red|bolt)\b")).select("p_partkey", "p_name")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_replace(url, '[?#].*$', '') AS bare FROM pages""")
def url_parts(t: Tables):
    return t.pages.select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long").alias("id"),
        F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"),
        F.regexp_replace("url", "[?#].*$", "").alias("bare"),
    )


@query("SELECT doc_id, left(text, 2000) AS head FROM documents")
def truncate(t: Tables):
    return t.documents.select("doc_id", F.left("text", F.lit(2000)).alias("head"))


@query("SELECT o_orderkey, epoch(timezone('Europe/Lisbon', o_orderdate + INTERVAL 20 HOUR))::BIGINT AS instant FROM orders")
def local_instant(t: Tables):
    d = F.col("o_orderdate")
    at = X.local_instant(F.year(d), F.month(d), F.day(d), F.lit(20), F.lit(0), "Europe/Lisbon")
    return t.orders.select("o_orderkey", F.unix_timestamp(at).alias("instant"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN epoch(o_orderdate)::BIGINT END AS instant FROM orders""")
def iso_parse(t: Tables):
    s = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.orders.select("o_orderkey", F.unix_timestamp(F.try_to_timestamp(s)).alias("instant"))


@query("SELECT event_id, floor((1706745600 - epoch(ts)) / 60)::BIGINT AS minutes FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def elapsed(t: Tables):
    as_of = F.lit("2024-02-01").cast("timestamp")
    return t.events.select("event_id", F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("ts")) / 60).cast("long").alias("minutes"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS season FROM orders")
def season_year(t: Tables):
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", X.season_start(F.concat(y.cast("string"), F.lit("/"), F.right(((y + 1) % 100).cast("string"), F.lit(2)))).alias("season"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(5 * (2 ** greatest(l_linenumber - 1, 0)), 300)::INT AS seconds FROM lineitem")
def backoff(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.backoff(F.col("l_linenumber")).alias("seconds"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS b, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS kept FROM part""")
def map_layers(t: Tables):
    base = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    merged = F.when(F.col("p_size") % 2 == 0, layers.put(base, F.lit("a"), F.lit(2))).otherwise(base)
    m = t.part.select("p_partkey", merged.alias("m"))
    return m.select("p_partkey", layers.overlaid(F.col("m"), "a", F.lit(0)).alias("a"), layers.overlaid(F.col("m"), "b", F.lit(-1)).alias("b"), F.size(layers.present(F.col("m"))).alias("kept"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
def page_title(t: Tables):
    return t.pages.select("page_id", P.title(F.col("html")).alias("title"), P.attribute(F.col("html"), "lang").alias("lang"))


@query("""WITH l AS (SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(n) AS label FROM (SELECT page_id,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS n FROM pages))
SELECT page_id, min(pos)::INT AS pos, href, min_by(label, pos) AS label FROM l GROUP BY page_id, href""")
def page_links(t: Tables):
    return P.links(t.pages)


@query("""SELECT page_id, (i - 1)::INT AS section, s[i + 1] AS body FROM (SELECT page_id, s, unnest(range(1, least(len(s), 5))) AS i FROM (SELECT page_id, string_split(html, '<p>') AS s FROM pages))""")
def html_sections(t: Tables):
    return P.sections(t.pages, "<p>", 4)


@query("""WITH r AS (SELECT page_id, i AS pos, s[i + 1] AS row FROM (SELECT page_id, s, unnest(range(1, len(s))) AS i FROM (SELECT page_id, string_split(html, '<li>') AS s FROM pages))),
x AS (SELECT page_id, pos, regexp_extract(row, 'href="/([^"]*)"', 1) AS id, regexp_extract(row, '>([^<]+)</a>', 1) AS name FROM r)
SELECT page_id, id, min_by(name, pos) AS name FROM x WHERE id <> '' AND name <> '' GROUP BY 1, 2""")
def fixture_rows(t: Tables):
    """Rows of a list; the first row of an id wins, rows without a name are dropped."""
    rows = t.pages.select("page_id", F.posexplode(F.split("html", "<li>")).alias("pos", "row")).where("pos > 0")
    x = rows.select("page_id", "pos", F.regexp_extract("row", 'href="/([^"]*)"', 1).alias("id"), F.regexp_extract("row", ">([^<]+)</a>", 1).alias("name")).where("id <> '' AND name <> ''")
    return x.groupBy("page_id", "id").agg(F.min_by("name", "pos").alias("name"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k, (event_id % 2 = 0)::INT AS variant FROM events")
def json_field(t: Tables):
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k"), (F.col("event_id") % 2 == 0).cast("int").alias("variant"))


@query("""SELECT event_id, u.round AS round, u.k AS k FROM (SELECT event_id, unnest([{'round': 0, 'k': json_extract(props, '$.k')::INT}, {'round': 1, 'k': user_id::INT}]) AS u FROM events)""")
def embedded_json(t: Tables):
    """JSON inside a script tag, its list of lists flattened."""
    html = F.concat(F.lit('<html><script id="DATA" type="x">{"rounds": [[{"k": '), F.get_json_object("props", "$.k"), F.lit('}], [{"k": '), F.col("user_id").cast("string"), F.lit("}]]}</script></html>"))
    data = P.embedded_json(html, "DATA", "rounds array<array<struct<k:int>>>")
    rows = t.events.select("event_id", F.posexplode(data["rounds"]).alias("round", "items"))
    return rows.select("event_id", "round", F.inline("items"))


@query("""SELECT page_id, a[i] AS word, b[i]::INT AS n FROM (SELECT page_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '([a-z]+)\\(([0-9]+)\\)', 1) AS a, regexp_extract_all(html, '([a-z]+)\\(([0-9]+)\\)', 2) AS b FROM pages))""")
def inline_ratings(t: Tables):
    """'name(6)' lists: two groups, zipped."""
    group = lambda i: F.regexp_extract_all("html", F.lit(r"([a-z]+)\(([0-9]+)\)"), i)
    return t.pages.select("page_id", F.inline(F.arrays_zip(group(1).alias("word"), group(2).alias("n")))).withColumn("n", F.col("n").cast("int"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'goal' WHEN event_type = 'error' THEN 'card' WHEN event_type IN ('click', 'view') THEN 'touch' ELSE 'unknown' END AS kind FROM events""")
def event_classifier(t: Tables):
    e = F.col("event_type")
    kind = F.when((e == "purchase") & (F.col("value") > 50), "big").when(e == "purchase", "goal").when(e == "error", "card").when(e.isin("click", "view"), "touch").otherwise("unknown")
    return t.events.select("event_id", kind.alias("kind"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS goals, least(count(*) FILTER (event_type = 'error'), 2)::INT AS cards, count(*) FILTER (event_type = 'error') >= 2 AS red,
max(event_id) FILTER (event_type = 'click') AS last_sub, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type NOT IN ('purchase', 'error', 'click')) AS unknown FROM events GROUP BY 1""")
def event_counters(t: Tables):
    e = F.col("event_type")
    cards = F.count_if(e == "error")
    return t.events.groupBy("user_id").agg(
        F.count_if(e == "purchase").alias("goals"),
        F.least(cards, F.lit(2)).cast("int").alias("cards"),
        (cards >= 2).alias("red"),
        F.max(F.when(e == "click", F.col("event_id"))).alias("last_sub"),
        F.array_join(F.array_sort(F.collect_set(F.when(~e.isin("purchase", "error", "click"), e))), ",").alias("unknown"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderdate > timestamp '1998-01-01' THEN 'scheduled' WHEN o_orderdate + INTERVAL 150 MINUTE > timestamp '1998-01-01' THEN 'live' ELSE 'stale' END AS status FROM orders""")
def status_inference(t: Tables):
    as_of, d = F.lit("1998-01-01").cast("timestamp"), F.col("o_orderdate")
    s = F.when(F.col("o_orderstatus") == "F", "final").when(d > as_of, "scheduled").when(d + F.make_interval(mins=F.lit(150)) > as_of, "live").otherwise("stale")
    return t.orders.select("o_orderkey", s.alias("status"))


@query("""SELECT p_partkey, CASE WHEN starts_with(s, a) THEN a WHEN starts_with(s, b) THEN b WHEN ends_with(s, a) THEN b WHEN ends_with(s, b) THEN a END AS home FROM
(SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN string_split(p_name, ' ')[2] || '-x' ELSE 'y' END AS s FROM part)""")
def slug_anchor(t: Tables):
    """Which of two ids a slug names first: by prefix, then by suffix, else null."""
    p = t.part.select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"), "p_name", "p_size")
    s = F.when(F.col("p_size") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).when(F.col("p_size") % 3 == 1, F.concat("b", F.lit("-x"))).otherwise("y")
    a, b = F.col("a"), F.col("b")
    return p.select("p_partkey", F.when(F.startswith(s, a), a).when(F.startswith(s, b), b).when(F.endswith(s, a), b).when(F.endswith(s, b), a).alias("home"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'HT' ELSE (floor(value)::INT) || '''' END AS clock, TRY_CAST(CASE WHEN event_type <> 'error' THEN user_id::VARCHAR ELSE '' END AS INT) AS home FROM events""")
def feed_row(t: Tables):
    """A positional live row: blank-safe numbers, clock labels."""
    row = F.array(F.when(F.col("event_type") == "view", "INT").otherwise(F.floor("value").cast("int").cast("string")), F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).otherwise(""))
    r = t.events.select("event_id", row.alias("r"))
    return r.select("event_id", F.when(F.get("r", F.lit(0)) == "INT", "HT").otherwise(F.concat(F.get("r", F.lit(0)), F.lit("'"))).alias("clock"), F.get("r", F.lit(1)).try_cast("int").alias("home"))


@query("SELECT conv_id, len(list_filter(list(role), lambda r: r NOT IN ('system')))::INT AS players FROM conversations GROUP BY 1")
def staff_excluded(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.size(F.filter(F.collect_list("role"), lambda r: ~r.isin("system"))).alias("players"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'error row' WHEN value < 1 THEN 'too small' END AS reason FROM events WHERE event_type = 'error' OR value < 1")
def extraction_rejects(t: Tables):
    _, bad = P.split_rejects(t.events.select("event_id", "event_type", "value"), {"error row": F.col("event_type") == "error", "too small": F.col("value") < 1})
    return bad.select("event_id", "reason")
