"""Column functions that take records out of markup: events, ratings, players, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotations of minute tokens.
PENALTY, OWN = "g.p.", "p.b."
_TOKEN = r"([0-9]{1,3})(?:\+([0-9]{1,2}))?'(?: *\((g\.p\.|p\.b\.)\))?"


def _number(x: Column) -> Column:
    """Digits, or nothing: blanks become null before the cast, as a cast that fails is slow."""
    return F.nullif(x, F.lit("")).try_cast("int")


def minute_tokens(x: Column) -> Column:
    """"31' 72' (g.p.)" to an array of (kind, minute, extra): a goal, a penalty or an own goal each."""
    part = lambda i: F.regexp_extract_all(x, F.lit(_TOKEN), i)
    zipped = F.arrays_zip(part(1).alias("m"), part(2).alias("e"), part(3).alias("a"))
    return F.transform(
        zipped,
        lambda t: F.struct(
            F.when(t["a"] == PENALTY, "penalty").when(t["a"] == OWN, "own_goal").otherwise("goal").alias("kind"),
            t["m"].cast("int").alias("minute"),
            _number(t["e"]).alias("extra"),
        ),
    )


def rated(x: Column) -> Column:
    """One line to (name, score), by the first layout that fits: score after the name in
    parentheses, score before the name, bare score first. A dash or nothing in the parentheses is 0."""
    after_name = F.regexp_extract(x, r"^ *([^()0-9;]{1,35}?) *\( *([0-9]{1,2}|[-–—]?) *\)", 1)
    after = F.regexp_extract(x, r"^ *([^()0-9;]{1,35}?) *\( *([0-9]{1,2}|[-–—]?) *\)", 2)
    before = r"^ *\(?([0-9]{1,2})\)? *[-–:]? *([^()0-9;]{1,35}?) *$"
    score_after = F.when(after.isin("", "-", "–", "—"), F.lit(0)).otherwise(after.try_cast("int"))
    score_before = _number(F.regexp_extract(x, before, 1))
    fits_after, fits_before = after_name != "", F.regexp_extract(x, before, 2) != ""
    name = F.when(fits_after, after_name).when(fits_before, F.regexp_extract(x, before, 2))
    score = F.when(fits_after, score_after).when(fits_before, score_before)
    return F.when(score.between(0, 10), F.struct(name.alias("name"), score.alias("score")))


def player(x: Column) -> Column:
    """(id, name, captain, shirt, inactive) from a card: the id from its link, else its data attribute; null without either."""
    link = F.nullif(F.regexp_extract(x, 'href="/player/([0-9]+)"', 1), F.lit(""))
    data = F.nullif(F.regexp_extract(x, 'data-id="([0-9]+)"', 1), F.lit(""))
    name = F.regexp_extract(x, ">([^<>]+)</a>", 1)
    ident = F.coalesce(link, data)
    return F.when(
        ident.isNotNull(),
        F.struct(
            ident.alias("id"),
            F.trim(F.regexp_replace(name, r"\(C\) *$", "")).alias("name"),
            name.rlike(r"\(C\) *$").alias("captain"),
            _number(F.regexp_extract(x, "<b>([0-9]+)</b>", 1)).alias("shirt"),
            x.rlike('class="inactive').alias("inactive"),
        ),
    )


def score(x: Column) -> Column:
    """'2 - 1' to (2, 1), anything else to null."""
    side = lambda i: _number(F.regexp_extract(x, r"^ *([0-9]{1,2}) *- *([0-9]{1,2}) *$", i))
    return F.when(side(1).isNotNull(), F.struct(side(1).alias("home"), side(2).alias("away")))


def absolute(url: Column, site: str) -> Column:
    """Protocol-less and site-relative addresses made absolute; fragments dropped; blank is null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    out = F.when(F.startswith(bare, F.lit("//")), F.concat(F.lit("https:"), bare)).when(F.startswith(bare, F.lit("/")), F.concat(F.lit(site), bare)).otherwise(bare)
    return F.nullif(out, F.lit(""))


def labelled(x: Column, label: str) -> Column:
    """The value that follows a label: <span>label</span> <b>value</b>."""
    return F.nullif(F.trim(F.regexp_extract(x, f"<span>{label}</span> *<b>([^<]*)</b>", 1)), F.lit(""))


def valid_ranges(x: Column) -> Column:
    return x.rlike(r"^ *[0-9]+(\.[0-9]+)? *- *[0-9]+(\.[0-9]+)? *(, *[0-9]+(\.[0-9]+)? *- *[0-9]+(\.[0-9]+)? *)*$")


def hmac_sha256(key: bytes, payload: Column) -> Column:
    """Hex HMAC-SHA256 from two SHA-256 passes, in generated code."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(k ^ b for k in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), payload.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def lineup_role(section: Column) -> Column:
    """Which list a section of a lineup page holds, by its place: the first four count, the rest is staff."""
    table = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(starter).alias("starter")) for starter in (True, False) for side in "AB"])
    return F.get(table, section)


def _first(x: Column, *patterns: str) -> Column:
    """The group of the first pattern that matches, trimmed; null if none does."""
    return F.coalesce(*[_once(F.trim(F.regexp_extract(x, p, 1)), lambda v: F.nullif(v, F.lit(""))) for p in patterns])


def section_of(html: Column, title: str) -> Column:
    """What lies between the heading of this title and the next heading; null without it."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<h2>{title}</h2>(.*?)(?:<h2>|$)", 1), F.lit(""))


# Words that mark youth and reserve sides.
YOUTH = r"(?i)(?:\bU ?-?(?:1[5-9]|2[0-3])\b|\bB$|\bjuniors?\b|\byouth\b)"


def table_rows(html: Column) -> Column:
    """The rows of a table in order: (id, name, cells) of each that links to a record; others are dropped."""
    rows = F.transform(
        F.slice(F.split(html, "<tr[ >]"), 2, 100_000_000),
        lambda r: F.struct(
            _first(r, r'href="/[a-z]+/([0-9]+)"').alias("id"),
            _first(r, r'href="/[a-z]+/[0-9]+"[^>]*>([^<]+)<').alias("name"),
            F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))).alias("cells"),
        ),
    )
    return F.filter(rows, lambda r: r["id"].isNotNull() & r["name"].isNotNull())


def senior(rows: Column) -> Column:
    """Rows whose name marks no youth or reserve side."""
    return F.filter(rows, lambda r: ~r["name"].rlike(YOUTH))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: inside the lambda of an array function an expression is computed for every
    element, and again wherever it is named."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def first_by_id(rows: Column) -> Column:
    """The first row of each id, in order."""
    first = lambda b: F.filter(b["rows"], lambda r, i: F.array_position(b["ids"], r["id"]) == i + 1)
    return _once(rows, lambda x: _once(F.struct(x.alias("rows"), F.transform(x, lambda r: r["id"]).alias("ids")), first))


def fixture(row: Column) -> Column:
    """One row of a round to (id, slug, date, home, home_id, away, away_id, home_score, away_score, kickoff, status); null with fewer than two teams.

    The id is the row's own, else that of its link; a result makes it final, a kick-off time scheduled."""
    teams = F.regexp_extract_all(row, F.lit(r'href="/team/([0-9]+)"[^>]*>([^<]+)<'), 1)
    names = F.regexp_extract_all(row, F.lit(r'href="/team/([0-9]+)"[^>]*>([^<]+)<'), 2)
    made = lambda names, teams, s: F.struct(
        _first(row, r'id="game-([0-9]+)"', r'href="/game/[a-z0-9-]*?([0-9]+)"').alias("id"),
        _first(row, r'href="/game/([a-z0-9-]+)"').alias("slug"),
        _first(row, r"([0-9]{4}-[0-9]{2}-[0-9]{2})").try_cast("date").alias("date"),
        F.get(names, 0).alias("home"),
        F.get(teams, 0).try_cast("long").alias("home_id"),
        F.get(names, 1).alias("away"),
        F.get(teams, 1).try_cast("long").alias("away_id"),
        s["home"].alias("home_score"),
        s["away"].alias("away_score"),
        _first(row, r'class="vs"[^>]*>([0-9]{1,2}:[0-9]{2})<').alias("kickoff"),
        F.when(s.isNotNull(), "final").otherwise("scheduled").alias("status"),
    )
    said = F.regexp_extract(row, r'class="result"[^>]*>([^<]*)<', 1)
    parts = lambda n: F.struct(n.alias("names"), teams.alias("teams"), _once(said, score).alias("score"))
    return _once(names, lambda n: F.when(F.size(n) >= 2, _once(parts(n), lambda v: made(v["names"], v["teams"], v["score"]))))


def fixtures(html: Column) -> Column:
    """The fixtures of a round page in order; the first row of an id wins, rows without id or with fewer than two teams are dropped."""
    rows = F.transform(F.slice(F.split(html, "(?=<tr[ >])"), 1, 100_000_000), fixture)
    return first_by_id(F.filter(rows, lambda r: r.isNotNull() & r["id"].isNotNull()))


# The sections of a squad page that count.
SQUAD = ("Goalkeepers", "Defenders", "Midfielders", "Forwards")


def squad(html: Column) -> Column:
    """The players of a squad page in order: (id, name, section, shirt, departed). Cards carry any further
    classes; the id comes from the link, else from the photo's file name; the first card of an id wins; other sections are left out."""
    parts = F.filter(F.split(html, "(?=<h2>)"), lambda p: F.regexp_extract(p, "^<h2>([^<]*)</h2>", 1).isin(*SQUAD))
    cards = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.slice(F.split(p, r'(?=<div class="[^"]*\bplayer\b)'), 2, 100_000_000),
                lambda c: F.struct(
                    _first(c, r'href="/player/([0-9]+)"', r'src="[^"]*/([0-9]+)\.(?:png|jpg)"').alias("id"),
                    _first(c, r"<b>([^<]+)</b>").alias("name"),
                    F.regexp_extract(p, "^<h2>([^<]*)</h2>", 1).alias("section"),
                    _number(F.regexp_extract(c, r"<i>([0-9]+)</i>", 1)).alias("shirt"),
                    c.rlike(r'^<div class="[^"]*\bdeparted\b').alias("departed"),
                ),
            ),
        )
    )
    return first_by_id(F.filter(cards, lambda c: c["id"].isNotNull()))


def standouts(text: Column) -> Column:
    """Standout boxes of an article, one per line: (name, score), by the first layout that fits: score first, label
    first, name first, or a bare name after the label. Names that fold to the same key are one, the first with a score winning."""
    from .text import norm_key

    name, num = r"([^0-9:()|]+?)", r"([0-9]{1,2})"
    layouts = (
        (rf"^ *{num} *[|-]? *MVP *[:|-]? *{name} *$", 2, 1),
        (rf"^ *MVP *[:|-] *{name} *\(? *{num} *\)? *$", 1, 2),
        (rf"^ *{name} *[|-] *MVP *[:|-]? *{num} *$", 1, 2),
    )
    made = lambda line: F.coalesce(
        *[F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, n).alias("name"), F.regexp_extract(line, p, k).try_cast("int").alias("score"))) for p, n, k in layouts],
        F.when(line.rlike(rf"^ *MVP *[:|-] *{name} *$"), F.struct(F.regexp_extract(line, rf"^ *MVP *[:|-] *{name} *$", 1).alias("name"), F.lit(None).cast("int").alias("score"))),
    )
    boxes = F.filter(F.transform(F.split(text, "\n"), made), lambda b: b.isNotNull())
    keys = F.transform(boxes, lambda b: norm_key(b["name"]))
    best = lambda b, i: F.coalesce(b["score"], F.get(F.transform(F.filter(F.zip_with(boxes, keys, lambda x, k: F.struct(x["score"].alias("s"), k.alias("k"))), lambda z: (z["k"] == F.get(keys, i)) & z["s"].isNotNull()), lambda z: z["s"]), F.lit(0)))
    named = F.transform(boxes, lambda b, i: F.struct(b["name"].alias("name"), best(b, i).alias("score"), (F.array_position(keys, F.get(keys, i)) == i + 1).alias("first")))
    return F.transform(F.filter(named, lambda b: b["first"]), lambda b: F.struct(b["name"].alias("name"), b["score"].alias("score")))
