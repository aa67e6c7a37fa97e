"""Column functions over text: folding, tokens, names, units."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> tuple[str, str]:
    """Characters and what they fold to, by the rule of Unicode: compatibility decomposition without its marks, where
    that leaves one ASCII letter or digit. The marks themselves stand last, without a counterpart: they are deleted."""
    marked, plain = [], []
    for c in map(chr, range(0x80, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            marked.append(c)
            plain.append(base)
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


MARKED, PLAIN = _folds()
# Ligatures, and their letters.
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ĳ", "ij"))
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def fold(x: Column) -> Column:
    """Lower case without marks. One translation in generated code; letters that don't decompose stay."""
    low = F.lower(x)
    apart = low
    for a, b in LIGATURES:
        apart = F.replace(apart, F.lit(a), F.lit(b))
    return F.translate(F.when(low.rlike("[ﬀ-ﬄĳ]"), apart).otherwise(low), MARKED, PLAIN)


def norm_key(x: Column) -> Column:
    return F.regexp_replace(fold(x), "[^a-z0-9]", "")


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), F.lit("-"))


def clean_name(x: Column) -> Column:
    """Entities resolved, no-break spaces and runs of blanks to one blank, trimmed."""
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.replace(x, F.lit(" "), F.lit(" ")), "[ \\t\\r\\n]+", " "))


def strip_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "[ \\t\\r\\n]+", " "))


def tokens(x: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded tokens, sorted; if the filters leave none, all of them."""
    every = F.filter(F.split(fold(x), "[^a-z0-9]+"), lambda w: w != "")
    kept = F.array_except(F.filter(every, lambda w: F.length(w) >= least), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))
    return F.array_sort(F.array_distinct(F.when(F.size(kept) == 0, every).otherwise(kept)))


def token_overlap(a: Column, b: Column, prefix: int = 3) -> Column:
    """Share of equal tokens of the longer list; tokens of `prefix` letters or more match as prefixes too."""
    same = lambda x, y: (x == y) | ((F.least(F.length(x), F.length(y)) >= prefix) & (x.startswith(y) | y.startswith(x)))
    hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: same(x, y))))
    return F.coalesce(hits / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def shares_word(a: Column, b: Column) -> Column:
    """Whether a word of `a`, of 3 letters or more, equals a word of `b` or is a prefix of it or the reverse, again from 3 letters on."""
    same = lambda x, y: (x == y) | ((F.length(y) >= 3) & (x.startswith(y) | y.startswith(x)))
    return F.exists(a, lambda x: (F.length(x) >= 3) & F.exists(b, lambda y: same(x, y)))


def last_word(x: Column) -> Column:
    return F.element_at(F.split(fold(x), "[^a-z0-9]+"), -1)


def edit_within_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def names_match(a: Column, b: Column) -> Column:
    """Equal; or one inside the other, the shorter of 4 letters or more; or one edit apart, the longer of 8 or more."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((short >= 4) & contains_either(a, b)) | ((long_ >= 8) & edit_within_one(a, b))


def minute(x: Column) -> Column:
    """'90+2' to (90, 2), '67' to (67, null), anything else to (null, null)."""
    part = lambda i: F.nullif(F.regexp_extract(x, r"^[ ]*([0-9]{1,3})(?:\+([0-9]{1,2}))?", i), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("minute"), part(2).alias("extra"))


def minute_label(m: Column, extra: Column) -> Column:
    return F.when(extra.isNull(), m.cast("string")).otherwise(F.concat(m.cast("string"), F.lit("+"), extra.cast("string")))


def rating(x: Column) -> Column:
    """'(5)' to 5, a dash to 0, blank to null."""
    bare = F.trim(F.regexp_replace(x, "[()]", ""))
    return F.when(bare.isin("-", "–", "—"), F.lit(0)).otherwise(bare.try_cast("int"))


def amount_in_thousands(x: Column) -> Column:
    """'8,00 M €' to 8000, '600 mil €' to 600, anything else to null."""
    number = F.replace(F.regexp_extract(x, r"([0-9]+(?:,[0-9]+)?) *(M|mil)\b", 1), F.lit(","), F.lit("."))
    number = F.nullif(number, F.lit("")).try_cast("double")
    unit = F.regexp_extract(x, r"([0-9]+(?:,[0-9]+)?) *(M|mil)\b", 2)
    return F.bround(number * F.when(unit == "M", 1000).when(unit == "mil", 1), 0).cast("int")


def code(x: Column, table: dict[str, str], unknown: Column | None = None) -> Column:
    """A vocabulary lookup compiled into a literal map; unknown: null, or what is given."""
    got = F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)
    return got if unknown is None else F.coalesce(got, unknown)


def season_start(x: Column) -> Column:
    """'2025/26' to 2025."""
    return F.nullif(F.regexp_extract(x, "((?:19|20)[0-9]{2})", 1), F.lit("")).try_cast("int")


def backoff(attempts: Column) -> Column:
    return F.least(5 * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0))), F.lit(300)).cast("int")


def local_instant(y: Column, mo: Column, d: Column, h: Column, mi: Column, zone: str) -> Column:
    return F.make_timestamp(y, mo, d, h, mi, F.lit(0), F.lit(zone))


def with_aliases(words: Column, groups: list[list[str]]) -> Column:
    """Tokens, and for each that belongs to an alias group the whole group."""
    table = F.create_map(*[x for g in groups for w in g for x in (F.lit(w), F.array(*[F.lit(y) for y in g]))])
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.array_sort(F.array_union(words, more))
