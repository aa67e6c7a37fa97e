"""Worked examples and properties of the column functions."""

import hashlib
import hmac
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import layers as L
from ledgerloom.functions import parse as R
from ledgerloom.functions import text as X


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


CASES = [
    (X.minute, ["90+2", "67", "HT", None], [(90, 2), (67, None), (None, None), (None, None)]),
    (X.rating, ["(5)", "(-)", "(–)", "(—)", " ", None], [5, 0, 0, 0, None, None]),
    (X.amount_in_thousands, ["8,00 M €", "600 mil €", "-", "12,5 M €"], [8000, 600, None, 12500]),
    (X.season_start, ["2025/26", "x"], [2025, None]),
    (X.norm_key, ["Ânção d'Ávila-3", "", None], ["ancaodavila3", "", None]),
    (X.slug, ["  São Água! 2 ", "--"], ["sao-agua-2", ""]),
    (X.clean_name, ["A &amp; B&nbsp; C", " x\n y "], ["A & B C", "x y"]),
    (X.strip_tags, ["<p>a<br>b</p>"], ["a b"]),
    (R.score, ["2 - 1", "20:30", "10-0"], [(2, 1), None, (10, 0)]),
    (R.rated, ["Ana Reis (6)", "Ana Reis (-)", "Ana Reis ()", "7 - Ana Reis", "(7) Ana Reis", "Ana Reis (11)", "nothing"], [("Ana Reis", 6), ("Ana Reis", 0), ("Ana Reis", 0), ("Ana Reis", 7), ("Ana Reis", 7), None, None]),
    (R.valid_ranges, ["4-5.5, 5.5-6", "4 to 5", "10-20"], [True, False, True]),
    (lambda x: R.absolute(x, "https://s"), ["//a/b", "/c#d", "http://e", " "], ["https://a/b", "https://s/c", "http://e", None]),
    (lambda x: F.array_join(X.tokens(x, 3, ("the",)), " "), ["The big Águia", "a b", "the"], ["aguia big", "a b", "the"]),
]


@pytest.mark.parametrize("f, inputs, want", CASES)
def test_examples(spark, f, inputs, want):
    got = values(spark, f, inputs)
    assert [tuple(x) if isinstance(x, tuple) else x for x in got] == want


def test_minute_tokens(spark):
    got = values(spark, R.minute_tokens, ["89' 90+1'", "31' 72' (g.p.)", "17' (g.p.) 37'", "5' (p.b.)", ""])
    plain = [[(t["kind"], t["minute"], t["extra"]) for t in x] for x in got]
    assert plain == [[("goal", 89, None), ("goal", 90, 1)], [("goal", 31, None), ("penalty", 72, None)], [("penalty", 17, None), ("goal", 37, None)], [("own_goal", 5, None)], []]


def test_player_cards(spark):
    card = '<div class="inactive x"><a href="/player/12">Rui Dias (C)</a><b>7</b></div>'
    got = values(spark, R.player, [card, '<div><a data-id="9">Ana</a><b>-</b></div>', "<div>nobody</div>"])
    assert tuple(got[0]) == ("12", "Rui Dias", True, 7, True) and tuple(got[1]) == ("9", "Ana", False, None, False) and got[2] is None


def test_backoff(spark):
    assert values(spark, X.backoff, [1, 2, 3, 4, 5, 6, 7, 8], "int") == [5, 10, 20, 40, 80, 160, 300, 300]


def test_ranges(spark):
    table = L.parse_ranges({"0-5": 4, "5-5.7": 5, "5.7-6.5": 6, "6.5-7": 7, "7-7.5": 8, "7.5-8": 9, "8-10": 10, "bad": 1, "x-y": 2})
    assert values(spark, lambda x: L.bucket(x, table), [4.7, 5.65, 6.05, 7.0, 7.55, 8.1, 10.0, 10.1, None], "double") == [4, 5, 6, 8, 9, 10, 10, None, None]


def test_names(spark):
    pairs = [("nabil", "nabili", True), ("makan", "maikan", False), ("rodrigues", "rodriguez", True), ("abc", "abcd", False), ("lima", "limao", True), ("xyz", "xyz", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean").coalesce(1)
    assert [r[0] for r in df.select(X.names_match(F.col("a"), F.col("b"))).collect()] == [w for *_, w in pairs]
    edits = df.select(X.edit_within_one(F.col("a"), F.col("b")).alias("e"))
    assert [r["e"] for r in edits.collect()][:2] == [True, True]


def test_fold_equals_unicode_decomposition(spark):
    letters = [c for c in map(chr, range(0xC0, 0x17F)) if len(unicodedata.normalize("NFKD", c)) > 1 and unicodedata.normalize("NFKD", c)[0].isascii() and c not in "İŉĿŀ"]
    want = ["".join(ch for ch in unicodedata.normalize("NFKD", c).lower() if ch.isascii() and ch.isalnum()) for c in letters if "IJ" not in unicodedata.normalize("NFKD", c).upper()]
    letters = [c for c in letters if "IJ" not in unicodedata.normalize("NFKD", c).upper()]
    assert values(spark, X.norm_key, letters) == want


@settings(max_examples=20, deadline=None)
@given(key=st.binary(max_size=80), payload=st.text(max_size=40))
def test_hmac(spark, key, payload):
    got = spark.range(1).select(R.hmac_sha256(key, F.lit(payload))).first()[0]
    assert got == hmac.new(key, payload.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()


def test_map_layers(spark):
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int")).alias("m"))
    c = F.col("m")
    row = m.select(L.overlaid(c, "a", F.lit(9)), L.overlaid(c, "b", F.lit(9)), L.overlaid(c, "c", F.lit(9)), L.put(c, F.lit("a"), F.lit(5)), L.without(c, F.lit("a")), L.present(c)).first()
    assert tuple(row) == (1, None, 9, {"b": None, "a": 5}, {"b": None}, {"a": 1})
    assert tuple(spark.range(1).select(*L.split_goals(F.lit(2), F.lit(1)), *L.split_goals(F.lit(0), F.lit(1))).first()) == (1, 1, 0, 0)


def test_folding_follows_unicode(spark):
    from ledgerloom.functions import text

    rows = [("Șțefan Ǎơư ȩ", "stefanaoue"), ("ﬁnal ﬃ Ｆull", "finalffifull"), ("e\u0301te\u0301", "ete"), ("Ỗ İ", "oi"), ("straße", "strae")]
    df = spark.createDataFrame(rows, "x string, want string")
    assert df.where(text.norm_key(df["x"]) != df["want"]).count() == 0
    assert df.where("want = 'ete'").select(text.slug(df["x"])).first()[0] == "ete"


def test_range_scores_as_texts():
    from ledgerloom.functions.layers import parse_ranges

    assert parse_ranges({"0-5": "4", "5-6": 5, "x-y": 1, "7-8": "no"}) == [(0.0, 5.0, 4), (5.0, 6.0, 5)]


def test_a_page_is_cut_into_rows_once(spark):
    """Not once for every row of it, as an expression inside a lambda is."""
    df = spark.createDataFrame([('<tr id="game-1"><a href="/team/2">A</a><a href="/team/3">B</a></tr><tr id="game-1"><a href="/team/4">C</a><a href="/team/5">D</a></tr>',)], "html string").select(R.fixtures(F.col("html")).alias("x"))
    assert [(r.id, r.home, r.away, r.status) for r in df.first().x] == [("1", "A", "B", "scheduled")]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?=<tr[ >])") == 1
    assert plan.count('class="result"') == 1
