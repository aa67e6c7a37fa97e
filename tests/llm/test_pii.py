import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pii

from ..conftest import DATA

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The base kinds, straight from their patterns."""
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def base(text):
    return [(a, b, k) for a, b, k, _ in pii.spans(text) if k in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.-_%+ 0123456789()é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "@", "x@y", ".", "1.2.3.4", "255.255.255.256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0100", " ", "7", "+", "-"]), max_size=9).map("".join))
def test_base_spans_of_joined_pieces(text):
    assert base(text) == plain(text)


def test_further_kinds():
    kinds = lambda t: [k for *_, k, _ in pii.spans(t)]
    assert "iban" in kinds("pay to GB82 WEST 1234 5698 7654 32 now")
    assert "iban" in kinds("pay to GB82WEST12345698765432 NOW")
    assert "iban" not in kinds("pay to GB82 WEST 1234 5698 7654 33 now")
    assert "national" in kinds("my ssn is 123-45-6789.") and "national" not in kinds("part 123-45-6789.")
    assert "secret" in kinds('token = "f33e61083db5dbdf4bd2369d2fab12"') and "secret" not in kinds("hash f33e61083db5dbdf4bd2369d2fab12")


def test_context_words():
    kinds = lambda t: [k for *_, k, _ in pii.spans(t)]
    score = lambda t: pii.spans(t)[0][3]
    key = "f33e61083db5dbdf4bd2369d2fab12"
    for said in ("contraseña:", "senha segredo", "mot de passe", "Kennwort", "API-Key", "api_key =", "APIKEY"):
        assert kinds(f"{said} {key}") == ["secret"], said
    assert kinds(f"token {key * 10}") == ["secret"]  # of any length
    assert kinds("shipment 123-45-6789 for the classn") == [] and kinds("the passwords123 " + key) == []  # whole words only
    assert kinds("İ SSN: 123-45-6789") == ["national"]  # a letter whose lower case is longer
    assert kinds("ssn 123-45-6789") == ["national"] and kinds("ssn of the order 123-45-6789") == []  # a word against it, nearer
    assert kinds("ssn " + "x" * 60 + " 123-45-6789") == []  # too far off
    assert score("card 4111111111111111") > score("card, it is said, 4111111111111111") > score("4111111111111111") > score("invoice 4111111111111111")
    assert score("4111111111111111 visa") > score("4111111111111111")


def test_scores_of_the_query(spark):
    df = spark.createDataFrame([(1, "card 4111111111111111 a@b.cd"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.digests(pii.find(df)).collect()}
    assert got == {1: ("card:5:21,email:22:28", "0.996,0.7"), 2: ("", "")}


def test_many_spans_are_linear():
    text = "ssn 123-45-6789, card 4111111111111111; "
    got = pii.spans(text * 20_000)
    assert sum(x[2] == "national" for x in got) == sum(x[2] == "card" for x in got) == 20_000


def test_long_runs_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a.b" * 100_000 + "@", "+1" + " " * 400_000, "@" * 200_000, "+" * 200_000):
        pii.spans(text)


def test_edges(spark, edge_docs, no_docs):
    got = {(r["doc_id"], r["spans"], r["base_sha256"]) for r in pii.digests(pii.find(edge_docs)).collect()}
    assert (30, "", hashlib.sha256(b"").hexdigest()) in got and edge_docs.count() == pii.find(edge_docs).count()
    assert pii.digests(pii.find(no_docs)).count() == 0
    red = pii.redact(edge_docs)
    assert red.columns == edge_docs.columns and red.count() == edge_docs.count()
    df = spark.createDataFrame([(1, "mail a.b@c.de or +1 (212) 555-0100")], "doc_id long, text string")
    assert pii.redact(df).first()["text"] == "mail [EMAIL] or [PHONE]"


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in pii.op2_pii(spark, DATA).collect():
        want = plain(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in want) for k in pii.BASE]
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r["spans"].split(","))
