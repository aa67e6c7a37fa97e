import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import chat as C

from ..conftest import DATA

texts = st.text(alphabet="ab<>s/[]INST\\\nl|é ", max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb<s>", ""]), texts), max_size=6))
def test_round_trip_and_spans(turns):
    out, where, rewrites = C.spans(turns)
    assert C.parse(out) == turns and not rewrites
    assert [C.unescape(out[a:b]) for _, _, a, b, _ in where] == [t for _, t in turns] and all(w[4] for w in where)
    assert [(a, b) for a, b, *_ in where] == list(zip([0, *[b for _, b, *_ in where]], [b for _, b, *_ in where]))


COLLAPSE = lambda turns: "".join(f"({r})" if i < len(turns) - 1 else f"({r}:{t})" for i, (r, t) in enumerate(turns))
TRIMMED = lambda turns: "".join(f"<{r}>{t.strip()}</{r}>" for r, t in turns)
HEADED = lambda turns: f"{len(turns)} turns\n" + "".join(f"{r}={t};" for r, t in turns)
TWICE = lambda turns: "".join(f"{r}:{t}|" for r, t in turns) + (f"last:{turns[-1][1]}" if turns else "")
COUNTED = lambda turns: "".join(f"[{len(t)}]{t}/" for r, t in turns)


def test_rewriting_templates_are_found():
    out, where, rewrites = C.spans([("u", "one"), ("a", "two"), ("u", "three")], COLLAPSE)
    assert out == "(u)(a)(u:three)" and rewrites
    assert [w[2:4] for w in where] == [(None, None), (None, None), (9, 14)] and all(w[:2] == (None, None) for w in where)
    out, where, rewrites = C.spans([("u", "one"), ("a", "two")], HEADED)
    assert rewrites and [out[a:b] for _, _, a, b, _ in where] == ["one", "two"]


def test_trimming_templates_are_seen():
    out, where, rewrites = C.spans([("u", " one "), ("a", "two")], TRIMMED)
    assert not rewrites and [out[w[2] : w[3]] for w in where] == ["one", "two"] and [w[4] for w in where] == [False, True]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "a"]), st.text(alphabet="ab :|(\ue000", max_size=6)), max_size=5), st.sampled_from([COLLAPSE, TRIMMED, HEADED, TWICE, COUNTED]))
def test_spans_lie_in_the_output_in_order(turns, template):
    out, where, rewrites = C.spans(turns, template)
    assert out == template(turns) and len(where) == len(turns)
    held = [w for w in where if w[2] is not None]
    assert all(0 <= w[2] <= w[3] <= len(out) for w in held) and all(x[3] <= y[2] for x, y in zip(held, held[1:]))
    assert all(w[4] == (out[w[2] : w[3]] == t) for w, (_, t) in zip(where, turns) if w[2] is not None)
    if template in (HEADED, COUNTED):
        assert [out[w[2] : w[3]] for w in held] == [t for w, (_, t) in zip(where, turns) if w[2] is not None]
    if not rewrites:
        ends = [len(template([])), *[w[1] for w in where]]
        assert [w[0] for w in where] == ends[:-1]


def test_a_turn_costs_one_render():
    calls = []
    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(100)]
    form = C.Formatter(lambda t: calls.append(len(t)) or C.TEMPLATE(t), C.unescape)
    form.spans(turns)
    calls.clear()
    form.spans(turns)
    assert len(calls) == 101


def test_query_equals_sql(spark):
    from ledgerloom.llm.catalog import SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = set(con.sql(f"SELECT {', '.join(names)} FROM ({SQL['op7_chat']})").fetchall())
    assert {tuple(r[c] for c in names) for r in C.op7_chat(spark, DATA).collect()} == want


def test_edges(spark):
    rows = [(1, 0, "user", None, "z"), (1, 1, None, "x", "z"), (1, 1, None, "x", "z"), (1, None, "assistant", "first", "z"), (None, 0, "user", "a", "z"), (None, None, None, None, None), (2, 0, "assistant", "y" * 200_000, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in C.digests(C.convert(df)).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 5 and got[2]["loss_chars"] == 200_000
    assert [r["n_turns"] for r in C.digests(C.convert(df)).where("conv_id is null").collect()] == [1, 1]
    assert C.digests(C.convert(df.where("conv_id = 99"))).count() == 0
