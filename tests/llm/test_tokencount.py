import functools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import tokencount as T
from ledgerloom.llm.common import read

from ..conftest import SMALL

ALPHABET = "ab 's'll  \n\t12.,-é日👍"
texts = st.text(alphabet=ALPHABET, max_size=400)


@functools.cache
def count():
    return T.counter(T.load())


def whole(text):
    return len(count().encoding.encode_ordinary(text))


def tree_of(text):
    return T.Tree(text, *count().leaves(text)[:2])


def held(tree, text):
    assert tree.tokens == whole(text) and tree.text() == text and tree.chars == len(text)
    leaves = tree.leaves()
    assert leaves.sum(0).tolist() == [len(text), tree.tokens] and tree.sums[1, 2] == len(leaves)


@settings(max_examples=2500, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(-3, 420), st.integers(-3, 420), st.text(alphabet=ALPHABET, max_size=30)), max_size=5), st.sampled_from([2, 5, 32]))
def test_edits_equal_a_whole_count(text, edits, leaf):
    kept, T.LEAF = T.LEAF, leaf
    try:
        tree = tree_of(text)
        held(tree, text)
        for start, end, new in edits:
            T.edit(tree, start, end, new, count())
            start = min(max(start, 0), len(text))
            text = text[:start] + new + text[max(start, min(end, len(text))) :]
            held(tree, text)
    finally:
        T.LEAF = kept


def test_an_edit_before_the_first_leaf():
    tree = tree_of("a")
    T.edit(tree, 0, 0, "1", count())
    held(tree, "1a")


def test_only_the_region_is_encoded():
    text = "some words in a row " * 20_000
    tree = tree_of(text)
    again = T.edit(tree, 200_000, 200_010, "other", count())
    assert again < 4 * T.LEAF
    held(tree, text[:200_000] + "other" + text[200_010:])


def test_appends_to_an_empty_text_split_leaves():
    tree, text = tree_of(""), ""
    for i in range(600):
        new = f" word{i} and five more of them"
        again = T.edit(tree, len(text), len(text), new, count())
        text += new
        assert again < 4 * T.LEAF + 10
    held(tree, text)
    assert len(tree.leaves()) > 100


def test_inserts_at_one_place_split_leaves():
    text = "left of it " * 300 + "right of it " * 300
    tree = tree_of(text)
    for i in range(300):
        again = T.edit(tree, 3300, 3300, f"put {i} in ", count())
        text = text[:3300] + f"put {i} in " + text[3300:]
        assert again < 4 * T.LEAF + 10
    held(tree, text)


def test_a_paste_and_an_edit_inside_it():
    text = "before it all and after it all"
    tree, new = tree_of(text), "pasted words " * 20_000
    T.edit(tree, 10, 10, new, count())
    text = text[:10] + new + text[10:]
    held(tree, text)
    assert T.edit(tree, 100_000, 100_001, "x", count()) < 4 * T.LEAF
    held(tree, text[:100_000] + "x" + text[100_001:])


def test_cuts_join_small_leaves():
    text = "a b c d e f " * 2000
    tree = tree_of(text)
    while len(text) > 100:
        T.edit(tree, 40, 90, "", count())
        text = text[:40] + text[90:]
    held(tree, text)
    assert len(tree.leaves()) < 8


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "some text", "kept")], "doc_id long, text string, leaf string").withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"))
    for c in ("n", "chars", "tokens", "_t", "_e"):
        df = df.withColumn(c, F.lit("clash"))
    row = T.count_edited(df, T.load(), ["doc_id", "leaf", "_t", "chars"]).first()
    assert (row["n_tokens"], row["n_tokens_after"], row["leaf"], row["_t"]) == (2, 2, "kept", "clash")


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, SMALL, "documents").collect()}
    for r in T.op10_tokens(spark, SMALL).collect():
        text = docs[r["doc_id"]]
        n = len(text)
        a = text[: n // 3] + text[n // 3 + 10 :]
        h = min(n // 2, len(a))
        b = a[:h] + " edited" + a[h:]
        c = b[:n] + "\nEnd." + b[n:]
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_after"]) == (whole(text), 3, whole(c))


def test_edges_and_state(spark, edge_docs, no_docs):
    ranks = T.load()
    edit = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("new ").alias("text")), F.lit(None).cast("struct<start:int,end:int,text:string>"))
    state = T.build(edge_docs.select("doc_id", "text", "score"), ranks, ["doc_id"]).withColumn("edits", edit)
    rows = T.apply_edits(state, ranks, ["doc_id", "n_tokens"], with_state=True)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == edge_docs.count() and got[30]["n_tokens"] == 0 and got[30]["n_tokens_after"] == whole("new ") and got[30]["n_edits"] == 1
    again = T.apply_edits(rows.select("doc_id", "text", "leaves", edit.alias("edits")), ranks, ["doc_id"]).collect()
    assert {r["doc_id"]: r["n_tokens_after"] for r in again}[33] == whole("new new " + got[33]["text"][4:])
    bare = T.apply_edits(state.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>")), ranks, ["n_tokens"])
    assert bare.where("n_tokens <> n_tokens_after or n_edits <> 0").count() == 0
    assert T.build(no_docs, ranks, ["doc_id"]).count() == 0
