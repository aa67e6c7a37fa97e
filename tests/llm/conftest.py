import pytest

WORDS = "the of and river stone cloud paper green sings little under winter market yellow ocean garden".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 16 & 15] + "abcdefghij"[x >> 20 & 7])
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named like results."""
    rows = [(i, prose(i, 60), "en" if i % 2 else "de", f"src{i % 3}", 1) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "src0", 0), (32, " \n\t ", "de", "src1", 3), (None, prose(99, 40), "en", "src0", 1), (None, None, None, None, None)]
    rows += [(33, prose(5, 200_000), "en", "src0", 1), (34, prose(3, 60), "de", "src0", 1), (34, prose(3, 60), "de", "src0", 1), (35, "x" * 300_000, "en", None, 1), (36, "日本語 テスト ñandú 👍", "ja", "src9", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "fp", "id", "x", "found", "lang_pred", "component_id", "rank", "position", "block", "u", "v", "y", "seed", "a", "b", "pos", "at", "leaves", "edits", "_score", "_text", "anchor"):
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
