import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: names that operators use themselves
CLASH = ["rep", "k", "h", "n", "length", "ids", "part", "block", "grp", "component_id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from {id: text} or [(id, text)], optionally with clashing extra columns."""

    def make(rows, clash=False):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(c).alias(c) for c in CLASH])
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long, repeated and special texts; null and repeated ids."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    line = "one two three four five six seven eight nine ten\nsecond line here\nthird line is here\nfourth\n\n"
    return [
        (None, None), (None, "no id here"), (1, None), (2, ""), (3, " \t\n "), (4, "Word"), (5, "a  b   c \n d\n\n e"),
        (6, long), (7, long), (8, line), (9, line), (9, line), (10, line + "more"), (11, "x" * 5000), (12, "<|endoftext|> é 漢字 🙂   z"),
        (13, "one two three four five"), (13, "another text of that id"), (-5, "negative id of some words in here"),
    ]
