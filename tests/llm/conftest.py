import pytest
from pyspark.sql import types as T

#: Columns of documents, and others whose names an operator might use itself.
CLASHING = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("near_join", "quality_rules", "line_chunks", "decontamination", "h", "cuts", "rid", "d1", "d2", "k", "pos", "trusted", "score", "piece")]
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows():
    """Null and empty texts, a very long one, ties, repeated rows, a null id, other scripts."""
    a = sentence(1, 60)
    rows = [(1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Two words"), (8, sentence(2, 6000)), (None, sentence(3, 40)), (9, "日本語 テキスト é ß " * 12), (10, sentence(4, 30) + "\n" + sentence(5, 30)), (11, a + " " + a), (12, "x" * 30_000), (13, "#*$ %&|<> " * 30), (14, sentence(1, 59) + " changed")]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(*r, *("v",) * (len(CLASHING) - 5)) for r in odd_rows()], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, odd, nothing):
    """Folders full and none, with small tables for whole queries."""

    def put(name, docs):
        d = tmp_path_factory.mktemp(name)
        docs.write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (8, 1, 1), (13, 0, 0), (10, 1, 0), (10, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(0, " ".join(sentence(2, 6000).split()[100:115])), (1, None), (2, "..."), (3, "two words"), (3, "two words"), (None, "one")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        return str(d)

    return {"full": put("full", odd), "none": put("none", nothing)}
