import pytest

#: Null and empty texts, repeated rows, ties, one long text, a null id; in the order doc_id, text, lang, source, n_chars.
ROWS = [
    (1, "the cat sat on the mat and then it went away", "en", "src0", 10),
    (2, "the cat sat on the mat and then it went away", "en", "src0", 10),
    (3, None, "en", "src1", None),
    (4, "", None, "src1", 0),
    (5, " ", "de", None, 1),
    (6, "The cat, sat on the mat -- and then it went away!", "en", "src2", 10),
    (7, "one two", "en", "src2", 7),
    (7, "one two", "en", "src2", 7),
    (8, "word " * 3000 + "end", "fr", "src0", 15003),
    (9, "word " * 3000 + "other", "fr", "src0", 15005),
    (None, "one two", "en", "src3", 7),
    (10, "émile ß Ünï 😀 x@y.example +49 30 1234567", "de", "src3", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The rows above as a file, with further columns of clashing names."""
    path = str(tmp_path_factory.mktemp("docs") / "d")
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as tag", "'k' as keep_id", "2 as n", "'x' as c")
    df.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "e")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
