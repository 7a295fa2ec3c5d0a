from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Über_maß, x2-é!") == ["Über_maß", "x2", "é"]
    assert one(spark, T.tokens(F.col("t"), T.WORD2, True), t="A Bc É x") == ["bc"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []
    assert one(spark, T.token_count(F.col("t")), t=None) == 0


def test_cleaning(spark):
    assert one(spark, T.remove_punctuation(F.col("t")), t="a_b»c«—d'e") == "abcde"
    assert one(spark, T.remove_words(F.col("t"), ["the", "und"]), t="The cat. und, (Hund)") == "cat. Hund"
    assert one(spark, T.normalize_punctuation(F.col("t")), t="Na,  gut!Ja.") == "Na gut ! Ja ."
    assert one(spark, T.filter_tokens(F.col("t"), words=["a"], marks=False), t="A b . ! c") == "b c"
    assert one(spark, T.normalize_ws(F.col("t")), t=" a­b \n c ") == "ab c"
    assert one(spark, T.strip_note(F.col("t")), t="Haus (alt)") == "Haus"


def test_names(spark):
    assert one(spark, T.surname(F.col("t")), t="Droste, Annette von") == "Droste"
    assert one(spark, T.surname(F.col("t")), t="Annette von Droste") == "Droste"
    assert one(spark, T.forename(F.col("t")), t="Annette von Droste") == "Annette von"
    assert one(spark, T.strip_particles(F.col("t")), t="Annette von") == "Annette"
    assert one(spark, T.is_author(F.col("t")), t="N.N.") is True and one(spark, T.is_author(F.col("t")), t="Heine") is True
    assert [one(spark, T.is_author(F.col("t")), t=t) for t in ("Anonymus", "anonymous.", "NN.", "..", "Anna", "o.A.")] == [False, False, False, False, True, True]
    assert one(spark, T.forename(F.col("t")), t="Arnim, Bettina, geb. Brentano") == "Bettina, geb. Brentano"
    assert one(spark, T.strip_particles(F.col("t")), t="Joseph v. Von. zu") == "Joseph v."


def test_years(spark):
    assert one(spark, T.year_of_date(F.col("t")), t="ca. 1456") == 1456
    assert one(spark, T.year_of_date(F.col("t")), t="1399") is None
    assert one(spark, T.year_anywhere(F.col("t")), t="nr91850x") == 1850
    assert one(spark, T.year_word(F.col("t")), t="nr91850x 1901.") == 1901


def test_ids_tags_ngrams(spark):
    assert one(spark, T.document_stem(F.col("t")), t="a/b/Doc_012.txt") == "012"
    assert one(spark, T.strip_txt(F.col("t")), t="x.TXT") == "x"
    assert one(spark, T.tag_list(F.col("t")), t="a, ,b ,") == ["a", "b"]
    assert one(spark, T.combine_tags(F.col("a"), F.col("b"), F.col("c")), a=" x", b="", c=None) == "x"
    assert one(spark, T.natural_key(F.col("t")), t="Topic_10") == 10
    assert one(spark, T.ngrams(T.tokens(F.col("t")), 2), t="a b c") == ["a b", "b c"] and one(spark, T.ngrams(T.tokens(F.col("t")), 2), t="a") == []
    assert one(spark, T.metadata_entry(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="Heine", b="Buch", c=None, d="1827") == "Heine: Buch. 1827."


def test_concordance_takes_the_last_hit_within_the_left_context(spark):
    hits = one(spark, T.kwic(F.col("t"), "ab", 4), t="ab ab xxxxxxx ab")
    assert [(h.left, h.match, h.right) for h in hits] == [("ab ", "ab", " xxx"), ("xxx ", "ab", "")]
    assert len(one(spark, T.kwic(F.col("t"), "a.b", 2), t="a.b axb")) == 1
    assert len(one(spark, T.kwic(F.col("t"), "AB", 0, whole_word=True, ignore_case=True), t="ab abc Ab")) == 2
