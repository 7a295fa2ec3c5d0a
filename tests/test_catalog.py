from textloom.operators import explore, tags
from textloom.plans import params
from textloom.sources.catalog import Catalog, read_interval_files


def test_tables_are_found(spark, tmp_path):
    (tmp_path / "korpus").mkdir()
    (tmp_path / "korpus/metadaten.csv").write_text("_id;year\n7;1850\n")
    (tmp_path / "resources/topic-models/m").mkdir(parents=True)
    (tmp_path / "resources/topic-models/m/m_topic_words.csv").write_text("Topic,1,2\nt0,a,b\n")
    own = tmp_path / "own.csv"
    own.write_text("A;B\nx;y\n;z\n")
    catalog = Catalog(spark, str(tmp_path), {"termset": str(own)})
    assert set(catalog.register()) == {"metadata", "topic_words", "termset"}
    assert spark.sql("select doc_id from metadata").first().doc_id == "7"
    assert {(r.topic, r.pos, r.word) for r in spark.table("topic_words").collect()} == {("t0", 1, "a"), ("t0", 2, "b")}
    assert catalog.table("termset").count() == 3


def test_interval_files(spark, tmp_path):
    for name in ("korpus_gen.csv", "korpus_gen_1800-1850.csv"):
        (tmp_path / name).write_text("id;content_gen\n1;a b\n2;c d\n")
    rows = read_interval_files(spark, str(tmp_path)).collect()
    assert sorted(str(r.interval) for r in rows) == ["1800-1850", "1800-1850", "None", "None"]


def test_parsers():
    assert params.parse_terms(" a, ,b") == ["a", "b"] and params.parse_terms(None) == []
    assert params.parse_years("1780,0–1900.0") == (1780, 1900) and params.parse_years("1900-1780") is None and params.parse_years("x") is None
    assert params.parse_intervals(["1800-1850", "no"]) == [(1800, 1850)]
    assert params.parse_pairs("a b 3\nc;d;0.5\nbad\n") == [("a", "b", 3.0), ("c", "d", 0.5)]
    assert params.root_name("Liste_tagged_v3.csv") == "Liste"
    text = "ein Satz\nnoch einer und " + "x" * 30
    assert list(params.chunks(text, 12)) == ["ein Satz", "noch einer", "und", "x" * 12, "x" * 12, "x" * 6] and list(params.chunks("  ", 5)) == []


def test_topic_names():
    known = {"Topic 3": 1.0, "Natur": 5.0}
    assert params.match_topic("Natur (neu)", set(known)) == "Natur" and params.match_topic("t3", set(known)) == "Topic 3"
    assert params.ranked_topics([("3", 2.0), ("Natur", 1.0), ("x", None)], known, 5) == ["Natur", "Topic 3"]
    assert params.ranked_topics([("zz", 1.0)], known, 1) == ["Natur"]
    assert params.display_columns([("year", True), ("title", False), ("author", False)], ["year"]) == ["year", "title", "author"]


def test_tables_of_tags_and_metadata(spark):
    pos = spark.createDataFrame([("w", "N", None)], "word string, pos string, tag2 string")
    assert tags.with_tag_columns(pos).first().asDict() == {"word": "w", "pos": "N", "tag1": "", "tag2": "", "tag3": ""}
    rows = spark.createDataFrame([("a", 1)], "doc_id string, hit int")
    meta = spark.createDataFrame([("a", "x", 2), ("a", "y", 1)], "doc_id string, title string, o int")
    assert explore.with_metadata(rows, meta, ["title"], "o").first().title == "y"
