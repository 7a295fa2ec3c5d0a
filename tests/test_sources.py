import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import matrices
from textloom.plans import pipeline
from textloom.sources import markup, sinks, tables


@pytest.mark.parametrize("sep", [";", ",", "\t", "|"])
def test_delimiters(sep):
    rows = [["id", "title", "content"], ["1", "a", '"x, y; z\nnew line"'], ["2", "b", '"quote ""in"""']]
    assert tables.detect_delimiter("\n".join(sep.join(r) for r in rows)) == sep


def test_delimiter_of_odd_samples():
    assert tables.detect_delimiter('id;text\n1;"a, b, c"\n2;"d, e;\nf, g"\n') == ";"
    assert tables.detect_delimiter("id,text") == ","  # one record only: csv's own guess
    assert tables.detect_delimiter("") == ";" and tables.detect_delimiter("word\nword\n") == ";"
    assert tables.detect_delimiter("a;b,c\nd;e,f\n") == ";"  # equals go by the order in which they are tried


def test_csv_with_line_feeds(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text('﻿ id ;content\n1;"zwei\nZeilen; hier"\n2;"ein ""Wort"""\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(path)).collect()
    assert rows[0].asDict() == {"id": "1", "content": "zwei\nZeilen; hier"} and rows[1].content == 'ein "Wort"'
    assert tables.read_corpus_csv(spark, str(path)).columns == ["id", "content"]


def test_texts_of_any_encoding(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("für".encode("utf-8-sig"))
    (tmp_path / "t/b.txt").write_bytes("für".encode("latin-1"))
    assert {r.file_name: r.text for r in tables.read_texts(spark, str(tmp_path / "t")).collect()} == {"a.txt": "für", "b.txt": "für"}


def test_wide_tables(spark):
    dt = spark.createDataFrame([("x.txt", "0.25", "0.75")], "_id string, T1 string, T2 string")
    assert {tuple(r) for r in tables.document_topics(dt, strip_txt=True).collect()} == {("x", "T1", 0.25), ("x", "T2", 0.75)}
    tw = spark.createDataFrame([("t", " a ", "b")], "Topic string, `1` string, `2` string")
    assert {tuple(r) for r in tables.topic_words(tw).collect()} == {("t", 1, "a"), ("t", 2, "b")}
    ts = spark.createDataFrame([("Haus (alt)", "x"), (None, "y"), ("Hof", "")], "A string, B string").coalesce(1)
    assert [tuple(r) for r in tables.termset(ts).orderBy("tag", "ord").collect()] == [("A", 1, "Haus"), ("A", 2, "Hof"), ("B", 1, "x"), ("B", 2, "y")]
    wide = spark.createDataFrame([("d", "1.5", "x"), ("e", "2", "y")], "doc_id string, wort string, titel string")
    assert tables.term_columns(wide, ["doc_id"]) == ["wort"]
    assert tables.tfidf_totals(wide, ["wort"]).first().total == 3.5


def test_mallet(spark):
    lines = spark.createDataFrame([("#doc name",), ("0\td1\t0.5\t0.5\t1.0",), ("1 d2 2 0.25 0 0.75 ",)], "value string")
    got = {(r.doc_id, r.topic): r.weight for r in tables.mallet_document_topics(lines, 3).collect()}
    assert got == {("d1", 0): 0.25, ("d1", 1): 0.25, ("d1", 2): 0.5, ("d2", 2): 0.25, ("d2", 0): 0.75}
    keys = spark.createDataFrame([("0\t5.0\tbär  tier ",), ("1 5.0 baum",)], "value string")
    assert {tuple(r) for r in tables.mallet_topic_keys(keys).collect()} == {(0, 1, "bär"), (0, 2, "tier"), (1, 1, "baum")}


def test_rules_apply_in_order(spark):
    df = spark.createDataFrame([("that sz ab12",), (None,)], "t string")
    rules = [("th", "t"), ("tat", "x"), (r"(?<=s)z\b", "s"), (r"\d+", ""), ("(", "never"), (r"[", "x")]
    assert [r.t for r in df.select(tables.replace_all(F.col("t"), rules).alias("t")).collect()] == ["x ss ab", None]
    assert tables.is_pattern(r"a\b") and tables.is_pattern("^a") and not tables.is_pattern("a.b") and not tables.is_pattern("thät")


def test_lists(tmp_path):
    (tmp_path / "w.txt").write_text("Und\n\n der \n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("n;term\n1;Anna\n", encoding="utf-8")
    assert tables.load_words(str(tmp_path / "w.txt")) == ["und", "der"] and tables.load_words(str(tmp_path / "no")) == []
    assert tables.load_words(str(tmp_path / "c.csv"), lower=False) == ["Anna"]
    (tmp_path / "p.toml").write_text("[a]\nb = 1\n")
    assert tables.load_config(str(tmp_path / "p.toml")) == {"a": {"b": 1}}


TEI = """<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><fileDesc><titleStmt><title type='sub'>S</title><title type='main'>Das  Buch</title>
<author><persName>Droste, Annette von</persName></author></titleStmt><publicationStmt><publisher>Haus</publisher></publicationStmt>
<sourceDesc><bibl><date>ca. 1856</date></bibl></sourceDesc></fileDesc></teiHeader><text><body><head>Kopf</head>Rest <p>Satz</p></body></text></TEI>"""


def test_tei(spark):
    docs = spark.createDataFrame([("d", TEI), ("bad", "a < b"), ("none", None)], "doc_id string, xml string")
    r, bad, none = markup.parse_xml(docs).orderBy(F.desc("xml_state"), "doc_id").collect()
    assert (bad.doc_id, bad.xml_state, bad.title, none.doc_id, none.xml_state) == ("bad", "unreadable", None, "none", "unreadable")
    assert (r.doc_id, r.title, r.author_surname, r.author_prename, r.year, r.first_publication_year, r.real_author) == ("d", "Das Buch", "Droste", "Annette", 1856, None, True)
    assert r.content == "Rest Satz"
    assert markup.tei_provenance(docs.filter("doc_id = 'd'")).first().publisher == "Haus"
    paths = {p.path for p in markup.discover_paths(docs).collect()}
    assert "TEI/text/body/head" in paths and "TEI/teiHeader/fileDesc/titleStmt/title/@type" in paths


def test_html(spark):
    df = spark.createDataFrame([("<html><title>T &amp; x</title><style>p{}</style><body><p>a<b>b</b><p>c<script>var t='</p>'</script></html>",), (None,)], "h string")
    rows = [r.x for r in df.select(markup.html_text("h").alias("x")).collect()]
    assert (rows[0].title, rows[0].content) == ("T & x", "ab\nc") and rows[1].content == ""


def test_sinks(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x y y"), ("b", "y")], "doc_id string, content string")
    sinks.write_vocabulary(matrices.term_counts(corpus), "min", str(tmp_path / "v"))
    got = json.loads(spark.read.text(str(tmp_path / "v")).first().value)
    assert got["vocabulary_size"] == 2 and got["total_tokens"] == 4 and got["full_vocab"] == {"x": 1, "y": 3} and got["top_words"][0] == ["y", 3]
    assert [tuple(r) for r in tables.read_vocabulary(spark, str(tmp_path / "v"), 1).collect()] == [("y", 3, 1)]
    sinks.write_matrix(matrices.dtm(spark.createDataFrame([("a", "xx yy"), ("b", "!")], "doc_id string, content string")), ["xx", "yy"], "tf", corpus.select("doc_id"), str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()} == {("a", "1", "1"), ("b", "0", "0")}
    wide = spark.createDataFrame([("d", 0.1, 0.9)], "doc_id string, `0` double, `1` double")
    assert sinks.renamed_topics(wide, ["Natur"]).columns == ["doc_id", "Natur", "1"]
    assert sinks.safe_name("a/b: c") == "a_b__c" and sinks.next_version("m", ["m_v1", "m_v3", "x_v9"]) == "m_v4"
    assert sinks.ensure_output(None, spark, "a int").columns == ["a"]


def test_project_runs_its_steps(spark):
    rows = [(str(i), f"Der Hund und die Katze {i % 3} laufen. Anna Anna kommt!", 1800 + i, "g", "t") for i in range(12)]
    corpus = spark.createDataFrame(rows, "doc_id string, content string, year int, genre string, textclass string")
    settings = pipeline.Settings(rules=[(r"\d+", "")], stopwords=["der", "die", "und"], intervals=[(1800, 1805)], sizes=(20,), min_cosine=0.9, word2vec={"vector_size": 4, "window": 2, "min_count": 1, "epochs": 1, "seed": 1})
    project = pipeline.Project(spark, corpus, settings)
    made = project.run(["1", "2", "4", "5", "6", "7", "8", "9"])
    assert made["stages"].filter("doc_id = '0'").first().content_stop == "Hund Katze laufen Anna Anna kommt"
    assert {"vocabulary", "dtm_20", "tfidf_20", "cosine", "interval_tfidf", "document_rank", "vectors"} <= set(made)
    assert made["interval_tfidf"].select("doc_id").distinct().count() == 6 and made["vectors"].count() > 0
    again = project.without(spark.createDataFrame([("Anna",)], "term string")).run(["2"])
    assert again["vocabulary"].filter("term = 'Anna'").count() == 0
    assert pipeline.parse_interval("1800-1805") == (1800, 1805)
