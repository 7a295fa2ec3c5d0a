import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus as C
from textloom.operators import dtti, matrices, models, names
from textloom.plans import pipeline
from textloom.sources import catalog, markup, tables
from textloom.sources.kept import numbered


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    rows = "".join(f"{i};{1800 + i};Muster;Titel {i};Der Hund und die Katze {i % 3} laufen. Anna kommt Anna{' mit Berta' if i < 2 else ''}!\n" for i in range(8))
    (root / "k.csv").write_text("_id;year;author_surname;title;content\n" + rows, encoding="utf-8")
    (root / "dt.csv").write_text("_id,T0,T1\n" + "".join(f"{i}.txt,{0.1 * i:.1f},{1 - 0.1 * i:.1f}\n" for i in range(8)))
    (root / "tw.csv").write_text("Topic,1,2\nT0,Hund,laufen\nT1,Katze,Hund\n")
    (root / "ts.csv").write_text("tier,tun\nHund,laufen\nKatze,\n")
    (root / "pos.csv").write_text("word,pos,count,tag1,tag2\nHund,NOUN,8,tier,nah\nAnna,PROPN,16,,\nKatze,NOUN,8,tier,\n")
    (root / "names.csv").write_text("term\nAnna\n")
    return root


def _run(spark, root, out, *flags):
    pipeline.main(["k.csv", out, "--project-root", str(root), *flags])
    return lambda name: spark.read.parquet(str(root / out / name))


def test_command_line_steps(spark, project):
    table = _run(spark, project, "a", "--steps", "1", "2", "9", "--w2v-params", '{"vector_size": 3, "min_count": 1, "epochs": 1}')
    assert table("stages").count() == 8 and {len(r.vector) for r in table("vectors").collect()} == {3}


def test_command_line_names(spark, project):
    shape = _run(spark, project, "b", "--steps", "1", "--detect-names")("name_candidates")
    assert shape.columns == ["term", "frequency"] and [tuple(r) for r in shape.collect()] == [("Berta", 2)]  # Anna is in too many documents
    made = _run(spark, project, "c", "--steps", "1", "--detect-names", "--make-pos", "--top-terms", "50")("name_candidates")
    assert ("Anna", 16) in {tuple(r) for r in made.collect()}
    listed = _run(spark, project, "d", "--steps", "--detect-names", "--pos-file", "pos.csv")("name_candidates")
    assert [tuple(r) for r in listed.collect()] == [("Anna", 16)]


def test_command_line_removes_names_from_every_stage(spark, project):
    table = _run(spark, project, "e", "--steps", "1", "2", "5", "--remove-names", "--terms-file", "names.csv")
    stages = table("stages_n").first()
    assert not any("Anna" in stages[c] for c in pipeline.STAGES) and "kommt" in stages["content_gen"]
    assert table("vocabulary").filter("term = 'Anna'").count() and not table("vocabulary_n").filter("term = 'Anna'").count()


def test_command_line_tags(spark, project):
    table = _run(spark, project, "f", "--steps", "1", "--pos-file", "pos.csv")
    assert {tuple(r) for r in table("tagset").collect()} == {("tier", "Hund"), ("nah", "Hund"), ("nah, tier", "Hund"), ("tier", "Katze")}
    assert {(r.tag, r.types, r.tokens) for r in table("tag_frequency").collect()} == {("tier", 2, 16), ("nah", 1, 8)}
    assert table("tag_progress").first().tagged == 2 and table("tagset_sorted").count() == 4
    assert {r.combined for r in table("tfidf_tagged").filter("term = 'Hund'").collect()} == {"tier, nah"}


def test_command_line_topics_and_index(spark, project):
    table = _run(spark, project, "g", "--steps", "--doc-topics", "dt.csv", "--topic-words", "tw.csv", "--termset", "ts.csv")
    assert [(r.topic, r.doc_id) for r in table("top_documents").filter("position = 1").orderBy("topic").collect()] == [("T0", "7"), ("T1", "0")]
    assert table("text_topics").first()["n_topics"] == 2 and table("topics_per_year").count() == 8 and table("text_values").count() == 8
    assert {r.text for r in table("placed").filter("doc_id = '7'").collect()} == {"Muster: Titel 7. 1807. 7"}
    assert table("index").count() == 16 and table("index_top_documents").filter("position = 1").count() == 2
    assert table("position_scores").count() == 4 and table("index_text_values").count() == 8


def test_numbers_run_on_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.n == r.x + 1 for r in numbered(df, "n", "x").collect())
    assert [r.n for r in numbered(df.filter("x < 0"), "n", "x").collect()] == []
    twins = spark.createDataFrame([("b",), ("a",), ("a",)], "content string")
    assert sorted((r.content, r.doc_id) for r in C.with_document_id(twins, ["content"]).collect()) == [("a", "1"), ("a", "2"), ("b", "3")]


def test_names_of_columns(spark):
    assert [c for c in ("Haus", "Author", "autor_x", "x_norm", "GND", "band", "Jahr_final", "Seite") if tables.names_a_term(c)] == ["Haus"]
    assert tables.names_a_term("band", patterns=False) and not tables.names_a_term("Haus", ["haus "])
    wide = spark.createDataFrame([("a", 1850, 2.0, 5)], "doc_id string, date int, wort double, seite int")
    assert tables.term_columns(wide, []) == ["wort"]
    file = spark.createDataFrame([("x", 3)], "`1` string, Topic int")
    assert tables.topic_table(file).columns == ["Topic", "1"] and tables.topic_table(file).first().Topic == "3"


def test_files_of_any_depth(spark, tmp_path):
    for name in ("a/x_tfidf.csv", "a/b/c/tfidf-9.csv", "a/b/tfidf.txt", "other.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    assert [f.rpartition("/")[2] for f in catalog.tfidf_files(spark, str(tmp_path))] == ["tfidf-9.csv", "x_tfidf.csv"]
    assert len(catalog.find_files(spark, str(tmp_path), "a/**/*tfidf*")) == 3 and catalog.find_files(spark, str(tmp_path), "no/**/x") == []


TEI = """<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><fileDesc><publicationStmt><publisher>a@b.de Kolimo Projekt, Weg 1</publisher></publicationStmt></fileDesc>
<profileDesc><date when='1850'/></profileDesc>%s</teiHeader><text><p>x</p></text></TEI>"""
NAMED = "<respStmt><resp>Erfassung der Metadaten</resp><name xml:id='mk'>%s</name></respStmt><revisionDesc><change who='#ab'/></revisionDesc>"


def test_provenance_and_header_paths(spark):
    docs = spark.createDataFrame([(1, TEI % (NAMED % "Maria K")), (2, TEI % (NAMED % "")), (3, TEI % "<revisionDesc><change who=' '/><change who='#ab'/></revisionDesc>"), (4, (TEI % "").replace("Kolimo ", ""))], "doc_id int, xml string")
    rows = markup.tei_provenance(docs).orderBy("doc_id").collect()
    assert [r.xml_creator for r in rows] == ["Maria K", "mk", "ab", ""]
    assert rows[0].project == "Kolimo Projekt" and rows[3].project == "Projekt, Weg 1"
    paths = {r.label: r for r in markup.header_paths(docs).collect()}
    date = paths["teiHeader/profileDesc/date"]
    assert (date.path, date.leaf, date.n, date.probe) == ("tei:teiHeader/tei:profileDesc/tei:date", "date", 4, "1850") and "text/p" not in paths
    assert {r.label for r in markup.header_paths(spark.createDataFrame([("<a><b>x</b></a>",), ("<a>",)], "xml string")).collect()} == {".", "b"}


def test_search_alignment_and_bubbles(spark):
    terms = spark.createDataFrame([("a", 1), ("b", 2)], "term string, n int")
    assert [r.term for r in matrices.only_terms(terms, [" a ", " "]).collect()] == ["a"] and matrices.only_terms(terms, []).count() == 2
    meta = spark.createDataFrame([("x", 1)], "doc_id string, year int")
    assert {tuple(r) for r in matrices.aligned(spark.createDataFrame([("x",), ("y",)], "doc_id string"), meta).collect()} == {("x", 1), ("y", None)}
    grid = spark.createDataFrame([("t", "a", 0.0), ("t", "b", 1.0), ("t", "c", 4.0), ("t", "d", -1.0)], "tag string, topic string, value double")
    assert {r.topic: r.size for r in dtti.bubble_sizes(grid, 10.0, 50.0).collect()} == {"a": 3.0, "b": 20.0, "c": 50.0, "d": 3.0}
    assert [r.size for r in dtti.bubble_sizes(grid.filter("value = 4"), 10.0, 50.0).collect()] == [10.0]


def test_document_limits_of_terms_and_lda(spark):
    corpus = spark.createDataFrame([("a", "aa bb bb cc"), ("b", "aa bb"), ("c", "aa dd")], "doc_id string, content string")
    assert {r.term for r in matrices.dtm(corpus, min_df=2, max_df=0.9).collect()} == {"bb"}
    assert {r.term for r in matrices.dtm(corpus, 1, min_df=2).collect()} == {"aa"}
    doc_topic, words = models.lda(matrices.dtm(corpus), 2, 2, max_iter=2)
    assert {r.doc_id for r in doc_topic.collect()} == {"a", "b", "c"} and words.count() == 4 and {r.pos for r in words.collect()} == {1, 2}
    both = spark.createDataFrame([("a", "Anna x", None), ("b", "y", "Anna")], "doc_id string, content_min string, content_stop string")
    got = {r.doc_id: (r.content_min, r.content_stop) for r in names.stripped(both, spark.createDataFrame([("Anna",)], "term string"), ("content_min", "content_stop")).collect()}
    assert got["a"][0] == "x" and got["b"] == ("y", "")
