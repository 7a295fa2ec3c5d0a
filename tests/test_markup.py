from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from textloom.sources import markup, mend_xml

BROKEN = {
    "unclosed": ("<a><b>x<c>y</a>", "<a><b>x<c>y</c></b></a>"),
    "never ended": ("<a><b>x", "<a><b>x</b></a>"),
    "crossed": ("<a><b>x<i>y</b>z</i></a>", "<a><b>x<i>y</i></b>z</a>"),
    "end without start": ("<a>x</b>y</a>", "<a>xy</a>"),
    "stray ampersand": ("<a k='p & q'>A & B &amp; C &c; &#65; &#x0; &eacute;&nbsp;</a>", '<a k="p &amp; q">A &amp; B &amp; C &amp;c; &#65;  é </a>'),
    "stray less-than": ("<a>1 < 2 <3 <b>x</b></a>", "<a>1 &lt; 2 &lt;3 <b>x</b></a>"),
    "attributes": ("<a k=v n k='w' m=\"it's\"><b checked/></a>", '<a k="v" n="n" m="it\'s"><b checked="checked"/></a>'),
    "tag cut off": ("<a><b k='1' <c>x</c></a>", '<a><b k="1"><c>x</c></b></a>'),
    "unknown prefix": ("<t:a xml:id='i' u:k='v'><t:b>x</t:b></t:a>", '<a xml:id="i" k="v"><b>x</b></a>'),
    "known prefix": ("<t:a xmlns:t='u'><t:b>x</t:a>", '<t:a xmlns:t="u"><t:b>x</t:b></t:a>'),
    "text around, type, second root": ("x <?xml version='1.0'?><!DOCTYPE a [<!ENTITY e 'f'>]><a>y</a> z <b>w</b>", "<a>y z <b>w</b></a>"),
    "forbidden characters": ("<a>x\x00\x0b￾y</a>", "<a>xy</a>"),
    "sections": ("<a><![CDATA[1 < 2 & 3]]><!-- -- <b> --><b>]]></b></a>", "<a>1 &lt; 2 &amp; 3<b>]]&gt;</b></a>"),
}


@pytest.mark.parametrize("kind", BROKEN)
def test_mended(kind):
    broken, good = BROKEN[kind]
    assert mend_xml.mended(broken) == good
    ElementTree.fromstring(good)
    assert mend_xml.mended(good) == good  # stays as it is


def test_well_formed_keeps_its_tree():
    xml = "<a xmlns='u' xmlns:x='v'><!-- c --><b x:k=\"1 &lt; 2\">t&#228;<c/></b>u<d>&amp;</d></a>"
    shape = lambda e: (e.tag, e.attrib, e.text, e.tail, [shape(c) for c in e])
    assert shape(ElementTree.fromstring(mend_xml.mended(xml))) == shape(ElementTree.fromstring(xml))


@pytest.mark.parametrize("part", ["</b>", "<", "&", "<!--", "<![CDATA[", "<b k='1' ", "<b/>"])
def test_long_broken_texts(part):
    ElementTree.fromstring(mend_xml.mended("<a>" + part * 20_000))


TEI = "<TEI><teiHeader><fileDesc><titleStmt><title>T</title><author>{}</author></titleStmt><publicationStmt><authority>Amt</authority></publicationStmt></fileDesc></teiHeader><text><body>x</body></text></TEI>"
AUTHORS = {
    "<surname>Alt</surname><forename>Anna von</forename>": ("Alt", "Anna", True),
    "<surname>Anonymous</surname><forename>X</forename>": (None, None, False),
    "<surname>Alt</surname><persName>Neu, Anna</persName>": ("Neu", "Anna", True),
    "<forename>Anna</forename><persName>Eva Neu</persName>": ("Neu", "Eva", True),
    "<surname>Alt</surname>": ("Alt", None, True),
    "<persName>Joseph von Eichendorff</persName>": ("Eichendorff", "Joseph", True),
    "Unbekannt": (None, None, False),
    "": (None, None, False),
    "<persName><surname>Alt</surname>, <forename>Anna</forename></persName>": ("Alt", "Anna", True),
}


def test_authors_come_whole_from_one_place(spark):
    docs = spark.createDataFrame([(a, TEI.format(a)) for a in AUTHORS], "doc_id string, xml string")
    assert {r.doc_id: (r.author_surname, r.author_prename, r.real_author) for r in markup.tei_metadata(docs).collect()} == AUTHORS
    assert {(r.publisher, r.project) for r in markup.tei_provenance(docs).collect()} == {("Amt", "")}


def test_no_document_is_lost(spark):
    good = TEI.format("<persName>Neu, Anna</persName>")
    docs = spark.createDataFrame([("g", good), ("b", good.replace("</title>", " & Söhne")), ("c", good[:-20]), ("n", "nothing")], "doc_id string, xml string")
    rows = {r.doc_id: r for r in markup.parse_xml(docs).collect()}
    assert {k: r.xml_state for k, r in rows.items()} == {"g": "well-formed", "b": "mended", "c": "mended", "n": "unreadable"}
    assert rows["c"].title == rows["g"].title == "T" and rows["c"].author_surname == "Neu" and rows["b"].title.startswith("T & Söhne")
    assert rows["n"].content is None or rows["n"].content == ""
    paths = {p.path: p.n for p in markup.header_paths(docs.filter(F.col("doc_id") != "n")).collect()}
    assert paths["tei:teiHeader/tei:fileDesc/tei:titleStmt"] == 3
