"""TEI and HTML documents.

XML goes through Spark's XPath, which ignores namespaces, so paths have no prefix; broken XML is
mended first. HTML goes through Python's parser in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from .mend_xml import mended, recovered

_HEADER = "//teiHeader"
#: Where titles, the work's author, dates and origins stand, in the order in which they are tried.
TITLES = [f"{_HEADER}//fileDesc//titleStmt//title[@type='main']", f"{_HEADER}//fileDesc//titleStmt//title", f"{_HEADER}//sourceDesc//biblFull//titleStmt//title[@type='main']", f"{_HEADER}//sourceDesc//biblFull//titleStmt//title", f"{_HEADER}//titleStmt//title"]
AUTHOR = f"{_HEADER}//fileDesc//titleStmt/author"
FIRST_DATES = [f"{_HEADER}//date[@type='firstPublication']", f"{_HEADER}//creation//date[@type='OriginalSourcePublication']", f"{_HEADER}//profileDesc//creation//date[@when]"]
SPAN_DATES = [f"{_HEADER}//profileDesc//creation//date[@notBefore or @notAfter]"]
SOURCE_DATES = [f"{_HEADER}//sourceDesc//biblFull//publicationStmt//date", f"{_HEADER}//sourceDesc//bibl//date"]
#: What marks the project's name in a publisher, and who entered the metadata; attributes that hold a value.
PROJECT, ENTERED = "kolimo", "Erfassung der Metadaten"
VALUE_ATTRIBUTES = ("when", "notBefore", "notAfter", "from", "to", "value", "key", "ref", "n")


def _all(xml: Column, path: str) -> Column:
    """Texts below the nodes of a path, joined."""
    return T.normalize_ws(F.array_join(F.xpath(xml, F.lit(f"({path})[1]//text()")), " "))


def _first(xml: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.nullif(_all(xml, p), F.lit("")) for p in paths])


def _year(xml: Column, paths: list[str]) -> Column:
    """Year of the first date that has one in an attribute or its text."""
    found = []
    for p in paths:
        parts = [F.array_join(F.xpath(xml, F.lit(f"({p})[1]/@{a}")), " ") for a in ("when", "notBefore", "notAfter")]
        found.append(T.year_of_date(F.concat_ws(" ", *parts, _all(xml, p))))
    return F.coalesce(*found)


def tei_metadata(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs with title, author_surname, author_prename, year, first_publication_year, real_author.

    Both names come of the elements for them if both are filled, else both of the person's
    name as it stands. Who isn't a real author has no name.
    """
    x = F.col(xml)
    parts = [_first(x, [f"{AUTHOR}//{n}"]) for n in ("surname", "forename")]
    person = _first(x, [f"{AUTHOR}//persName", AUTHOR])
    both = parts[0].isNotNull() & parts[1].isNotNull()
    surname = F.when(both | person.isNull(), parts[0]).otherwise(T.surname(person))
    forename = F.when(both, T.strip_particles(parts[1])).when(person.isNull(), parts[1]).otherwise(T.strip_particles(T.forename(person)))
    first = F.coalesce(_year(x, FIRST_DATES), _year(x, SPAN_DATES))
    found = docs.withColumns({"title": _first(x, TITLES), "author_surname": surname, "author_prename": F.nullif(forename, F.lit("")), "first_publication_year": first, "year": F.coalesce(first, _year(x, SOURCE_DATES))})
    found = found.withColumn("real_author", T.is_author(F.concat_ws(" ", "author_surname", "author_prename")))
    return found.withColumns({n: F.when(F.col("real_author"), F.col(n)) for n in ("author_surname", "author_prename")})


def tei_provenance(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs with publisher, project (the publisher's name without mail and postal addresses), licence and xml_creator (who entered the metadata: a name, else its id, else who made the first change that names someone)."""
    x = F.col(xml)
    of_project = _first(x, [f"{_HEADER}//fileDesc//publicationStmt//publisher"])
    publisher = F.coalesce(of_project, _first(x, [f"{_HEADER}//fileDesc//publicationStmt//authority"]))
    at = F.locate(PROJECT, F.lower(of_project))
    named = F.regexp_replace(F.substr(of_project, at), r"^(.+?)(?: Seminar| Käthe|,).*$", "$1")
    plain = F.array_join(F.filter(F.split(of_project, " "), lambda w: ~F.contains(w, F.lit("@"))), " ")
    entered = f"//respStmt[resp[contains(., '{ENTERED}')]]/name"
    by_id = F.try_element_at(F.xpath(x, F.lit(f"{entered}/@*[name()='xml:id']")), F.lit(1))
    changed = F.try_element_at(F.filter(F.transform(F.xpath(x, F.lit("//revisionDesc//change/@who")), lambda w: F.trim(F.ltrim(w, F.lit("#")))), lambda w: w != ""), F.lit(1))
    licence = _first(x, [f"{_HEADER}//availability//licence", f"{_HEADER}//availability"])
    creator = F.coalesce(F.nullif(_all(x, entered), F.lit("")), by_id, changed, F.lit(""))
    return docs.withColumns({"publisher": publisher, "project": F.trim(F.coalesce(F.when(at > 0, named).otherwise(plain), F.lit(""))), "licence": licence, "xml_creator": creator})


def tei_text(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs with `content`: the text of the body without headings; what follows a heading stays."""
    body = F.xpath(F.col(xml), F.lit("//text//body//text()[not(ancestor::head)]"))
    return docs.withColumn("content", T.normalize_ws(F.array_join(body, " ")))


def parse_xml(docs: DataFrame, xml: str = "xml", id_: str = "doc_id") -> DataFrame:
    """(id, content, metadata, xml_state) of all documents; broken ones are mended, of unreadable ones only id and state are known. The id is xml:id of the root where there is one."""
    read = docs.withColumn("__read", recovered(F.col(xml))).withColumns({xml: F.col("__read.xml"), "xml_state": F.col("__read.state")}).drop("__read")
    own = F.try_element_at(F.xpath(F.col(xml), F.lit("/*/@*[name()='xml:id']")), F.lit(1))
    return tei_text(tei_metadata(read, xml), xml).withColumn(id_, F.coalesce(own, F.col(id_))).drop(xml)


def discover_paths(docs: DataFrame, xml: str = "xml", most: int = 400, files: int = 25) -> DataFrame:
    """(path, n, probe): the tag chains with text or attributes in up to `files` documents, the commonest first. A report; it looks at so many documents only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            probe: dict[str, str] = {}
            for x in batch[xml]:
                if (root := _root(x)) is None:
                    continue
                stack = [(root, root.tag.rpartition("}")[2])]
                while stack:
                    node, path = stack.pop()
                    values = {path: (node.text or "").strip()} | {f"{path}/@{k.rpartition('}')[2]}": v for k, v in node.attrib.items()}
                    for p, v in values.items():
                        if v:
                            counts[p] += 1
                            probe.setdefault(p, v[:80])
                    stack += [(c, f"{path}/{c.tag.rpartition('}')[2]}") for c in node if isinstance(c.tag, str)]
            yield pd.DataFrame({"path": list(counts), "n": list(counts.values()), "probe": [probe[p] for p in counts]})

    found = docs.select(xml).limit(files).mapInPandas(run, "path string, n long, probe string")
    return found.groupBy("path").agg(F.sum("n").alias("n"), F.min("probe").alias("probe")).orderBy(F.desc("n"), "path").limit(most)


def header_paths(docs: DataFrame, xml: str = "xml", prefix: str = "tei:", most: int = 400, files: int = 25) -> DataFrame:
    """(path, leaf, label, n, probe): the elements of the headers (of whole documents where there is no header) that hold text or a value, below the root, of up to `files` documents. label is the path and leaf its end, both without prefix; probe the least of the first texts found. A report; it looks at so many documents only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch[xml]:
                if (root := _root(x)) is None:
                    continue
                seen: dict[str, str] = {}
                stack, inside = [(root, (), False)], any(_local(e) == "teiHeader" for e in root.iter())
                while stack:
                    node, path, counted = stack.pop()
                    counted = counted or not inside or _local(node) == "teiHeader"
                    value = " ".join("".join(node.itertext()).split()) or next((v.strip() for a in VALUE_ATTRIBUTES if (v := node.get(a)) and v.strip()), "")
                    if counted and value:
                        seen.setdefault("/".join(path) or ".", value[:120])
                    stack += [(c, (*path, _local(c)), counted) for c in reversed(node) if isinstance(c.tag, str)]
                rows += seen.items()
            yield pd.DataFrame(rows, columns=["label", "probe"])

    found = docs.select(xml).limit(files).mapInPandas(run, "label string, probe string").groupBy("label").agg(F.count("*").alias("n"), F.min("probe").alias("probe"))
    steps = F.split("label", "/")
    path = F.when(F.col("label") == ".", ".").otherwise(F.array_join(F.transform(steps, lambda s: F.concat(F.lit(prefix), s)), "/"))
    return found.select(path.alias("path"), F.element_at(steps, -1).alias("leaf"), "label", "n", "probe").orderBy(F.desc("n"), "label").limit(most)


def _root(xml: str | None) -> ElementTree.Element | None:
    """The root of a document, mended if need be; None where nothing can be read."""
    for candidate in (xml or "", mended(xml or "")):
        try:
            return ElementTree.fromstring(candidate or "")
        except ElementTree.ParseError:
            continue
    return None


def _local(node: ElementTree.Element) -> str:
    """An element's name without its namespace; comments and instructions have none."""
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


class _Text(HTMLParser):
    """Title and visible text."""

    SKIP = {"script", "style", "noscript", "template"}
    BLOCK = {"p", "div", "li", "ul", "ol", "br", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.in_title, self.title, self.parts = 0, False, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipped += tag in self.SKIP
        self.in_title = tag == "title"
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skipped = max(0, self.skipped - (tag in self.SKIP))
        self.in_title = False
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self.parts.append(data)


@F.pandas_udf(types.StructType([types.StructField("title", types.StringType()), types.StructField("content", types.StringType())]))
def html_text(html: pd.Series) -> pd.DataFrame:
    rows = []
    for x in html:
        parser = _Text()
        parser.feed(x or "")
        parser.close()
        lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
        rows.append((" ".join("".join(parser.title).split()), "\n".join(line for line in lines if line)))
    return pd.DataFrame(rows, columns=["title", "content"])
