"""Recovery of broken XML: a tolerant scan of the tags with a stack of open elements.

What is mended: elements that are never closed (closed with the element around them, or at the
end), end tags that cross (the elements inside are closed first) or close nothing (left out),
attributes without quotes or value or given twice, a stray `<` or `&` (text), entities that
XML doesn't know (HTML's are replaced by their characters, others are text), prefixes of
namespaces that nobody declares (left out), characters that XML forbids (left out), text before or
after the document element (left out before it, taken into it after it). A document type is left out.
What has no element at all can't be mended.
"""

from __future__ import annotations

import html
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types

_NAME = r"[^\W\d][\w.\-]*(?::[^\W\d][\w.\-]*)?"
_MARKUP = re.compile(rf"""<!--(.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z](?:[^<>\[]|\[[^\]]*\])*(?:>|\Z)|<(/?)({_NAME})((?:\s+(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^<>]*+))(/?)(?:>|(?=<)|\Z)""", re.S)
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/]+)))?""")
_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][\w.\-]*));|&")
_FORBIDDEN = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_OWN = ("amp", "lt", "gt", "quot", "apos")


def _reference(m: re.Match) -> str:
    """A reference that XML knows; else its character, or the text that stands there."""
    if m[3] in _OWN:
        return m[0]
    if m[3] and m[3] + ";" in html.entities.html5:
        return text(html.entities.html5[m[3] + ";"])
    if m[1] or m[2]:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return m[0] if code < 0x110000 and not _FORBIDDEN.match(chr(code)) else ""
    return "&amp;" + m[0][1:]


def text(raw: str, references: bool = False) -> str:
    """Text as XML; `references` stay references where they are some."""
    raw = _REFERENCE.sub(_reference, raw) if references else raw.replace("&", "&amp;")
    return raw.replace("<", "&lt;").replace("]]>", "]]&gt;")


def mended(xml: str) -> str | None:
    """Well-formed XML with the elements and texts of `xml`, or None if there are no elements."""
    xml = _FORBIDDEN.sub("", xml)
    out: list[str] = []
    stack: list[tuple[str, set[str]]] = []  # names of the open elements, and the prefixes known there
    ended = False  # the end tag of the document element has been met; it is closed at the end of the text

    def local(name: str, known: set[str]) -> str:
        prefix, _, rest = name.rpartition(":")
        return name if not prefix or prefix in known or prefix == "xml" else rest

    def close(depth: int) -> None:
        while len(stack) > depth:
            out.append(f"</{stack.pop()[0]}>")

    def add(raw: str, references: bool = False) -> None:
        if stack and (not ended or raw.strip()):
            out.append(text(raw, references))

    at = 0
    for m in _MARKUP.finditer(xml):
        add(xml[at : m.start()], references=True)
        at = m.end()
        if m[2] is not None:
            add(m[2])
        elif m[4] and m[3]:
            names = [n for n, _ in stack]
            known = stack[-1][1] if stack else set()
            name = local(m[4], known)
            if name in names:
                depth = len(names) - 1 - names[::-1].index(name)
                ended = ended or depth == 0
                close(max(depth, 1))
        elif m[4]:
            given: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(m[5]):
                given.setdefault(a[1], next((v for v in (a[2], a[3], a[4]) if v is not None), a[1]))
            known = (stack[-1][1] if stack else set()) | {k[6:] for k, v in given.items() if k.startswith("xmlns:") and v}
            plain: dict[str, str] = {}
            for k, v in given.items():
                if k == "xmlns" or (k.startswith("xmlns:") and v and k not in ("xmlns:xml", "xmlns:xmlns")):
                    plain.setdefault(k, v)
                elif not k.startswith("xmlns"):
                    plain.setdefault(local(k, known), v)
            own = "".join(f' {k}="{text(v, references=True).replace(chr(34), "&quot;")}"' for k, v in plain.items())
            name = local(m[4], known)
            empty = m[6] or m[5].rstrip().endswith("/")
            out.append(f"<{name}{own}/>" if empty and stack else f"<{name}{own}>")
            if not (empty and stack):
                stack.append((name, known))
    add(xml[at:], references=True)
    if not out:
        return None
    close(0)
    return "".join(out)


@F.pandas_udf(types.StructType([types.StructField("xml", types.StringType()), types.StructField("state", types.StringType())]))
def recovered(xml: pd.Series) -> pd.DataFrame:
    """(xml, state): well-formed documents as they are (`well-formed`), others mended (`mended`) or null (`unreadable`)."""

    def one(x: str | None) -> tuple[str | None, str]:
        for candidate, state in ((lambda: x, "well-formed"), (lambda: mended(x or ""), "mended")):
            try:
                found = candidate()
                if found is not None:
                    ElementTree.fromstring(found)
                    return found, state
            except (ElementTree.ParseError, ValueError):
                pass
        return None, "unreadable"

    return pd.DataFrame([one(x) for x in xml], columns=["xml", "state"])
