"""Main text of web pages as the maximum-scoring contiguous run of a page's tokens.

A page is scanned once into items: tags, the words between them with their context (the nearest
block element, its first class, whether in a link), and one item for each whole subtree that is
boilerplate by its element, role or class names (BOILERPLATE, CLASSES). Weights come from labelled
pages: pages with exactly one `article` element, whose content is the label. A context's words weigh
the log-odds of lying in the content, smoothed by a prior that holds where no labelled page has the
context. A tag weighs -log(1 + odds of lying outside), so never more than zero; the tags
`article` themselves always lie outside of the content they enclose. A boilerplate subtree
weighs SUBTREE and is never part of the text. One linear scan finds the run of items with the
greatest sum; all words in it are the text. A page that has no `article` is scanned the same way
and by the same weights.

Counts are summed per task and then by key; the weights of keys met on MIN_PAGES labelled
pages or more are collected (at most MAX_LABELLED pages are read for them, chosen by the hash of
page_id and url) and sent to all tasks. Pages themselves are read where they are and never
shuffled.

Rows: a null or empty html, and a page without words that score, have the empty text. Each row
is extracted for itself, repeated ones too. Other columns, of any name but `text` and `n_chars`, which are
replaced, pass through. Without labelled pages the priors decide. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import byte_slices
from .common import table

#: Labelled pages that the weights are learnt from, at most (in expectation, where there are more).
MAX_LABELLED = 20_000
MIN_PAGES = 3
#: Words and tags that a prior counts for, the largest weight of a word, that of a tag outside of all content, and that of a boilerplate subtree.
PRIOR_WORDS, PRIOR_TAGS, MOST_WORD, LEAST_TAG, SUBTREE = 50, 5, 3.0, -2.0, -1.0

#: Elements whose content is no text of the page, and those whose content isn't markup.
BOILERPLATE = frozenset("head nav aside footer header form menu dialog button select textarea template noscript iframe object canvas audio video svg".split())
RAW = frozenset("script style title textarea xmp iframe noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids that mark boilerplate.
CLASSES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification newsletter subscribe subscription signup login comment comments commentlist respond disqus reply replies share sharing social related "
    "recommended recommendations popup modal overlay widget pagination pager toolbar copyright legal disclaimer skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
CONTAINERS = CONTENT | frozenset("html body center div section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = HEADINGS | CONTENT | BOILERPLATE | frozenset("address blockquote body caption center dd details div dl dt fieldset figcaption figure html legend li ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What opening an element closes, and where the search for it ends; a block closes an open paragraph.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CONTENT_TAG = r"(?is)<article[\s>]"


def names_of(value: str) -> list[str]:
    """Words of a class list or an id, in lower case: "pageHeader main-nav" has page, header, main, nav."""
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def is_boilerplate(name: str, own: dict[str, str]) -> bool:
    if name in BOILERPLATE or own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    return name not in HEADINGS and name not in ("html", "body", "main") and not CLASSES.isdisjoint(names_of(own.get("class", "") + " " + own.get("id", "")))


class Scan:
    """The items of a page: `keys`, and `texts` of those that are words (None for tags and boilerplate)."""

    def __init__(self, page: str):
        self.keys: list[str] = []
        self.texts: list[str | None] = []
        self.stack: list[list] = []  # name, boilerplate, context
        self.open = Counter()
        self.hidden = 0
        at = 0
        while m := _MARKUP.search(page, at):
            self.words(page[at : m.start()])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self.close(name)
                else:
                    self.start(name, m[3])
                    if name in RAW:
                        end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                        at = end.start() if end else len(page)
        self.words(page[at:])

    def add(self, key: str, text: str | None = None) -> None:
        self.keys.append(key)
        self.texts.append(text)

    def words(self, raw: str) -> None:
        if self.hidden or not raw:
            return
        if raw.isspace():
            self.add(" ", " ")
            return
        context = next((e[2] for e in reversed(self.stack) if e[2]), "body")
        self.add(context + (">a" if self.open["a"] else ""), references.unescape(raw) if "&" in raw else raw)

    def start(self, name: str, raw: str) -> None:
        if name in CONTENT and self.hidden:  # what holds the content is no boilerplate, whatever its name
            for e in self.stack:
                e[1] = e[1] and e[0] in BOILERPLATE - {"form", "header"}
            self.hidden = sum(e[1] for e in self.stack)
        if name in CLOSES:
            self.end_open(*CLOSES[name])
        elif name in BLOCKS:
            self.end_open(("p",), BLOCKS)
        own = attributes(raw) if raw and not raw.isspace() else {}
        if name in VOID:
            if not self.hidden:
                self.add("<" + name)
            return
        if not self.hidden:
            self.add("<" + name)
        drop = is_boilerplate(name, own)
        if name == "header" and any(self.open[n] for n in CONTENT):
            drop = False  # an article's own heading
        if drop and not self.hidden:
            self.keys[-1] = "-"
        context = ""
        if name in BLOCKS:
            first = re.sub(r"\d+", "", own.get("class", "").split()[0]) if own.get("class", "").strip() else ""
            context = f"{name}.{first.lower()}" if first else name
        self.stack.append([name, drop, context])
        self.open[name] += 1
        self.hidden += drop

    def end_open(self, names: tuple, until) -> None:
        """Ends the last open element of these names, if none of `until` stands above it."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                self.pop_to(i)
                return
            if self.stack[i][0] in until:
                return

    def close(self, name: str) -> None:
        if self.open[name]:
            i = len(self.stack) - 1
            while self.stack[i][0] != name:
                i -= 1
            self.pop_to(i)
        if not self.hidden:
            self.add("</" + name)

    def pop_to(self, i: int) -> None:
        for name, drop, _ in self.stack[i:]:
            self.open[name] -= 1
            self.hidden -= drop
        del self.stack[i:]


def separates(key: str) -> bool:
    """Whether a tag parts words: a block's, a line break or a boilerplate subtree; those of phrases don't."""
    return key == "-" or key.lstrip("</") in BLOCKS or key in ("<br", "<hr")


def prior(key: str) -> float:
    """Share of a context's words, or of a tag, that lies in the content, before any page is seen."""
    name = key.lstrip("</").split(".")[0]
    if key.startswith("<"):
        return 0.5 if name in CONTAINERS else 0.95
    if key.endswith(">a"):
        return 0.3
    return 0.9 if name in HEADINGS or name in ("p", "blockquote", "pre", "figcaption", "article", "main") else 0.65


def counts_of(page: str) -> dict[str, tuple[int, int]]:
    """(inside, outside) of each key of a labelled page: words of a context, or tags."""
    scan = Scan(page)
    first = scan.keys.index("<article") if "<article" in scan.keys else len(scan.keys)
    last = len(scan.keys) - 1 - scan.keys[::-1].index("</article") if "</article" in scan.keys else len(scan.keys)
    found: dict[str, list[int]] = {}
    for i, (key, text) in enumerate(zip(scan.keys, scan.texts, strict=True)):
        if key not in (" ", "-"):
            found.setdefault(key, [0, 0])[not first < i < last] += 1 if text is None else len(text.split())
    return {k: (a, b) for k, (a, b) in found.items()}


class Weights:
    """Weights of items by key; `counts` are (inside, outside) of labelled pages."""

    def __init__(self, counts: dict[str, tuple[int, int]] | None = None):
        self.known = {k: self.weigh(k, *v) for k, v in (counts or {}).items()}

    @staticmethod
    def weigh(key: str, inside: int, outside: int) -> float:
        share = prior(key)
        if key.startswith("<"):
            least = -math.inf if key.lstrip("</") == "article" else LEAST_TAG
            return max(least, -math.log1p((outside + PRIOR_TAGS * (1 - share)) / (inside + PRIOR_TAGS * share)))
        odds = math.log((inside + PRIOR_WORDS * share) / (outside + PRIOR_WORDS * (1 - share)))
        return max(-MOST_WORD, min(MOST_WORD, odds))

    def __getitem__(self, key: str) -> float:
        if key not in self.known:
            self.known[key] = 0.0 if key == " " else SUBTREE if key == "-" else self.weigh(key, 0, 0)
        return self.known[key]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum; the first, and the shortest, of equals. (0, 0) if no sum is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    scan = Scan(page)
    scores = [weights[k] * (1 if t is None else len(t.split())) for k, t in zip(scan.keys, scan.texts, strict=True)]
    start, end = best_run(scores)
    parts = [t if t is not None else " " if separates(k) else "" for k, t in zip(scan.keys[start:end], scan.texts[start:end], strict=True)]
    return " ".join("".join(parts).split())


def learn(pages: DataFrame) -> Weights:
    """Weights from the labelled pages (page_id, url, html)."""
    labelled = pages.filter(F.regexp_count("html", F.lit(_CONTENT_TAG)) == 1)
    n = labelled.count()
    if n > MAX_LABELLED:
        labelled = labelled.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(n)) < MAX_LABELLED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside, seen = Counter(), Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                for key, (a, b) in counts_of(page.as_py()).items():
                    inside[key] += a
                    outside[key] += b
                    seen[key] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (inside, outside, seen)]], names=["key", "inside", "outside", "pages"])

    rows = labelled.select("html").mapInArrow(count, "key string, inside long, outside long, pages long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "pages")])
    return Weights({r.key: (r.inside, r.outside) for r in rows.filter(F.col("pages") >= MIN_PAGES).collect()})


def main_text(pages: DataFrame, weights: Weights | None = None, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all, if None), `text` and `n_chars`. Weights are learnt from the pages themselves unless given; that takes page_id, url and html."""
    weights = weights or learn(pages)
    known = dict(weights.known)
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights()
        own.known.update(known)
        for batch in batches:
            for at, n in byte_slices(batch.column(batch.num_columns - 1), 2_000_000):
                part = batch.slice(at, n)
                texts = [extract(p, own) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])
