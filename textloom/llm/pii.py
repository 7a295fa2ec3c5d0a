"""Personal data: patterns, and information-theoretic sanitisation of the words around them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each mention
of such an entity has the words next to it as its context. Over the whole corpus, a word t
that stands in a share of the distinct contexts of an entity e, and in another share of the
corpus, discloses e by the pointwise mutual information log(p(t | e) / p(t)); where that is
at least DISCLOSURE times the information content -log p(e) of the entity, the word is a span
of kind `term` wherever it stands in a context of e. Contexts that are equal count once, so
copies of one passage are no evidence; a word needs MIN_CONTEXTS of them.

`sanitised` replaces base spans by their kind, generalises disclosing words to `[TERM]` and
removes disclosing numbers.

Rows: a null text counts as empty and has no spans. Every row gets a result of its own, also
repeated ones and those with a null doc_id. An empty table gives an empty result; columns
other than doc_id and text play no part. Texts are scanned in linear time whatever they hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small, tagged, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a mention that are its context.
WORDS = 6
#: Characters in which they are looked for first; where these hold fewer, four times as many.
REACH = 160
MIN_CONTEXTS = 2
DISCLOSURE = 0.5
#: Context words of fewer letters don't count.
MIN_LETTERS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: what fails there fails further on too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"\w+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS), in that order."""
    out = [(a, b, 0) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _words(text: str, low: int, high: int) -> list[tuple[str, int, int]]:
    """Whole words in text[low:high], lower-cased, with their places; words that go beyond it are left out."""
    out = []
    for m in _WORD.finditer(text, low, high):
        a, b = m.span()
        cut_off = (a == low and low > 0 and _WORD.match(text[a - 1])) or (b == high and high < len(text) and _WORD.match(text[b]))
        if not cut_off:
            out.append((m[0].lower(), a, b))
    return out


def _beside(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The WORDS words before and after text[start:end], however far away they are."""
    before, after = [], []
    reach = REACH
    while len(before) < WORDS:
        low = max(0, start - reach)
        before = _words(text, low, start)[-WORDS:]
        if not low:
            break
        reach *= 4
    reach = REACH
    while len(after) < WORDS:
        high = min(len(text), end + reach)
        after = _words(text, end, high)[:WORDS]
        if high == len(text):
            break
        reach *= 4
    return before + after


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each base span its entity, its context and the context's words outside of all spans."""
    out = []
    for n, (start, end, kind) in enumerate(spans):
        value = text[start:end]
        value = value.lower() if kind < 2 else _DIGITS.sub("", value)
        near = _beside(text, start, end)
        around = spans[max(0, n - 2 * WORDS) : n + 2 * WORDS + 1]
        near = [w for w in near if not any(w[1] < b and a < w[2] for a, b, _ in around)]
        words = [w for w in near if len(w[0]) >= MIN_LETTERS]
        out.append({"e": xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}".encode()) - (1 << 63), "c": xxhash.xxh64_intdigest(" ".join(w for w, _, _ in near).encode()) - (1 << 63), "t": [{"w": w, "a": a, "b": b} for w, a, b in words]})
    return out


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)


_FOUND = "doc_id long, tag long, n_email long, n_ip long, n_card long, n_phone long, n_words long, base_sha256 string, base string, m array<struct<e:long,c:long,t:array<struct<w:string,a:int,b:int>>>>"
_FOUND_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("doc_id", "tag", "n_email", "n_ip", "n_card", "n_phone", "n_words")],
    ("base_sha256", pa.string()),
    ("base", pa.string()),
    ("m", pa.list_(pa.struct([("e", pa.int64()), ("c", pa.int64()), ("t", pa.list_(pa.struct([("w", pa.string()), ("a", pa.int32()), ("b", pa.int32())])))]))),
])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part, rows = batch.slice(i, 256), []
            for doc_id, tag, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                spans = base_spans(text)
                base = joined(spans)
                n = [sum(k == kind for _, _, k in spans) for kind in range(4)]
                rows.append({"doc_id": doc_id, "tag": tag, "n_email": n[0], "n_ip": n[1], "n_card": n[2], "n_phone": n[3], "n_words": len(text.split()), "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "base": base, "m": mentions(text, spans)})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)


def disclosing(found: DataFrame, texts: DataFrame, ratio: float = DISCLOSURE) -> DataFrame:
    """(e, w) of the words that disclose an entity. found: as `_find` gives it; texts: the column text of the corpus."""
    each = found.select(F.explode("m").alias("m")).select(F.col("m.e").alias("e"), F.col("m.c").alias("c"), F.array_distinct(F.transform("m.t", lambda t: t["w"])).alias("ws"))
    contexts = cut(each.groupBy("e", "c").agg(F.first("ws").alias("ws")))
    of_entity = contexts.groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= MIN_CONTEXTS)
    pairs = contexts.select("e", F.explode("ws").alias("w")).groupBy("e", "w").agg(F.count("*").alias("n_ew")).filter(F.col("n_ew") >= MIN_CONTEXTS)
    pairs = cut(pairs.join(of_entity, "e"))
    wanted = cut(pairs.select("w").distinct())
    if not wanted.limit(1).count():
        return pairs.select("e", "w")
    totals = found.agg(F.sum("n_words").alias("words")).crossJoin(contexts.agg(F.count("*").alias("contexts")))  # one row
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text_of()), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    counts = words.join(small(wanted), "w").groupBy("w").agg(F.count("*").alias("n_w"))
    known = pairs.join(counts, "w").crossJoin(F.broadcast(totals))
    p_word = F.least(F.lit(1.0), F.col("n_w") * 2.0 * WORDS / F.greatest(F.col("words"), F.lit(1)))
    information = -F.log(F.col("n_e") / F.greatest(F.col("contexts"), F.col("n_e") + 1))
    return known.filter(F.log(F.col("n_ew") / F.col("n_e") / p_word) >= F.greatest(F.lit(ratio) * information, F.lit(1e-9))).select("e", "w")


def spans_of(docs: DataFrame, ratio: float = DISCLOSURE, tag: Column | None = None) -> DataFrame:
    """doc_id, tag (of the row, see exact_dedup.digests), the counts, base_sha256, base, and terms array<struct<a, b>> of every row."""
    tag = F.monotonically_increasing_id() if tag is None else tag
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), text_of().alias("text"))
    found = written(rows.mapInArrow(_find, _FOUND), "pii")
    told = small(cut(disclosing(found, docs.select("text"), ratio)))
    words = found.filter(F.size("m") > 0).select("tag", F.explode("m").alias("m")).select("tag", F.col("m.e").alias("e"), F.explode("m.t").alias("t"))
    hits = words.select("tag", "e", F.col("t.w").alias("w"), F.col("t.a").alias("a"), F.col("t.b").alias("b")).join(told, ["e", "w"], "left_semi")
    terms = hits.groupBy("tag").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("terms"))
    return found.drop("m", "n_words").join(terms, "tag", "left")


def _all_spans():
    """Base spans and terms by start, base kinds before terms."""
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.element_at(F.split(s, ":"), 2).cast("int").alias("a"), F.lit(0).alias("k"), s.alias("s")))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<a:int,b:int>>")), lambda t: F.struct(t["a"].alias("a"), F.lit(1).alias("k"), F.concat_ws(":", F.lit("term"), t["a"].cast("string"), t["b"].cast("string")).alias("s")))
    # base spans are in order already; a stable key keeps kinds of one start in the order in which they are listed
    numbered = F.transform(F.concat(base, terms), lambda x, i: F.struct(x["a"].alias("a"), x["k"].alias("k"), i.alias("i"), x["s"].alias("s")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda x: x["s"]), ",")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spans_of(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _all_spans().alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def rewrite(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced; of overlapping spans the first is replaced and the rest of the later ones removed."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out.append(text[at:start])
            out.append("" if kind == "term" and text[start:end].isdigit() else f"[{kind.upper()}]")
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, ratio: float = DISCLOSURE) -> DataFrame:
    """docs with `text` sanitised."""
    rows, tag = tagged(docs)
    spans = fresh(rows, "spans")
    marks = spans_of(rows, ratio, F.col(f"`{tag}`")).select(F.col("tag").alias(tag), _all_spans().alias(spans)).filter(F.col(spans) != "")
    marked = rows.join(marks, tag, "left").drop(tag)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts = [s.split(":") for s in (spans or "").split(",") if s]
                texts.append(rewrite(text, [(int(a), int(b), kind) for kind, a, b in parts]) if parts else text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(run, docs.schema)
