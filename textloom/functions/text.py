"""Scalar text functions: Column -> Column, all built of Spark's own expressions.

Word characters are letters, digits and the underscore of Unicode, written as a class so
that Java's and RE2's regular expressions agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns: every word; words of two characters or more; white-space separated.
WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
CHUNK = r"\S+"
#: The punctuation that is removed, ASCII and nine further marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "«»§„‹›—⸗■"
#: The characters that end sentences and stay tokens of their own.
SENTENCE_MARKS = ".!?"


def tokens(text: Column, pattern: str = WORD, lowercase: bool = False) -> Column:
    """Tokens in order; null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(pattern), F.lit(0))


def token_count(text: Column, pattern: str = CHUNK) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def remove_words(text: Column, words: list[str]) -> Column:
    """Drops words of the list (lower-case, compared without a trailing full stop or comma); all other punctuation goes too."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD + "[.,]?"), F.lit(0))
    return F.array_join(F.filter(found, lambda x: ~F.lower(F.rtrim(x, F.lit(".,"))).isin(words)), " ")


def normalize_punctuation(text: Column) -> Column:
    """Full stop, exclamation and question mark become tokens, all else that is no word character a blank."""
    spaced = F.regexp_replace(text, r"([.!?])", " $1 ")
    return collapse(F.regexp_replace(spaced, r"[^\p{L}\p{N}_.!?\s]", " "))


def filter_tokens(text: Column, drop: Column | None = None, words: list[str] = (), marks: bool = True) -> Column:
    """White-space tokens without the lower-cased `words`; without sentence marks if not `marks`."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    if words:
        parts = F.filter(parts, lambda x: ~F.lower(x).isin(list(words)))
    if not marks:
        parts = F.filter(parts, lambda x: ~x.isin(list(SENTENCE_MARKS)))
    if drop is not None:
        parts = F.filter(parts, lambda x: ~F.array_contains(drop, x))
    return F.array_join(parts, " ")


def strip_names(text: Column, names: Column) -> Column:
    """White-space tokens that aren't in `names` (an array column), case-sensitive."""
    return filter_tokens(text, drop=names)


def normalize_ws(text: Column) -> Column:
    return collapse(F.replace(text, F.lit("­"), F.lit("")))


def surname(name: Column) -> Column:
    """"Surname, Forenames" or "Forenames Surname"."""
    name = normalize_ws(name)
    return F.when(F.contains(name, F.lit(",")), F.trim(F.element_at(F.split(name, ","), 1))).otherwise(F.element_at(F.split(name, " "), -1))


def forename(name: Column) -> Column:
    """All after the first comma, else all but the last word."""
    name = normalize_ws(name)
    rest = F.split(name, " ")
    return F.when(F.contains(name, F.lit(",")), F.trim(F.regexp_extract(name, "^[^,]*,(.*)$", 1))).otherwise(F.array_join(F.slice(rest, 1, F.size(rest) - 1), " "))


#: Particles that don't count as forenames, and what stands for an unknown author.
PARTICLES = ["von", "vom", "van", "zu", "zur", "zum", "de", "del", "della", "da", "di", "du", "le", "la", "den", "der", "ten", "ter", "af"]
NO_AUTHOR = ["anonymous", "anonym", "anonyme", "nn", "n.n.", "unbekannt", "unknown", "o.a."]


def strip_particles(name: Column) -> Column:
    """The words that aren't particles, with or without a full stop."""
    return F.array_join(F.filter(F.split(normalize_ws(name), " "), lambda x: ~F.regexp_replace(F.lower(x), r"^\.+|\.+$", "").isin(PARTICLES)), " ")


def is_author(name: Column) -> Column:
    """Whether the name, without outer full stops, is one of a person. So those that NO_AUTHOR lists with one at the end are names."""
    plain = F.regexp_replace(F.lower(normalize_ws(F.coalesce(name, F.lit("")))), r"^\.+|\.+$", "")
    return (plain != "") & ~plain.isin(NO_AUTHOR) & ~F.startswith(plain, F.lit("anonym"))


def _year(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def year_of_date(text: Column) -> Column:
    """First four digits that are a year from 1400 to 2099."""
    return _year(text, r"(1[4-9][0-9]{2}|20[0-9]{2})")


def year_anywhere(text: Column) -> Column:
    """First four digits that are a year from 1600 to 2099, also within longer numbers."""
    return _year(text, r"(1[6-9][0-9]{2}|20[0-9]{2})")


def year_word(text: Column) -> Column:
    """First word that is a year from 1600 to 2099."""
    return _year(text, r"(?:^|[^\p{L}\p{N}_])(1[6-9][0-9]{2}|20[0-9]{2})(?:[^\p{L}\p{N}_]|$)")


def metadata_entry(author: Column, title: Column, source: Column, year: Column) -> Column:
    """"Surname: Title. Source. Year." of the parts that there are."""
    dot = F.lit(".")
    return F.concat_ws(" ", F.concat(author, F.lit(":")), F.concat(title, dot), F.concat(source, dot), F.concat(year.cast("string"), dot))


def document_stem(doc_id: Column) -> Column:
    """Document id without folder, extension and the prefixes doc_, text_ and id_, lower-cased."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(doc_id), r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.lower(F.regexp_replace(stem, r"(?i)^(doc|text|id)_", ""))


def strip_txt(doc_id: Column) -> Column:
    return F.regexp_replace(F.trim(doc_id), r"(?i)\.txt$", "")


def strip_note(entry: Column) -> Column:
    """Without a trailing note in parentheses."""
    return F.trim(F.regexp_replace(entry, r"\s*\(.*?\)\s*$", ""))


def tag_list(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def combine_tags(*tags: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.trim(t), F.lit("")) for t in tags])


def natural_key(name: Column) -> Column:
    """The last number in a name, for Topic_2 before Topic_10."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("int")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks: the array zipped with its own shifts, so that `words` is computed n times, not once per run."""
    out = words
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, k, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(out)


def quote(term: str) -> str:
    """A literal for a regular expression of Java and RE2."""
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" if c.isascii() else c for c in term)


def kwic(text: Column, term: str, context: int, whole_word: bool = False, ignore_case: bool = False) -> Column:
    """Hits as array<struct<left, match, right>>: up to `context` characters of the same line on either side; hits don't overlap, and of several within the left context the last is the match."""
    core = rf"\b{quote(term)}\b" if whole_word else quote(term)
    pattern = f"(?d{'U' if whole_word else ''}{'iu' if ignore_case else ''})(.{{0,{context}}})({core})(.{{0,{context}}})"
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    # within a hit the same expression finds the same parts
    return F.transform(hits, lambda h: F.struct(*[F.regexp_extract(h, pattern, g).alias(n) for g, n in ((1, "left"), (2, "match"), (3, "right"))]))


def contains_words(text: Column, terms: list[str], regex: bool = False, case_sensitive: bool = True) -> Column:
    """Number of non-overlapping hits of each of the terms, added up."""
    flags = "" if case_sensitive else "(?iu)"
    return sum((F.regexp_count(F.coalesce(text, F.lit("")), F.lit(flags + (t if regex else quote(t)))) for t in terms), F.lit(0)).cast("long")
