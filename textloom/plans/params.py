"""Parsers of what users type, and helpers on short lists."""

from __future__ import annotations

import re
from collections.abc import Iterator


def parse_terms(text: str | None) -> list[str]:
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def parse_years(text: str | None) -> tuple[int, int] | None:
    """"1780-1900", also with decimals or an en dash; None for anything else."""
    number = r"\s*(\d+(?:[.,]\d+)?)\s*"
    found = re.fullmatch(f"{number}[-–]{number}", text or "")
    if not found:
        return None
    low, high = (int(float(g.replace(",", "."))) for g in found.groups())
    return (low, high) if low <= high else None


def parse_intervals(texts: list[str]) -> list[tuple[int, int]]:
    return [y for t in texts if (y := parse_years(t))]


def parse_pairs(text: str | None) -> list[tuple[str, str, float]]:
    """Lines of two words and a number; other lines are left out."""
    out = []
    for line in (text or "").splitlines():
        parts = [p for p in re.split(r"[;,\t ]+", line.strip()) if p]
        try:
            out.append((parts[0], parts[1], float(parts[2])))
        except (IndexError, ValueError):
            continue
    return out


def root_name(name: str) -> str:
    """A file's base name without version, step and stage endings."""
    stem = re.sub(r"\.[^.]+$", "", name)
    return re.sub(r"(_v\d+|_topdocs|_tagged|_pro_text|_n)+$", "", stem)


def chunks(text: str, most: int) -> Iterator[str]:
    """Pieces of at most `most` characters, cut at the last line feed, else blank, else anywhere; blank pieces are left out."""
    at = 0
    while at < len(text):
        piece = text[at : at + most]
        if at + most < len(text):
            end = next((e for mark in "\n " if (e := piece.rfind(mark)) > 0), len(piece))
            piece = piece[:end]
        at += len(piece)
        if at < len(text):
            at += len(text[at:]) - len(text[at:].lstrip(" \n\t\r")) if text[at] in " \n\t\r" else 0
        if piece.strip():
            yield piece


def match_topic(name: str, known: set[str]) -> str | None:
    """The known topic that a ranked name means: itself, the part before a parenthesis, its first word, or a form with or without the word Topic and its number."""
    name = name.strip()
    number = re.search(r"\d+", name)
    forms = [name, name.split("(")[0].strip(), *name.split()[:1], f"Topic {name}", name.removeprefix("Topic ")]
    if number:
        forms += [f"Topic {number[0]}", number[0], f"topic_{number[0]}", f"topic{number[0]}"]
    return next((f for f in forms if f and f in known), None)


def ranked_topics(ranks: list[tuple[str, float | None]], known: dict[str, float], most: int) -> list[str]:
    """The best ranked topics among the known ones; where no name is known, those with the highest sums. ranks: name, rank; known: topic, sum."""
    ordered = [n for n, r in sorted((x for x in ranks if x[1] is not None), key=lambda x: x[1])]
    found = [t for n in ordered if (t := match_topic(n, set(known)))][:most]
    return found or sorted(known, key=lambda t: -known[t])[:most]


def display_columns(columns: list[tuple[str, bool]], configured: list[str], n: int = 3) -> list[str]:
    """Configured columns, then text columns, then others, up to n. columns: name, whether it is numeric."""
    names = [c for c, _ in columns]
    rest = sorted(columns, key=lambda c: c[1])
    return list(dict.fromkeys([*(c for c in configured if c in names), *(c for c, _ in rest)]))[:n]
