import random
import re

from textloom.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, 9 <= len(digits) <= 15)
            if ok[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans():
    rng = random.Random(1)
    parts = ["@", ".", "a", "b-", "1", "25", "192.168.0.1", "+4", "9 ", "-", "4111 1111 1111 1111", "(", ") ", "é", "x@y.de", " ", "_%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    assert pii.base_spans("1" * 300_000 + "a" * 300_000 + "@" * 1000 + "+1" * 100_000) == []


def test_disclosing_words(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["word%s" % c for c in "abcdefghijklmnopqrstuvwxyz"]

    def some(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows = [(i, f"{some(30)} zubenelgenubi {some(3)} boss@corp.example {some(20)}") for i in range(6)]
    rows += [(10 + i, f"{some(6)} copy{i % 1} other@corp.example {some(6)}") for i in range(1)] * 5  # one passage, five times
    rows += [(20 + i, some(60)) for i in range(100)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    found = pii.spans_of(docs).collect()
    texts = dict(rows)
    words = {(r.doc_id, texts[r.doc_id][t.a : t.b]) for r in found for t in r.terms or []}
    assert {(i, "zubenelgenubi") for i in range(6)} <= words
    assert not any(i >= 10 for i, _ in words)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "zubenelgenubi" not in clean[0] and "boss@" not in clean[0] and "[EMAIL]" in clean[0] and clean[25] == texts[25]


def test_edge_rows(docs, empty):
    rows = pii.spans_of(docs).collect()
    assert sorted(((r.doc_id, r.base) for r in rows), key=str) == sorted(((r.doc_id, pii.joined(brute(r.text or ""))) for r in docs.collect()), key=str)
    assert pii.spans_of(empty).count() == 0
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(empty).count() == 0


def test_rewrite():
    assert pii.rewrite("abcdefgh", [(1, 3, "email"), (2, 5, "card"), (6, 7, "term")]) == "a[EMAIL]f[TERM]h"
    assert pii.rewrite("ab 12 c", [(3, 5, "term")]) == "ab  c"
