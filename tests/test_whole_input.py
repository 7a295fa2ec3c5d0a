"""Queries over tables of which every row counts."""

import random

import duckdb

from textloom.queries import ORACLES, QUERIES
from textloom import more_queries  # noqa: F401  registers its queries


def test_vectors_of_all_ids(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in (3, 499, 500, 501, 1700, 12345)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    words = {f"w{i}" for i, _ in rows}
    for name in ("mds_projection", "agglomerative_clusters"):
        assert {r.word for r in QUERIES[name](spark, str(tmp_path)).collect()} == words, name
    assert QUERIES["dendrogram"](spark, str(tmp_path)).count() == len(rows) - 1


def test_terms_of_all_years(spark, tmp_path):
    rows = [(i, "wort immer", "de", "src0") for i in (3, 49, 50, 99, 160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.term: r.n for r in QUERIES["term_overview"](spark, str(tmp_path)).collect()} == {"wort": 5, "immer": 5}


def test_files_of_all_documents(spark, tmp_path):
    rows = [(i, "wort", "de" if i % 2 else "en", "src0") for i in range(1, 31)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    merged = QUERIES["txt_metadata_merge"](spark, str(tmp_path)).collect()
    assert sorted((r.file_name, r.id, r.lang) for r in merged) == sorted((f"d{i}.txt", f"d{i}", lang if i % 3 else None) for i, _, lang, _ in rows)
    assert {r.file_name for r in QUERIES["txt_unmatched"](spark, str(tmp_path)).collect()} == {f"d{i}.txt" for i in range(3, 31, 3)}


def test_fuzzy_match_of_all_parts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"{rng.choice(('blue', 'red', 'tan'))} lace", rng.choice(("PROMO BRUSHED STEEL", "SMALL PLATED TIN", "ECONOMY BRUSHED NICKEL")), rng.randrange(1, 51)) for i in range(1, 61)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    meta = [(f"id_{i:05}", name.split(" ")[0], kind, str(1800 + size)) for i, name, kind, size in rows]

    def text(n, m):
        return (m[0], f"{m[1]}: {m[2]}. {m[3]}.", f"{m[1]} - {m[3]}.", f"text_{n}")[n % 4]

    def strategy(t, doc_id, author, title, year):
        low = t.lower()
        has = author in low, year in low
        if t == doc_id:
            return 1
        if all(has) and title[:20].lower() in low:
            return 2
        if sum(has) + (title[:15].lower() in low) >= 2:
            return 3
        return 4 if t.split("_")[-1].lstrip("0") == doc_id.split("_")[-1].lstrip("0") else 9

    expected = {t: min((strategy(t, *m), m[0]) for m in meta) for t in {text(r[0], m) for r, m in zip(rows, meta, strict=True)}}
    found = {r.text: (r.strategy, r.doc_id) for r in QUERIES["fuzzy_text_match"](spark, str(tmp_path)).collect()}
    assert found == {t: e for t, e in expected.items() if e[0] < 9} and len(found) == len(expected)


def test_diagnostics_count_documents_beyond_the_vocabulary_and_without_vectors(spark, tmp_path):
    # 2,001 terms of two documents push the term of document 3 out of the 2,000 commonest
    common = " ".join(f"aa{i:04}" for i in range(2001))
    docs = [(0, common, "de", "src0"), (1, common, "de", "src0"), (3, "zzzz", "de", "src0"), (4, "? !", "de", "src0")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(0, [1.0] * 64), (1, None), (3, [2.0] * 64), (4, [3.0] * 64), (9, [1.0] * 64), (None, [1.0] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["dtti_diagnostics"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert [tuple(r) for r in got] == db.execute(ORACLES["dtti_diagnostics"]).fetchall() == [(5, 3, 12, 2)]
