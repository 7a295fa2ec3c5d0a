import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.operators import explore, token_index

WORDS = ["Haus", "haus", "Baum", "baumhaus", "und", "der", "ein", "Straße", "x_1", "42", "Haus_tür"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(f"d{i:03}", " ".join(rng.choice(WORDS) + rng.choice(("", "", ",", ".\n", "-haus")) for _ in range(rng.randrange(60))), 1900 + i % 7) for i in range(90)]
    rows += [("d005", "Haus Haus Haus und Haus", 1901), ("e1", None, 1902), ("e2", "", None), ("e3", " .,- ", 1903), (None, "Haus am Baum", 1904), ("f", "und der " * 3000, 1905), ("g", "seltenes Wort im Haus", None)]
    return spark.createDataFrame(rows, "doc_id string, content string, year int").repartition(5)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    spark = corpus.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    built = token_index.build(corpus, str(tmp_path_factory.mktemp("index") / "i"), ("year",), block_tokens=700, flush=150)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return built


def same(a, b):
    assert a.columns == b.columns
    rows = [sorted(map(tuple, df.collect()), key=repr) for df in (a, b)]
    assert rows[0] == rows[1]
    return rows[0]


def test_postings_hold_every_position(corpus, index):
    expected = [(r.doc_id, w, i) for r in corpus.collect() for i, w in enumerate(re.findall(r"\w+", r.content or "")) if w in ("Haus", "und")]
    rows = index.entries(["Haus", "und"]).join(index.offsets, ["block", "row"]).select("doc_id", "term", F.explode("positions"))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(expected, key=repr)
    counts = [(r.n, r.n_docs, len(r["rows"]), sum(r.counts), len(r.gaps)) for r in index.postings.collect()]
    assert all(n == total == gaps and docs == rows for n, docs, rows, total, gaps in counts)
    assert index.postings.filter("term = 'Haus'").count() > 5  # a common word is many rows


def test_running_offsets(corpus, index):
    rows = index.offsets.orderBy("start", "n_tokens").collect()
    assert len(rows) == corpus.count() and len({r.block for r in rows}) > 5
    total = 0
    for r in index.offsets.orderBy("block", "row").collect():
        assert r.start == total
        total += r.n_tokens
    assert total == corpus.select(F.sum(F.size(explore.T.tokens(F.col("content"))))).first()[0]
    ids = [r.doc_id for r in index.offsets.orderBy("block", "row").collect()]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


@pytest.mark.parametrize("case", [True, False])
def test_document_frequency(corpus, index, case):
    assert same(index.document_frequency(["haus", "ß"], case_sensitive=case), explore.document_frequency(corpus, ["haus", "ß"], case_sensitive=case))
    assert same(index.document_frequency(["nirgends"]), explore.document_frequency(corpus, ["nirgends"])) == []
    for wrong in ([], [" "], ["a b"]):
        with pytest.raises(ValueError):
            index.document_frequency(wrong)


@pytest.mark.parametrize(("term", "flags"), [("haus", {}), ("HAUS", {"ignore_case": True}), ("Haus", {"whole_word": True}), ("Haus, d", {}), ("baum-haus", {"ignore_case": True}), (".,-", {}), ("seltenes", {}), ("nirgends", {})])
def test_concordance(corpus, index, monkeypatch, term, flags):
    expected = same(index.concordance(term, 12, ("year",), **flags), explore.concordance(corpus, term, 12, ("year",), **flags))
    for name in ("LITERALS", "BROADCAST_ROWS"):  # more terms, blocks and documents than may be sent
        monkeypatch.setattr(token_index, name, 0)
    same(index.concordance(term, 12, ("year",), **flags), explore.concordance(corpus, term, 12, ("year",), **flags))
    first = index.first_hits(term, 7, 12, ("year",), **flags).select("doc_id", "year", "hit", "left", "match", "right").collect()
    in_order = sorted(expected, key=lambda r: (r[0] is not None, r[0], r[2]))
    assert len(first) == min(7, len(expected)) and {(r.doc_id, r.hit) for r in first} == {(r[0], r[2]) for r in in_order[:7]}


def test_capped_concordance_stops(index, monkeypatch):
    read = []
    plain = explore.concordance
    monkeypatch.setattr(explore, "concordance", lambda texts, *a, **k: (read.append(texts.select("block").distinct().count()), plain(texts, *a, **k))[1])
    assert index.first_hits("Haus", 3).count() == 3
    assert read == [1] and index.documents.select("block").distinct().count() > 5


@pytest.mark.parametrize("options", [{}, {"measure": "pmi"}, {"measure": "pmi", "ngram": 2}, {"ngram": 3, "window": 6, "min_freq": 1}])
def test_collocations(corpus, index, options):
    assert same(index.collocations(["Haus", "und", "nirgends"], **options), explore.collocations(corpus, ["Haus", "und", "nirgends"], **options))


@pytest.mark.parametrize(("a", "b"), [("Haus", "und"), ("Haus", "Haus"), ("der", "und"), ("Haus", "nirgends")])
def test_collocation_documents(corpus, index, a, b):
    rows = explore.collocation_documents(corpus, a, b, 3).collect()
    found = index.collocation_documents(a, b, 3).groupBy("doc_id").agg(F.sum("count").alias("count")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, rows), key=repr)


def test_phrases(corpus, index):
    expected = []
    for r in corpus.collect():
        words = re.findall(r"\w+", r.content or "")
        at = [i for i in range(len(words) - 2) if words[i : i + 3] == ["Haus", "und", "Haus"]]
        expected += [(r.doc_id, len(at), at[0])] if at else []
    assert sorted(map(tuple, index.phrases(["Haus", "und", "Haus"]).collect()), key=repr) == sorted(expected, key=repr)


def test_word_trends(corpus, index):
    same(index.word_trends(["Haus", "nirgends"]), explore.word_trends(corpus, ["Haus", "nirgends"]))


def test_row_groups_and_folders_are_pruned(index, spark, tmp_path):
    plan = index.concordance("seltenes", 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block", plan)
    assert "EqualTo(term,Haus)" in index.postings.filter(F.col("term").isin(["Haus"]))._jdf.queryExecution().executedPlan().toString()
    # of files sorted by term, few can hold one
    footers = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.postings.inputFiles()]
    stats = [m.row_group(g).column(0).statistics for m in footers for g in range(m.num_row_groups)]
    assert sum(s.min <= "seltenes" <= s.max for s in stats) == 1 < len(stats)


def test_empty_corpus(spark, tmp_path):
    built = token_index.build(spark.createDataFrame([], "doc_id string, content string"), str(tmp_path / "i"))
    assert built.vocabulary.count() == built.concordance("x").count() == built.first_hits("x", 5).count() == built.collocations(["x"]).count() == 0
