import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus as C
from textloom.operators import dtti, explore, matrices, metrics, models, names, tags, topics, vectors

CORPUS = "doc_id string, content string, genre string, textclass string, year int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("a", "the cat and the dog", "Drama, Lyrik", "x", 1800),
        ("b", "the bird", "Lyrik", "y", 1802),
        ("c", "cat bird cat", "Drama , Prosa", "x", None),
        ("d", "123 !", None, None, 1801),
        ("e", None, "Prosa", "y", 1805),
    ]
    return spark.createDataFrame(rows, CORPUS)


def test_roles_and_ids(spark):
    assert C.find_column([" _ID ", "Text"], C.ROLES["id"]) == " _ID "
    df = spark.createDataFrame([("ca. 1856", "1850.0"), (None, "1850-03-14"), ("1799", None)], "Jahr_first string, year string")
    assert [r.y for r in df.select(C.year_column(df).alias("y")).collect()] == [1850, None, 1799]
    assert {r.doc_id for r in C.with_document_id(df, ["year"]).collect()} == {"1", "2", "3"}
    ids = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("x", 4)], "id string, o int")
    assert [r.unique_id for r in C.unique_ids(ids, "id", "o").orderBy("o").collect()] == ["x", "x_2", "y", "x_3"]


def test_genres_are_split_at_any_comma(corpus):
    assert {r.doc_id for r in C.with_genre(corpus, "Drama").collect()} == {"a", "c"}
    assert [tuple(r) for r in C.facet_columns(corpus, ["genre", "doc_id"], 2, 4).collect()] == [("genre", 4)]


def test_segments_keep_a_single_chunk_and_count_dropped_tails(spark):
    df = spark.createDataFrame([("a", " ".join("abcdefg"), ""), ("b", "x", "")], "doc_id string, content string, m string")
    assert sorted((r._id, r.content) for r in C.segments(df, 3, 2).collect()) == [("a_0001", "a b c"), ("a_0002", "d e f"), ("b_0001", "x")]


def test_tfidf_rows_have_length_one(corpus):
    m = matrices.tfidf(corpus)
    for r in m.groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect():
        assert abs(r.s - 1) < 1e-9
    cells = {(r.doc_id, r.term): r.tfidf for r in m.collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1  # noqa: E731  three documents with letters
    raw = {"the": 2 * idf(2), "cat": idf(2), "and": idf(1), "dog": idf(1)}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert all(abs(cells["a", t] - v / norm) < 1e-12 for t, v in raw.items())


def test_cosine_pairs_equal_the_full_join(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i:02}", " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], 6, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])), "", "", 1800) for i in range(40)]
    m = matrices.tfidf(spark.createDataFrame(rows, CORPUS))
    for least in (0.3, 0.7, 0.95):
        got = {(r.doc_a, r.doc_b): r.cosine for r in matrices.cosine_pairs(m, least).collect()}
        want = {(r.doc_a, r.doc_b): r.cosine for r in matrices.cosine_all(m).collect() if r.doc_a < r.doc_b and r.cosine >= least}
        assert got == want and want


def test_cosine_pairs_of_many_blocks_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"{part}{i:02}", part, t, float(v)) for part in ("x", "y") for i in range(18) for t, v in _unit(rng)]
    m = spark.createDataFrame(rows, "doc_id string, part string, term string, tfidf double")
    want = {part: {(r.doc_a, r.doc_b): r.cosine for r in matrices.cosine_all(m.filter(F.col("part") == part).drop("part")).collect() if r.doc_a < r.doc_b and r.cosine >= 0.5} for part in ("x", "y")}
    monkeypatch.setattr(matrices, "BLOCK", 4)
    for columns in (4096, 5):  # all columns dense at once, and in runs
        monkeypatch.setattr(matrices, "COLUMNS", columns)
        found = matrices.cosine_pairs(m, 0.5, ["part"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "")
        got = found.collect()
        assert len(got) == len({(r.part, r.doc_a, r.doc_b) for r in got})
        assert {part: {(r.doc_a, r.doc_b): r.cosine for r in got if r.part == part} for part in ("x", "y")} == want and all(want.values())


def test_interval_cosine_is_not_shuffled_by_pairs_of_blocks(spark):
    rows = [(f"d{i}", f"aa bb {'cc' if i % 2 else 'dd'} ee{i % 3}", "", "", 1800 + i) for i in range(12)]
    m = matrices.interval_tfidf(spark.createDataFrame(rows, CORPUS), [(1800, 1807), (1804, 1811)], 5)
    found = matrices.cosine_pairs(m, 0.6, ["interval"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    want = {(p, r.doc_a, r.doc_b, r.cosine) for p in ("1800-1807", "1804-1811") for r in matrices.cosine_all(m.filter(F.col("interval") == p).drop("interval")).collect() if r.doc_a < r.doc_b and r.cosine >= 0.6}
    assert {(r.interval, r.doc_a, r.doc_b, r.cosine) for r in found.collect()} == want and len({w[0] for w in want}) == 2


def test_rows_that_bounds_leave_out_are_not_multiplied(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.zeros((40, 12))
    x[:20, :3], x[20:, 3:6] = rng.random((20, 3)) + 0.2, rng.random((20, 3)) + 0.2
    x[:, 6:] = 0.1 * rng.random((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = [(np.full(len(r), 12, "<i4"), np.tile(np.arange(12), len(r)).astype("<i4"), r.ravel()) for r in (x[:20], x[20:], x[::2])]
    monkeypatch.setattr(matrices, "LEADING", 6)
    seen, plain = [], matrices._products
    monkeypatch.setattr(matrices, "_products", lambda a, b, *kind: seen.append((len(a[0]), len(b[0]))) or plain(a, b, *kind))
    assert [len(c) for c in matrices._alike(blocks[0], blocks[1], 0.8)] == [0, 0, 0] and not seen
    i, j, cosine = matrices._alike(blocks[0], blocks[2], 0.8)
    want = np.round(x[:20] @ x[::2].T, 6)
    assert set(zip(i.tolist(), j.tolist(), cosine.tolist(), strict=True)) == {(a, b, want[a, b]) for a, b in zip(*np.nonzero(want >= 0.8), strict=True)}
    assert max(b for _, b in seen) <= 10  # the other ten are of other terms


def test_products_take_the_columns_of_both(monkeypatch):
    a = np.array([2, 1], "<i4"), np.array([0, 7, 900], "<i4"), np.array([0.5, 2.0, 3.0])
    b = np.array([3], "<i4"), np.array([7, 8, 900], "<i4"), np.array([4.0, 1.0, 5.0])
    widths, plain = [], matrices._dense
    monkeypatch.setattr(matrices, "_dense", lambda block, low, width, kind: widths.append(width) or plain(block, low, width, kind))
    assert matrices._products(a, b).tolist() == [[8.0], [15.0]] and widths == [2, 2]


@pytest.mark.parametrize("held", [2_000_000, 40])
def test_pairs_leave_a_task_by_their_cosine(monkeypatch, held):
    """So that a column of a written result holds equal values together, however many pairs of blocks a task has."""
    rng = np.random.default_rng(5)
    ids = [f"d{i:02}" for i in rng.permutation(24)]
    x = rng.integers(1, 4, (24, 3)).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = [{"ids": ids[k : k + 8], "sizes": np.full(8, 3, "<i4").tobytes(), "idx": np.tile(np.arange(3), 8).astype("<i4").tobytes(), "val": x[k : k + 8].tobytes()} for k in (0, 8, 16)]
    rows = [{"part": part, "i": i, "j": j, **{f"{c}_{s}": blocks[k][c] for s, k in (("a", i), ("b", j)) for c in blocks[0]}} for part in ("p", "q") for i in range(3) for j in range(i, 3)]
    monkeypatch.setattr(matrices, "HELD", held)
    monkeypatch.setattr(matrices, "SLICE", 7)
    schema = pa.schema([("part", pa.string()), ("doc_a", pa.string()), ("doc_b", pa.string()), ("cosine", pa.float64())])
    found = [r for b in matrices._similar(["part"], 0.9, schema)(iter(pa.Table.from_pylist(rows).to_batches())) for r in b.to_pylist()]
    cosine = np.round(x @ x.T, 6)
    want = sorted((part, *sorted((ids[a], ids[b])), cosine[a, b]) for part in ("p", "q") for a in range(24) for b in range(a) if cosine[a, b] >= 0.9)
    assert sorted(tuple(r.values()) for r in found) == want and len(want) > 100
    if held > len(want):
        assert [(r["part"], r["cosine"]) for r in found] == sorted((w[0], w[3]) for w in want)
    else:  # several times a part, each in order
        assert 1 < sum(a["cosine"] > b["cosine"] for a, b in zip(found, found[1:], strict=False)) <= 8


def _unit(rng) -> list[tuple[str, float]]:
    terms = rng.choice(12, 4, replace=False)
    values = rng.random(4) + 0.1
    return [(f"t{t:02}", v) for t, v in zip(terms, values / np.linalg.norm(values), strict=True)]


def test_band_masks_the_choice_of_terms_but_not_the_scores(spark):
    m = spark.createDataFrame([("a", "big", 0.95), ("a", "mid", 0.3), ("b", "mid", 0.4), ("b", "low", 0.1)], "doc_id string, term string, tfidf double")
    assert [r.term for r in matrices.selected_terms(m, 2).collect()] == ["mid", "low"]
    assert [(r.doc_id, r.combined_sum, r["rank"]) for r in matrices.document_rank(m, 3).orderBy("rank").collect()] == [("a", 1.25, 1), ("b", 0.5, 2)]


def test_collocations_of_runs(spark):
    docs = spark.createDataFrame([("1", "a b the c d e the f"), ("2", "the x y")], "doc_id string, content string")
    got = {(r.target, r.collocate): r.freq for r in explore.collocations(docs, ["the"], 3, 1, ngram=2).collect()}
    assert got == {("the", "a b"): 1, ("the", "c d"): 2, ("the", "d e"): 2, ("the", "x y"): 1}


def test_frequency_options(spark):
    docs = spark.createDataFrame([("1", "The the THE. other"), ("2", "nothing")], "doc_id string, content string")
    counts = [{r.doc_id: r["count"] for r in explore.document_frequency(docs, ["the"], **o).collect()} for o in ({}, {"case_sensitive": True}, {"regex": True}, {"regex": True, "case_sensitive": True})]
    assert counts == [{"1": 4}, {"1": 2}, {"1": 4}, {"1": 2}]
    assert {r["count"] for r in explore.document_frequency(docs, [r"\bth."], regex=True).collect()} == {3}


def test_collocations_agree_with_a_position_join(corpus):
    rows = corpus.select("doc_id", F.posexplode(F.split("content", " ")).alias("i", "t"))
    a, b = rows.select("doc_id", F.col("i").alias("i1"), F.col("t").alias("target")), rows.select("doc_id", F.col("i").alias("i2"), F.col("t").alias("collocate"))
    want = a.join(b, "doc_id").filter("abs(i1 - i2) between 1 and 2 and target in ('the', 'cat')").groupBy("target", "collocate").count()
    got = explore.collocations(corpus, ["the", "cat"], 2, 1)
    assert {(r.target, r.collocate): r.freq for r in got.collect()} == {(r.target, r.collocate): r["count"] for r in want.collect()}


def test_trends_fill_years(corpus):
    rows = {(r.term, r.year): (r.n, r.per_scale) for r in explore.word_trends(corpus, ["the", "cat"]).collect()}
    assert rows["the", 1800] == (2, 400000.0) and rows["cat", 1803] == (0, 0.0) and len(rows) == 12


def fold(docs, n):
    total, cum, section, out = sum(t for _, _, t in docs), 0, 1, {}
    for y, _, t in sorted(docs):
        cum += t
        out.setdefault(section, []).append((y, t))
        if section < n and cum >= total * section / n:
            section += 1
    return {k: (min(y for y, _ in v), max(y for y, _ in v), sum(t for _, t in v)) for k, v in out.items()}


@pytest.mark.parametrize("n", [1, 3, 7])
def test_milestones_equal_the_fold(spark, n):
    rng = np.random.default_rng(n)
    docs = [(1800 + int(rng.integers(0, 9)), f"d{i:03}", int(rng.choice([0, 1, 3, 50, 400]))) for i in range(60)]
    df = spark.createDataFrame([(i, "w " * t, "", "", y) for y, i, t in docs], CORPUS)
    got = {r.milestone: (r.year_from, r.year_to, r.tokens) for r in explore.milestones(df, n).collect()}
    assert got == fold(docs, n) and sum(v[2] for v in got.values()) == sum(t for *_, t in docs)


def test_names(spark):
    tagged = spark.createDataFrame([("Anna", "PROPN")] * 3 + [("Haus", "PROPN"), ("Haus", "NOUN"), ("Frau", "PROPN"), ("Frau", "PROPN")], "term string, pos string")
    df = spark.createDataFrame([("Anna", 1), ("Haus", 1), ("Frau", 1)], "term string, df long")
    n = spark.createDataFrame([(4,)], "n long")
    extra = spark.createDataFrame([("Droste",)], "term string")
    found = names.name_set(names.candidates(tagged), df, n, extra, ["frau"])
    assert {r.term for r in found.collect()} == {"Anna", "Droste"}
    corpus = spark.createDataFrame([("1", "Anna geht anna zu Droste"), ("2", None)], "doc_id string, content string")
    assert {r.doc_id: r.content for r in names.stripped(corpus, found).collect()} == {"1": "geht anna zu", "2": ""}


def test_tag_combinations(spark):
    df = tags.with_tags(spark.createDataFrame([("w", "N", 2, "b", "a, b", None)], "word string, pos string, count int, tag1 string, tag2 string, tag3 string"))
    assert {r.combination for r in tags.combinations(df, 3).collect()} == {"a", "b", "a, b"}
    assert {r.tag: (r.types, r.tokens) for r in tags.single_frequency(df).collect()} == {"a": (1, 2), "b": (1, 2)}


def test_index_quirks(spark):
    tw = spark.createDataFrame([("t1", 1, "x"), ("t1", 3, "x"), ("t1", 2, "y"), ("t2", 1, "q")], "topic string, pos int, word string")
    ts = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y")], "tag string, word string")
    sums = spark.createDataFrame([("x", 2.0)], "term string, total double")
    rows = {r.word: (r.pos, r.tag, round(r.score, 6)) for r in dtti.matches(tw, ts, sums).collect()}
    assert rows == {"x": (3, "B", round(2 / math.log(4), 6)), "y": (2, "B", 0.0)}  # the last position and the last tag win
    ranks = {r.topic: r.rank_pos for r in dtti.topic_rank(tw, ts, sums).collect()}
    assert ranks == {"t2": 1, "t1": 2}  # no match ranks first
    dt = spark.createDataFrame([("d", "t1", 0.5), ("d", "t2", 0.5)], "doc_id string, topic string, weight double")
    tf = spark.createDataFrame([("d", "x", 3)], "doc_id string, term string, tf long")
    got = {r.topic: (r.relevance, r.scaled) for r in dtti.index(dt, tf, tw, ts, sums).collect()}
    assert got == {"t1": (round(0.5 * 3 * 2 / math.log(4), 6), 1.0), "t2": (0.0, 0.0)}
    one = dtti.tag_relevance(tw, ts, sums).collect()
    assert len(one) == 1 and one[0].z == 0.0


def test_topic_tables(spark):
    dt = spark.createDataFrame([("doc_1.txt", "a", 0.7), ("doc_2.txt", "a", 0.7), ("doc_1.txt", "b", 0.3)], "doc_id string, topic string, weight double")
    assert [(r.topic, r.position, r.doc_id) for r in topics.top_documents(dt, 1).orderBy("topic").collect()] == [("a", 1, "doc_1.txt"), ("b", 1, "doc_1.txt")]
    meta = spark.createDataFrame([("1", 1850), ("2", None)], "doc_id string, year int")
    assert {(r.topic, r.year) for r in topics.with_year(dt, meta).collect()} == {("a", 1850), ("b", 1850)}
    flat = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "topic string, year int, v double")
    assert {r.scaled for r in topics.scaled(flat, "v", ["topic"]).collect()} == {0.0}
    smooth = explore.moving_average(spark.createDataFrame([("a", y, float(y)) for y in range(5)], "topic string, year int, v double"), "v", 4, ["topic"])
    assert [r.smooth for r in smooth.orderBy("year").collect()] == [0.5, 1.0, 1.5, 2.5, 3.0]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])], "word string, vector array<double>")
    assert [(r.neighbour, r.similarity) for r in vectors.neighbours(v, ["a"], 2).orderBy("rank").collect()] == [("b", 0.707107), ("c", 0.0)]
    turned = v.select("word", F.array(-F.element_at("vector", 2), F.element_at("vector", 1)).alias("vector"))
    assert max(abs(r.drift) for r in vectors.drift(v, turned).collect()) < 1e-6
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 12, 3)) * rng.uniform(0.1, 9, (2, 12, 1))  # norms differ: raw vectors are rotated
    models = [spark.createDataFrame([(f"w{i}", x.tolist()) for i, x in enumerate(m)], "word string, vector array<double>").repartition(3) for m in (a, b)]
    u, _, vt = np.linalg.svd(a.T @ b)
    turned_a = a @ u @ vt
    want = {f"w{i}": 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) for i, (x, y) in enumerate(zip(turned_a, b, strict=True))}
    got = {r.word: r.drift for r in vectors.drift(*models).collect()}
    assert got.keys() == want.keys() and all(abs(got[w] - x) < 1e-5 for w, x in want.items())
    pairs = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("a", "d", 1.0), ("a", "zz", 9.0)], "w1 string, w2 string, score double")
    assert tuple(vectors.rank_correlation(v, pairs).first()) == (3, 1.0)


def test_p_values(spark):
    # closed forms of Student's t distribution: 8 degrees of freedom, and 2, where p = 1 - |rho|
    for rho in (0.5, -0.8):
        c = 1 - rho * rho
        assert abs(vectors.p_value(10, rho) - (1 - abs(rho) * (1 + c / 2 + 3 * c**2 / 8 + 15 * c**3 / 48))) < 1e-12
    assert abs(vectors.p_value(4, 0.6) - 0.4) < 1e-12 and vectors.p_value(3, 1.0) == 0
    assert abs(vectors.p_value(3, 0.5) - 2 / 3) < 1e-12 and abs(vectors.p_value(5000, 0.0) - 1) < 1e-12
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("a", "d", 1.0)], "w1 string, w2 string, score double")
    assert tuple(vectors.rank_test(v, pairs).first()) == (3, 1.0, 0.0)
    assert vectors.rank_test(v, pairs.limit(1)).first().p is None


def test_metrics(spark):
    tw = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("u", 1, "x"), ("u", 2, "z")], "topic string, pos int, word string")
    docs = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), ("3", "q")], "doc_id string, term string")
    assert metrics.diversity(tw).first().diversity == 0.75
    got = {r.topic: r.npmi for r in metrics.npmi(tw, docs).collect()}
    assert got["u"] == -1.0 and abs(got["t"] - 1.0) < 1e-6


def test_linkage_and_cut():
    d = np.array([[0, 1, 5, 6], [1, 0, 4, 7], [5, 4, 0, 2], [6, 7, 2, 0]], float)
    assert models.linkage(d, "average") == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 5.5, 4)]
    assert models.linkage(d, "single")[2][2] == 4.0 and models.linkage(d, "complete")[2][2] == 7.0
    assert models.cut_tree(models.linkage(d), 4, 2) == [1, 1, 2, 2]
    points = np.array([[0.0], [1.0], [5.0]])
    merges = models.linkage(np.abs(points - points.T), "ward")
    assert abs(merges[1][2] - math.sqrt(4 / 3) * 4.5) < 1e-9


def test_nmf_finds_blocks(spark):
    rows = [(f"d{i}", t, 1.0) for i in range(20) for t in (("a", "b", "c") if i % 2 else ("x", "y", "z"))]
    m = spark.createDataFrame(rows, "doc_id string, term string, tfidf double")
    doc_topic, words = models.nmf(m, 2, 3)
    tops = {t: {r.word for r in words.filter(F.col("topic") == t).collect()} for t in (0, 1)}
    assert sorted(map(sorted, tops.values())) == [["a", "b", "c"], ["x", "y", "z"]]
    for r in doc_topic.groupBy("doc_id").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect():
        assert abs(r.s - 1) < 1e-9 and r.m > 0.95


def test_parameters_by_size():
    assert models.word2vec_params(10)["vector_size"] == 100 and models.word2vec_params(5_000_000)["vector_size"] == 150
    assert models.word2vec_params(10**8, window=3)["window"] == 3
