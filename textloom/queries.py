"""The query catalogue: each query as a function of (spark, sf_dir), most with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import corpus as C
from .operators import dtti, explore, matrices, metrics, names, tags, topics, vectors
from .plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL parts of the adapters and matrices ---------------------------------------------

W, W2 = r"'[\p{L}\p{N}_]+'", r"'[\p{L}\p{N}_]{2,}'"
CORPUS = "corpus AS (SELECT doc_id::VARCHAR AS doc_id, text AS content, lang AS genre, source AS textclass, (1800 + doc_id % 100)::INT AS year FROM documents)"
FULL = r"full_corpus AS (SELECT * FROM corpus WHERE regexp_matches(content, '\p{L}'))"
TOK = f"{CORPUS}, tok AS (SELECT *, unnest(regexp_extract_all(content, {W})) AS term FROM corpus)"
TF = f"{CORPUS}, {FULL}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(content, {W2})) AS term FROM full_corpus) GROUP BY ALL)"


def _tfidf(top: int) -> str:
    return f"""{TF}, voc AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT {top}),
raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM full_corpus)) / (1 + df)::DOUBLE) + 1) AS v FROM tf JOIN voc USING (term)),
tfidf AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS tfidf FROM raw)"""


TFIDF = _tfidf(2000)
SUMS = "sums AS (SELECT term, sum(tfidf) AS total FROM tfidf GROUP BY term)"
SELECTED = "sel AS (SELECT term, round(sum(CASE WHEN tfidf > 0 AND tfidf < 0.9 THEN tfidf ELSE 0 END), 9) AS s FROM tfidf GROUP BY term ORDER BY s DESC, term LIMIT 500)"
TOPIC_LIST = ", ".join(f"('{t}', {i})" for i, t in enumerate(A.TOPICS, 1))
DOC_TOPIC = f"""topic_names(topic, i) AS (VALUES {TOPIC_LIST}),
doc_topic AS (SELECT vec_id::VARCHAR AS doc_id, topic, abs(embedding[i]::DOUBLE) / list_sum(list_transform(embedding[1:12], lambda e: abs(e::DOUBLE))) AS weight FROM embeddings, topic_names)"""
TOPIC_WORD = """topic_sums AS (SELECT c.genre || '_' || (c.doc_id::BIGINT % 3)::VARCHAR AS topic, term AS word, round(sum(tfidf), 9) AS s FROM tfidf JOIN corpus c USING (doc_id) GROUP BY ALL),
topic_word AS (SELECT topic, pos, word FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY s DESC, word) AS pos FROM topic_sums) WHERE pos <= 50)"""
TERMSET = "termset AS (SELECT substr(term, 1, 1) AS tag, term AS word FROM voc WHERE length(term) >= 4)"
MATCHES = "matches AS (SELECT topic, t.word, pos, tag, coalesce(total, 0) AS tfidf_sum, coalesce(total, 0) / ln(pos + 1) AS score FROM topic_word t JOIN termset USING (word) LEFT JOIN sums ON term = t.word)"
DTTI = f"WITH {TFIDF}, {SUMS}, {TOPIC_WORD}, {TERMSET}, {MATCHES}"
TOP50 = "top50 AS (SELECT * FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id)::INT AS position, doc_id, weight FROM doc_topic) WHERE position <= 50)"
ENTRY = "textclass || ': ' || genre || '. ' || year || '.'"
PLACED = f"{CORPUS}, {DOC_TOPIC}, {TOP50}, placed AS (SELECT topic, position, doc_id, weight, coalesce({ENTRY} || ' ' || doc_id, doc_id) AS text, year FROM top50 LEFT JOIN corpus USING (doc_id))"
INTERVALS = [(1800, 1829), (1820, 1859), (1860, 1899)]
TERMS = ["the", "de", "and"]


def _matrix(spark: SparkSession, sf: str, top: int = 2000) -> DataFrame:
    return matrices.tfidf(A.corpus(spark, sf), top)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- corpus tables ----------------------------------------------------------------------


@query("corpus_nonempty", f"WITH {CORPUS}, {FULL} SELECT doc_id, year FROM full_corpus")
def corpus_nonempty(spark, sf):
    return matrices.nonempty(A.corpus(spark, sf)).select("doc_id", "year")


@query("metadata_projection", f"WITH {CORPUS} SELECT corpus.doc_id, genre, textclass, year, quality, toxic FROM corpus LEFT JOIN labels l ON l.doc_id::VARCHAR = corpus.doc_id")
def metadata_projection(spark, sf):
    labels = A.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    return C.metadata(A.corpus(spark, sf)).join(labels, "doc_id", "left")


YEARS = "years AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '18' || (doc_id % 100) WHEN 2 THEN '1850-03-14' ELSE '1856.0' END AS year_first, (1900 + doc_id % 50)::VARCHAR AS year FROM documents)"


def _years(spark, sf):
    i = F.col("doc_id")
    first = F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, F.concat(F.lit("18"), (i % 100).cast("string"))).when(i % 4 == 2, "1850-03-14").otherwise("1856.0")
    return A.load(spark, sf, "documents").select("doc_id", first.alias("year_first"), (1900 + i % 50).cast("string").alias("year"))


@query("year_coalesce", f"WITH {YEARS} SELECT doc_id, trunc(coalesce(try_cast(year_first AS DOUBLE), try_cast(year AS DOUBLE)))::INT AS effective_year FROM years")
def year_coalesce(spark, sf):
    df = _years(spark, sf)
    return df.select("doc_id", C.year_column(df).alias("effective_year"))


@query("year_range", f"WITH {CORPUS} SELECT min(year) AS year_from, max(year) AS year_to FROM corpus")
def year_range(spark, sf):
    return C.year_range(A.corpus(spark, sf))


@query("interval_filter", f"WITH {CORPUS} SELECT doc_id, year FROM corpus WHERE year BETWEEN 1820 AND 1859")
def interval_filter(spark, sf):
    return C.between_years(A.corpus(spark, sf), 1820, 1859).select("doc_id", "year")


@query("genre_membership", "SELECT doc_id FROM (SELECT doc_id, lang || ' , ' || source || CASE WHEN doc_id % 3 = 0 THEN ', lyrik' ELSE '' END AS genre FROM documents) WHERE list_contains(list_transform(string_split(genre, ','), lambda g: trim(g)), 'lyrik')")
def genre_membership(spark, sf):
    docs = A.load(spark, sf, "documents")
    listed = F.concat("lang", F.lit(" , "), "source", F.when(F.col("doc_id") % 3 == 0, ", lyrik").otherwise(""))
    return C.with_genre(docs.select("doc_id", listed.alias("genre")), "lyrik").select("doc_id")


@query("facet_columns", f"WITH {CORPUS}, n AS (SELECT unnest(['genre', 'textclass', 'year', 'doc_id']) AS \"column\", unnest([count(DISTINCT genre), count(DISTINCT textclass), count(DISTINCT year), count(DISTINCT doc_id)]) AS n_values FROM corpus) SELECT * FROM n WHERE n_values BETWEEN 2 AND 30")
def facet_columns(spark, sf):
    return C.facet_columns(A.corpus(spark, sf), ["genre", "textclass", "year", "doc_id"])


@query("has_values", f"WITH {CORPUS} SELECT unnest(['genre', 'year']) AS \"column\", unnest([count(genre) > 0, count(year) > 0]) AS filled FROM corpus")
def has_values(spark, sf):
    return C.has_values(A.corpus(spark, sf), ["genre", "year"])


@query("dedupe_ids", "SELECT o_orderkey, CASE WHEN n = 1 THEN id ELSE id || '_' || n END AS unique_id FROM (SELECT o_orderkey, o_custkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def dedupe_ids(spark, sf):
    orders = A.load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("id"))
    return C.unique_ids(orders, "id", "o_orderkey").select("o_orderkey", "unique_id")


def _files(spark, sf):
    docs = A.load(spark, sf, "documents")
    texts = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text")
    # every third row of metadata has an id that no file has
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit("d"))
    meta = docs.select(F.concat(name, F.col("doc_id").cast("string")).alias("id"), "lang")
    return C.merge_texts(texts, meta)


FILES = "texts AS (SELECT 'd' || doc_id || '.txt' AS file_name, text, 'd' || doc_id AS id FROM documents), meta AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'd' END || doc_id AS id, lang FROM documents)"


@query("txt_metadata_merge", f"WITH {FILES} SELECT file_name, texts.id, lang FROM texts LEFT JOIN meta USING (id)")
def txt_metadata_merge(spark, sf):
    return _files(spark, sf)[0].select("file_name", "id", "lang")


@query("txt_unmatched", f"WITH {FILES} SELECT file_name FROM texts ANTI JOIN meta USING (id)")
def txt_unmatched(spark, sf):
    return _files(spark, sf)[1]


SEGMENTS = r"""words AS (SELECT doc_id AS source_id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS ws FROM corpus),
parts AS (SELECT source_id, ws, len(ws) AS n, unnest(range(0, len(ws), 200)) AS a FROM words WHERE len(ws) > 0),
segs AS (SELECT source_id || '_' || CASE WHEN a // 200 + 1 < 10000 THEN lpad((a // 200 + 1)::VARCHAR, 4, '0') ELSE (a // 200 + 1)::VARCHAR END AS _id, source_id, ws[a + 1:a + 200] AS chunk, n FROM parts)"""


@query("segments", f"WITH {CORPUS}, {SEGMENTS} SELECT _id, source_id, array_to_string(chunk, ' ') AS content FROM segs WHERE len(chunk) >= 50 OR n <= 200")
def segments(spark, sf):
    return C.segments(A.corpus(spark, sf), 200, 50)


# --- vocabularies and matrices ----------------------------------------------------------


@query("term_frequency_top", f"WITH {TOK} SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term)::INT AS rank FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 500")
def term_frequency_top(spark, sf):
    return matrices.top_terms(A.corpus(spark, sf), 500)


_SLICES = "slices AS (SELECT 'full' AS kind, 'full' AS slice, term FROM tok UNION ALL SELECT 'textclass', textclass, term FROM tok UNION ALL SELECT 'genre', genre, term FROM tok" + "".join(f" UNION ALL SELECT 'interval', '{a}-{b}', term FROM tok WHERE year BETWEEN {a} AND {b}" for a, b in INTERVALS) + ")"


@query("vocab_by_slice", f"WITH {TOK}, {_SLICES} SELECT kind, slice, term, count(*) AS n FROM slices GROUP BY ALL")
def vocab_by_slice(spark, sf):
    return matrices.slice_counts(A.corpus(spark, sf), INTERVALS)


@query("vocab_header", f"WITH {TOK}, {_SLICES} SELECT kind, slice, count(DISTINCT term) AS vocabulary_size, count(*) AS total_tokens FROM slices GROUP BY ALL")
def vocab_header(spark, sf):
    return matrices.slice_header(matrices.slice_counts(A.corpus(spark, sf), INTERVALS))


@query("dtm_500", f"WITH {_tfidf(500)} SELECT doc_id, term, tf FROM tf JOIN voc USING (term)")
def dtm_500(spark, sf):
    return matrices.dtm(A.corpus(spark, sf), 500)


@query("dtm_minfreq6", f"WITH {TF} SELECT doc_id, term, tf FROM tf JOIN (SELECT term FROM tf GROUP BY term HAVING sum(tf) >= 6) USING (term)")
def dtm_minfreq6(spark, sf):
    return matrices.dtm(A.corpus(spark, sf), min_count=6)


@query("tfidf_500", f"WITH {_tfidf(500)} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_500(spark, sf):
    return _rounded(_matrix(spark, sf, 500), "tfidf")


@query("tfidf_avg_rank", f"WITH {TFIDF}, {SUMS}, m AS (SELECT term, round(total / (SELECT count(*) FROM full_corpus), 9) AS mean FROM sums) SELECT term, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, term)::INT AS rank FROM m")
def tfidf_avg_rank(spark, sf):
    n = matrices.nonempty(A.corpus(spark, sf)).agg(F.count("*").alias("n"))
    return _rounded(matrices.term_means(_matrix(spark, sf), n), "mean")


@query("term_search", f"WITH {TFIDF}, {SUMS} SELECT term, round(total, 6) AS total FROM sums WHERE term IN ({', '.join(repr(t) for t in TERMS)})")
def term_search(spark, sf):
    return _rounded(matrices.only_terms(matrices.term_sums(_matrix(spark, sf)), [f" {t} " for t in TERMS]), "total")


@query("metadata_aligned", f"WITH {CORPUS}, {DOC_TOPIC}, ids AS (SELECT DISTINCT doc_id FROM doc_topic) SELECT ids.doc_id, genre, textclass, year FROM ids LEFT JOIN corpus USING (doc_id)")
def metadata_aligned(spark, sf):
    ids = A.doc_topic(spark, sf).select("doc_id").distinct()
    return matrices.aligned(ids, C.metadata(A.corpus(spark, sf)))


@query("tfidf_sums", f"WITH {TFIDF}, {SUMS} SELECT term, round(total, 6) AS total FROM sums")
def tfidf_sums(spark, sf):
    return _rounded(matrices.term_sums(_matrix(spark, sf)), "total")


@query("tfidf_doc_rank", f"WITH {TFIDF}, {SELECTED}, d AS (SELECT doc_id, round(sum(tfidf), 6) AS combined_sum FROM tfidf JOIN sel USING (term) GROUP BY doc_id) SELECT doc_id, combined_sum, row_number() OVER (ORDER BY combined_sum DESC, doc_id)::INT AS rank FROM d")
def tfidf_doc_rank(spark, sf):
    return matrices.document_rank(_matrix(spark, sf), 500)


@query("tfidf_vocab_rank", f"WITH {TFIDF}, {SELECTED}, p AS (SELECT term, row_number() OVER (ORDER BY s DESC, term)::INT AS position FROM sel) SELECT term, position, doc_id, round(tfidf, 6) AS tfidf FROM tfidf JOIN p USING (term)")
def tfidf_vocab_rank(spark, sf):
    return _rounded(matrices.term_matrix(_matrix(spark, sf), 500), "tfidf")


@query("cosine_pairs", f"WITH {TFIDF} SELECT * FROM (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.tfidf * b.tfidf), 6) AS cosine FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) WHERE cosine >= 0.8")
def cosine_pairs(spark, sf):
    return matrices.cosine_pairs(_matrix(spark, sf), 0.8)


_INTERVAL = "iv(interval, a, b) AS (VALUES " + ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in INTERVALS) + ")"
_ITFIDF = f"""{CORPUS}, {FULL}, {_INTERVAL}, parts AS (SELECT * FROM full_corpus JOIN iv ON year BETWEEN a AND b),
tf AS (SELECT interval, doc_id, term, count(*) AS tf FROM (SELECT interval, doc_id, unnest(regexp_extract_all(lower(content), {W2})) AS term FROM parts) GROUP BY ALL),
voc AS (SELECT * FROM (SELECT interval, term, count(*) AS df, row_number() OVER (PARTITION BY interval ORDER BY sum(tf) DESC, term) AS r FROM tf GROUP BY interval, term) WHERE r <= 300),
nd AS (SELECT interval, count(*) AS n FROM parts GROUP BY interval),
raw AS (SELECT interval, doc_id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM tf JOIN voc USING (interval, term) JOIN nd USING (interval)),
tfidf AS (SELECT interval, doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY interval, doc_id)) AS tfidf FROM raw)"""


@query("interval_tfidf", f"WITH {_ITFIDF} SELECT interval, doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf")
def interval_tfidf(spark, sf):
    return _rounded(matrices.interval_tfidf(A.corpus(spark, sf), INTERVALS, 300), "tfidf")


@query("interval_cosine", f"WITH {_ITFIDF} SELECT * FROM (SELECT a.interval, a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.tfidf * b.tfidf), 6) AS cosine FROM tfidf a JOIN tfidf b ON a.interval = b.interval AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) WHERE cosine >= 0.9")
def interval_cosine(spark, sf):
    return matrices.cosine_pairs(matrices.interval_tfidf(A.corpus(spark, sf), INTERVALS, 300), 0.9, ["interval"])


# --- exploration ------------------------------------------------------------------------


@query("term_overview", f"WITH {TFIDF}, {SUMS}, n AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, {W})) AS term FROM corpus) GROUP BY term), m AS (SELECT term, round(total / (SELECT count(*) FROM full_corpus), 6) AS mean FROM sums) SELECT coalesce(n.term, m.term) AS term, coalesce(n, 0) AS n, mean FROM n FULL JOIN m ON n.term = m.term")
def term_overview(spark, sf):
    corpus = A.corpus(spark, sf)
    n = matrices.nonempty(corpus).agg(F.count("*").alias("n"))
    means = matrices.term_means(_matrix(spark, sf), n).select("term", F.round("mean", 6).alias("mean"))
    return explore.term_overview(matrices.term_counts(corpus), means)


def _frequency_sql(counts: list[str]) -> str:
    return rf"WITH {CORPUS}, c AS (SELECT doc_id, {' + '.join(counts)} AS count, len(regexp_extract_all(content, {W})) AS length FROM corpus) SELECT *, CASE WHEN length > 0 THEN round(count / length * 10000, 2) ELSE 0 END AS density FROM c WHERE count > 0"


@query("document_frequency", _frequency_sql([f"len(regexp_extract_all(content, '(?i){t}'))" for t in TERMS]))
def document_frequency(spark, sf):
    return explore.document_frequency(A.corpus(spark, sf), TERMS)


@query("document_frequency_case", _frequency_sql([f"len(regexp_extract_all(content, '{t}'))" for t in TERMS]))
def document_frequency_case(spark, sf):
    return explore.document_frequency(A.corpus(spark, sf), TERMS, case_sensitive=True)


@query("document_frequency_regex", _frequency_sql([f"len(regexp_extract_all(content, '(?i){t}'))" for t in ("th[ae]", "un?d[.]?")]))
def document_frequency_regex(spark, sf):
    return explore.document_frequency(A.corpus(spark, sf), ["th[ae]", "un?d[.]?"], regex=True)


_KWIC = f"""{CORPUS}, hits AS (SELECT doc_id, genre, unnest(range(1, len(m) + 1))::INT AS hit, unnest(l) AS "left", unnest(m) AS "match", unnest(r) AS "right" FROM
 (SELECT doc_id, genre, regexp_extract_all(content, '(.{{0,20}})(the)(.{{0,20}})', 1) AS l, regexp_extract_all(content, '(.{{0,20}})(the)(.{{0,20}})', 2) AS m, regexp_extract_all(content, '(.{{0,20}})(the)(.{{0,20}})', 3) AS r FROM corpus))"""


@query("kwic", f'WITH {_KWIC} SELECT doc_id, hit, "left", "match", "right" FROM hits')
def kwic(spark, sf):
    return explore.concordance(A.corpus(spark, sf), "the", 20)


@query("kwic_capped", f'WITH {_KWIC} SELECT doc_id, hit, "left", "match", "right" FROM hits ORDER BY doc_id, hit LIMIT 500')
def kwic_capped(spark, sf):
    return explore.first_hits(explore.concordance(A.corpus(spark, sf), "the", 20), 500)


@query("kwic_author_totals", f"WITH {_KWIC} SELECT doc_id, genre, hit, count(*) OVER (PARTITION BY genre) AS author_hits FROM hits")
def kwic_author_totals(spark, sf):
    hits = explore.concordance(A.corpus(spark, sf), "the", 20, ("genre",))
    return explore.hits_by(hits, "genre").select("doc_id", "genre", "hit", "author_hits")


_NEAR = f"""{TOK}, ts AS (SELECT doc_id, regexp_extract_all(content, {W}) AS ts FROM corpus),
places AS (SELECT doc_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS term FROM ts),
near AS (SELECT a.doc_id, a.term AS target, b.term AS collocate FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 5 AND a.i + 5 AND a.i <> b.i WHERE a.term IN ('the', 'de')),
pairs AS (SELECT target, collocate, count(*) AS freq FROM near GROUP BY ALL HAVING count(*) >= 3)"""
_TOP = "SELECT target, collocate, freq, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, collocate) AS r FROM scored) WHERE r <= 100"


@query("collocations_freq", f"WITH {_NEAR}, scored AS (SELECT *, freq::DOUBLE AS score FROM pairs) {_TOP}")
def collocations_freq(spark, sf):
    return explore.collocations(A.corpus(spark, sf), ["the", "de"])


@query("collocations_pmi", f"WITH {_NEAR}, c AS (SELECT term, count(*) AS n FROM tok GROUP BY term), t AS (SELECT count(*) AS total FROM tok), scored AS (SELECT target, collocate, freq, round(log2(greatest(freq / total, 1e-12) / greatest(c.n / total * ct.n / total, 1e-12)), 6) AS score FROM pairs JOIN c ON c.term = collocate JOIN c ct ON ct.term = target, t) {_TOP}")
def collocations_pmi(spark, sf):
    return explore.collocations(A.corpus(spark, sf), ["the", "de"], measure="pmi")


_NEAR2 = f"""{CORPUS}, ts AS (SELECT doc_id, regexp_extract_all(content, {W}) AS ts FROM corpus),
singles AS (SELECT doc_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS term FROM ts),
places AS (SELECT doc_id, unnest(range(1, len(ts))) AS i, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS term FROM ts),
near AS (SELECT a.doc_id, a.term AS target, b.term AS collocate FROM singles a JOIN places b ON a.doc_id = b.doc_id AND (b.i BETWEEN a.i - 5 AND a.i - 2 OR b.i BETWEEN a.i + 1 AND a.i + 4) WHERE a.term IN ('the', 'de')),
pairs AS (SELECT target, collocate, count(*) AS freq FROM near GROUP BY ALL HAVING count(*) >= 3)"""


@query("collocations_bigram_pmi", f"WITH {_NEAR2}, c AS (SELECT term, count(*) AS n FROM places GROUP BY term), ct AS (SELECT term, count(*) AS n FROM singles GROUP BY term), t AS (SELECT count(*) AS total FROM places), scored AS (SELECT target, collocate, freq, round(log2(greatest(freq / total, 1e-12) / greatest(c.n / total * ct.n / total, 1e-12)), 6) AS score FROM pairs JOIN c ON c.term = collocate JOIN ct ON ct.term = target, t) {_TOP}")
def collocations_bigram_pmi(spark, sf):
    return explore.collocations(A.corpus(spark, sf), ["the", "de"], measure="pmi", ngram=2)


@query("collocation_documents", f"WITH {_NEAR} SELECT doc_id, count(*) AS count FROM near WHERE target = 'the' AND collocate = 'of' GROUP BY doc_id")
def collocation_documents(spark, sf):
    return explore.collocation_documents(A.corpus(spark, sf), "the", "of")


@query("collocations_ngram2", f"WITH {CORPUS}, ts AS (SELECT regexp_extract_all(content, {W}) AS ts FROM corpus) SELECT ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS ngram FROM ts) GROUP BY ngram ORDER BY n DESC, ngram LIMIT 200")
def collocations_ngram2(spark, sf):
    return explore.ngram_counts(A.corpus(spark, sf), 2, 200)


_TRENDS = f"""{TOK}, y AS (SELECT year, count(*) AS total, {", ".join(f"count(*) FILTER (term = '{t}') AS t{i}" for i, t in enumerate(TERMS))} FROM tok GROUP BY year),
spine AS (SELECT unnest(range((SELECT min(year) FROM corpus), (SELECT max(year) FROM corpus) + 1))::INT AS year),
trends AS ({" UNION ALL ".join(f"SELECT '{t}' AS term, spine.year, coalesce(t{i}, 0) AS n, CASE WHEN total > 0 THEN round(coalesce(t{i}, 0) / total * 1000000, 6) ELSE 0 END AS per_scale FROM spine LEFT JOIN y ON y.year = spine.year" for i, t in enumerate(TERMS))})"""


@query("word_trends", f"WITH {_TRENDS} SELECT * FROM trends")
def word_trends(spark, sf):
    return explore.word_trends(A.corpus(spark, sf), TERMS)


@query("trend_moving_avg", f"WITH {_TRENDS} SELECT *, round(avg(n) OVER (PARTITION BY term ORDER BY year ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM trends")
def trend_moving_avg(spark, sf):
    return explore.moving_average(explore.word_trends(A.corpus(spark, sf), TERMS), "n", 4, ["term"])


_COUNTED = rf"{CORPUS}, counted AS (SELECT *, len(regexp_extract_all(content, '\S+')) AS tokens FROM corpus)"


@query("stage_token_summary", rf"WITH {_COUNTED}, s AS (SELECT 'min' AS stage, tokens FROM counted UNION ALL SELECT 'punct', len(regexp_extract_all(translate(content, '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '\S+')) FROM corpus) SELECT stage, count(*) AS documents, sum(tokens)::BIGINT AS tokens, round(avg(tokens), 1) AS tokens_per_doc FROM s GROUP BY stage")
def stage_token_summary(spark, sf):
    corpus = A.corpus(spark, sf).withColumn("content_min", T.remove_punctuation(F.col("content")))
    return explore.stage_summary(corpus, {"min": "content", "punct": "content_min"})


@query("year_token_counts", f"WITH {_COUNTED} SELECT year, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY year")
def year_token_counts(spark, sf):
    return explore.year_counts(A.corpus(spark, sf))


@query("metadata_frequency", f"WITH {_COUNTED} SELECT 'genre' AS \"column\", genre AS value, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY genre UNION ALL SELECT 'textclass', textclass, count(*), sum(tokens)::BIGINT FROM counted GROUP BY textclass")
def metadata_frequency(spark, sf):
    return explore.metadata_frequency(A.corpus(spark, sf), ["genre", "textclass"])


@query(
    "token_milestones",
    f"""WITH {_COUNTED}, o AS (SELECT year, tokens, row_number() OVER (ORDER BY year, doc_id) AS i, sum(tokens) OVER (ORDER BY year, doc_id ROWS UNBOUNDED PRECEDING) AS cum, sum(tokens) OVER () AS total FROM counted),
e AS (SELECT i, unnest(range((floor((cum - tokens) * 5 / total) + 1)::BIGINT, least(floor(cum * 5 / total), 4)::BIGINT + 1)) AS k FROM o),
b AS (SELECT k, k + max(i - k) OVER (ORDER BY k) AS b FROM e)
SELECT (1 + (SELECT count(*) FROM b WHERE b.b < o.i))::INT AS milestone, min(year) AS year_from, max(year) AS year_to, sum(tokens)::BIGINT AS tokens FROM o GROUP BY 1""",
)
def token_milestones(spark, sf):
    return explore.milestones(A.corpus(spark, sf), 5)


_STOP = ["the", "of", "and", "de", "la", "der", "die"]


@query("stopword_removed", f"WITH {CORPUS} SELECT doc_id, array_to_string(list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+[.,]?'), lambda x: lower(rtrim(x, '.,')) NOT IN ({', '.join(repr(w) for w in _STOP)})), ' ') AS content FROM corpus")
def stopword_removed(spark, sf):
    return A.corpus(spark, sf).select("doc_id", T.remove_words(F.col("content"), _STOP).alias("content"))


@query("punct_normalized", rf"WITH {CORPUS} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(content, '([.!?])', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}_.!?\s]', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM corpus")
def punct_normalized(spark, sf):
    return A.corpus(spark, sf).select("doc_id", T.normalize_punctuation(F.col("content")).alias("content"))


@query("gen_stage", rf"WITH {CORPUS}, g AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(content, '([.!?])', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}_.!?\s]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM corpus) SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '' AND lower(x) NOT IN ({', '.join(repr(w) for w in _STOP)})), ' ') AS content_gen, array_to_string(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x NOT IN ('', '.', '!', '?')), ' ') AS content_words FROM g")
def gen_stage(spark, sf):
    c = T.normalize_punctuation(F.col("content"))
    return A.corpus(spark, sf).select("doc_id", T.filter_tokens(c, words=_STOP).alias("content_gen"), T.filter_tokens(c, marks=False).alias("content_words"))


# --- names and tags ---------------------------------------------------------------------

_TAGGED = r"""tagged AS (SELECT doc_id, term, CASE WHEN upper(term[1]) = term[1] AND lower(term[1]) <> term[1] THEN 'PROPN' ELSE 'NOUN' END AS pos FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS term FROM corpus))"""


def _name_tables(spark, sf):
    corpus = A.corpus(spark, sf)
    rows = corpus.select("doc_id", F.explode(F.filter(F.split("content", r"\s+"), lambda x: x != "")).alias("term"))
    first = F.substring("term", 1, 1)
    tagged = rows.withColumn("pos", F.when((F.upper(first) == first) & (F.lower(first) != first), "PROPN").otherwise("NOUN"))
    return corpus, names.name_set(names.candidates(tagged), names.document_frequency(corpus), corpus.agg(F.count("*").alias("n")), protected=["the", "der"])


_NAMES = f"{_TAGGED}, c AS (SELECT term, count(*) FILTER (pos = 'PROPN') AS proper, count(*) AS total, count(DISTINCT doc_id) AS df FROM tagged GROUP BY term), name_set AS (SELECT term, total, df FROM c WHERE total >= 2 AND proper / total >= 0.95 AND df <= greatest(1, floor((SELECT count(*) FROM corpus) * 0.30)) AND lower(term) NOT IN ('the', 'der'))"


@query("name_candidates", f"WITH {CORPUS}, {_NAMES} SELECT * FROM name_set")
def name_candidates(spark, sf):
    return _name_tables(spark, sf)[1]


@query("strip_names", rf"WITH {CORPUS}, {_NAMES}, t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS ws FROM corpus)), kept AS (SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS content FROM t ANTI JOIN name_set USING (term) GROUP BY doc_id) SELECT doc_id, coalesce(kept.content, '') AS content FROM corpus LEFT JOIN kept USING (doc_id)")
def strip_names(spark, sf):
    return names.stripped(*_name_tables(spark, sf)).select("doc_id", "content")


_POS = rf"pos_list AS (SELECT term AS word, CASE WHEN regexp_full_match(term, '[\p{{N}}_]+') THEN 'NUM' WHEN upper(term[1]) = term[1] AND lower(term[1]) <> term[1] THEN 'PROPN' WHEN length(term) <= 3 THEN 'DET' ELSE 'NOUN' END AS pos, n AS count FROM (SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 5000))"


@query("propn_candidates", f"WITH {TOK}, {_POS} SELECT word, sum(count)::BIGINT AS n FROM pos_list WHERE pos = 'PROPN' GROUP BY word")
def propn_candidates(spark, sf):
    return names.proper_candidates(A.pos_list(spark, sf))


def _tagged(spark, sf):
    base = A.pos_list(spark, sf)
    tag1 = F.when(F.length("word") % 3 == 0, "person").otherwise("")
    tag2 = F.when(F.col("count") % 2 == 0, " ort ").otherwise(F.lit(None).cast("string"))
    tag3 = F.when(F.col("pos") == "PROPN", "zeit, person").otherwise("")
    return tags.with_tags(base.withColumns({"tag1": tag1, "tag2": tag2, "tag3": tag3}))


_TAGS = f"""{TOK}, {_POS}, t0 AS (SELECT *, CASE WHEN length(word) % 3 = 0 THEN 'person' ELSE '' END AS tag1, CASE WHEN count % 2 = 0 THEN ' ort ' END AS tag2, CASE WHEN pos = 'PROPN' THEN 'zeit, person' ELSE '' END AS tag3 FROM pos_list),
t1 AS (SELECT *, concat_ws(', ', nullif(trim(tag1), ''), nullif(trim(tag2), ''), nullif(trim(tag3), '')) AS combined FROM t0),
tagged AS (SELECT word, pos, count, combined, list_sort(list_distinct(list_filter(list_transform(string_split(combined, ','), lambda x: trim(x)), lambda x: x <> ''))) AS tags FROM t1),
flat AS (SELECT word, count, unnest(tags) AS tag FROM tagged)"""


@query("combine_tags", f"WITH {_TAGS} SELECT word, combined, array_to_string(tags, '|') AS tags FROM tagged")
def combine_tags(spark, sf):
    return _tagged(spark, sf).select("word", "combined", F.array_join("tags", "|").alias("tags"))


@query("tag_freq_single", f"WITH {_TAGS} SELECT tag, count(DISTINCT word) AS types, sum(count)::BIGINT AS tokens FROM flat GROUP BY tag")
def tag_freq_single(spark, sf):
    return tags.single_frequency(_tagged(spark, sf))


@query("tag_freq_combo", f"WITH {_TAGS} SELECT array_to_string(tags, ', ') AS combination, count(*) AS n FROM tagged WHERE len(tags) > 0 GROUP BY 1")
def tag_freq_combo(spark, sf):
    return tags.combination_frequency(_tagged(spark, sf))


_COMBOS = "combos AS (SELECT tag AS combination, word FROM flat UNION ALL SELECT a.tag || ', ' || b.tag, word FROM flat a JOIN flat b USING (word) WHERE a.tag < b.tag UNION ALL SELECT a.tag || ', ' || b.tag || ', ' || c.tag, word FROM flat a JOIN flat b USING (word) JOIN flat c USING (word) WHERE a.tag < b.tag AND b.tag < c.tag)"


@query("tagset_combos", f"WITH {_TAGS}, {_COMBOS} SELECT * FROM combos")
def tagset_combos(spark, sf):
    return tags.combinations(_tagged(spark, sf), 3)


@query("tagset_sorted", f"WITH {TFIDF}, {SUMS}, {_TAGS.split(', tok AS', 1)[1].join(['tok AS', ''])}, {_COMBOS}, rk AS (SELECT term AS word, row_number() OVER (ORDER BY round(total, 9) DESC, term) AS rank FROM sums) SELECT combination, word, row_number() OVER (PARTITION BY combination ORDER BY rank NULLS LAST, word)::INT AS place FROM combos LEFT JOIN rk USING (word)")
def tagset_sorted(spark, sf):
    from pyspark.sql import Window

    sums = matrices.term_sums(_matrix(spark, sf)).withColumn("s", F.round("total", 9))
    rank = sums.select("term", F.row_number().over(Window.orderBy(F.desc("s"), "term")).alias("rank"))
    return tags.sorted_tagset(tags.combinations(_tagged(spark, sf), 3), rank)


@query("word_tag_binary", f"WITH {_TAGS} SELECT word, list_contains(tags, 'ort')::INT AS ort, list_contains(tags, 'person')::INT AS person, list_contains(tags, 'zeit')::INT AS zeit FROM tagged")
def word_tag_binary(spark, sf):
    return tags.word_tag_matrix(_tagged(spark, sf), ["ort", "person", "zeit"])


@query("tags_to_tfidf", f"WITH {TFIDF}, {SUMS}, {_TAGS.split(', tok AS', 1)[1].join(['tok AS', ''])} SELECT term, round(total, 6) AS total, pos, combined FROM sums LEFT JOIN tagged ON word = term")
def tags_to_tfidf(spark, sf):
    return _rounded(tags.onto_matrix(matrices.term_sums(_matrix(spark, sf)), _tagged(spark, sf)), "total")


@query("tag_progress", f"WITH {_TAGS} SELECT count(*) AS words, count(*) FILTER (len(tags) > 0) AS tagged FROM tagged")
def tag_progress(spark, sf):
    return tags.progress(_tagged(spark, sf))


@query("tagset_overview", f"WITH {TFIDF}, {TERMSET} SELECT tag, count(*) AS words, array_to_string(list_sort(list(word))[1:5], ', ') AS preview FROM termset GROUP BY tag")
def tagset_overview(spark, sf):
    return tags.tagset_overview(A.termset(spark, sf))


# --- topics -----------------------------------------------------------------------------


@query("topic_stats", f"WITH {DOC_TOPIC}, s AS (SELECT topic, round(sum(weight), 9) AS total, round(avg(weight), 9) AS mean, round(stddev_samp(weight), 9) AS deviation FROM doc_topic GROUP BY topic) SELECT topic, round(total, 6) AS total, round(mean, 6) AS mean, round(deviation, 6) AS deviation, dense_rank() OVER (ORDER BY total DESC)::INT AS rank FROM s")
def topic_stats(spark, sf):
    return _rounded(topics.statistics(A.doc_topic(spark, sf)), "total", "mean", "deviation")


@query("topic_topdocs", f"WITH {DOC_TOPIC}, {TOP50} SELECT topic, position, doc_id, round(weight, 6) AS weight FROM top50")
def topic_topdocs(spark, sf):
    return _rounded(topics.top_documents(A.doc_topic(spark, sf)), "weight")


@query("topic_top_subset", f"WITH {DOC_TOPIC}, {TOP50}, best AS (SELECT topic FROM (SELECT topic, round(sum(weight), 9) AS t FROM doc_topic GROUP BY topic) ORDER BY t DESC, topic LIMIT 10) SELECT topic, position, doc_id FROM top50 SEMI JOIN best USING (topic) WHERE position <= 30")
def topic_top_subset(spark, sf):
    dt = A.doc_topic(spark, sf)
    return topics.top_subset(topics.top_documents(dt), topics.statistics(dt)).select("topic", "position", "doc_id")


def _placed(spark, sf):
    corpus = A.corpus(spark, sf)
    # ids as file names on one side, to be matched without the extension
    meta = corpus.select(F.concat("doc_id", F.lit(".txt")).alias("doc_id"), "textclass", "genre", "year").withColumn("entry", F.concat_ws(" ", T.metadata_entry(F.col("textclass"), F.col("genre"), F.lit(None).cast("string"), F.col("year")), T.strip_txt(F.col("doc_id"))))
    mapped = topics.onto_metadata(topics.top_documents(A.doc_topic(spark, sf)), meta, F.col("entry"))
    return mapped.join(corpus.select("doc_id", "year"), "doc_id", "left")


@query("topdocs_mapped", f"WITH {PLACED} SELECT topic, position, text FROM placed")
def topdocs_mapped(spark, sf):
    return _placed(spark, sf).select("topic", "position", "text")


@query("year_topic_texts", f"WITH {PLACED} SELECT year, topic, string_agg(text, '; ' ORDER BY position) AS texts FROM placed WHERE year IS NOT NULL GROUP BY ALL")
def year_topic_texts(spark, sf):
    return topics.year_topic_texts(_placed(spark, sf))


@query("doc_topic_binary", f"WITH {PLACED} SELECT text, {', '.join(f'''max((topic = '{t}')::INT) AS {t}''' for t in A.TOPICS)}, count(DISTINCT topic) AS n_topics FROM placed GROUP BY text")
def doc_topic_binary(spark, sf):
    return topics.text_topic_matrix(_placed(spark, sf), A.TOPICS)


@query("topic_counts_per_year", f"WITH {PLACED} SELECT year, {', '.join(f'''count(*) FILTER (topic = '{t}') AS {t}''' for t in A.TOPICS)} FROM placed WHERE year IS NOT NULL GROUP BY year")
def topic_counts_per_year(spark, sf):
    return topics.topics_per_year(_placed(spark, sf), A.TOPICS)


@query("year_document_map", f"WITH {PLACED} SELECT year, count(DISTINCT text) AS n, string_agg(DISTINCT text, '; ' ORDER BY text) AS texts FROM placed WHERE year IS NOT NULL GROUP BY year")
def year_document_map(spark, sf):
    return topics.documents_per_year(_placed(spark, sf))


@query("year_rank_values", f"WITH {PLACED} SELECT year, sum(51 - position)::BIGINT AS value FROM placed WHERE year IS NOT NULL GROUP BY year")
def year_rank_values(spark, sf):
    return topics.year_rank_values(_placed(spark, sf), 50)


@query("text_topic_values", f"WITH {PLACED} SELECT text, sum(51 - position)::BIGINT AS total, {', '.join(f'''sum(CASE WHEN topic = '{t}' THEN 51 - position ELSE 0 END)::BIGINT AS {t}''' for t in A.TOPICS)} FROM placed GROUP BY text")
def text_topic_values(spark, sf):
    return topics.text_values(_placed(spark, sf), 50, A.TOPICS)


_YEARED = f"{CORPUS}, {DOC_TOPIC}, yeared AS (SELECT doc_topic.*, year FROM doc_topic JOIN corpus USING (doc_id))"


def _yeared(spark, sf):
    meta = A.corpus(spark, sf).select(F.concat(F.lit("texte/doc_"), "doc_id", F.lit(".txt")).alias("doc_id"), "year")
    return topics.with_year(A.doc_topic(spark, sf), meta)


@query("topic_year_means", f"WITH {_YEARED} SELECT year, topic, round(avg(weight), 6) AS mean FROM yeared GROUP BY ALL")
def topic_year_means(spark, sf):
    return topics.year_means(_yeared(spark, sf))


@query("topic_threshold_counts", f"WITH {_YEARED} SELECT year, topic, count(*) FILTER (weight >= 0.2) AS n FROM yeared GROUP BY ALL")
def topic_threshold_counts(spark, sf):
    return topics.threshold_counts(_yeared(spark, sf))


@query("tokens_vs_topics", f"WITH {_YEARED}, m AS (SELECT year, topic, round(avg(weight), 6) AS mean FROM yeared GROUP BY ALL), s AS (SELECT *, round(avg(mean) OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM m) SELECT year, topic, smooth, round(CASE WHEN max(smooth) OVER w > min(smooth) OVER w THEN (smooth - min(smooth) OVER w) / (max(smooth) OVER w - min(smooth) OVER w) ELSE 0 END, 6) AS scaled FROM s WINDOW w AS (PARTITION BY topic)")
def tokens_vs_topics(spark, sf):
    means = topics.year_means(_yeared(spark, sf))
    return topics.scaled(explore.moving_average(means, "mean", 5, ["topic"]), "smooth", ["topic"]).select("year", "topic", "smooth", "scaled")


@query("texts_rank", f"WITH {DOC_TOPIC} SELECT topic, doc_id, round(weight, 6) AS weight, rank FROM (SELECT *, rank() OVER (PARTITION BY topic ORDER BY weight DESC)::INT AS rank FROM doc_topic) WHERE rank <= 20")
def texts_rank(spark, sf):
    return _rounded(topics.text_ranks(A.doc_topic(spark, sf), 20), "weight")


@query(
    "fuzzy_text_match",
    r"""WITH meta AS (SELECT 'id_' || lpad(p_partkey::VARCHAR, 5, '0') AS doc_id, split_part(p_name, ' ', 1) AS author, p_type AS title, (1800 + p_size)::VARCHAR AS year FROM part),
texts AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'id_' || lpad(p_partkey::VARCHAR, 5, '0') WHEN 1 THEN split_part(p_name, ' ', 1) || ': ' || p_type || '. ' || (1800 + p_size) || '.' WHEN 2 THEN split_part(p_name, ' ', 1) || ' - ' || (1800 + p_size) || '.' ELSE 'text_' || p_partkey END AS text FROM part),
rows AS (SELECT doc_id, lower(author) AS author, lower(title) AS title, year FROM meta),
s AS (SELECT text, doc_id, CASE WHEN lower(text) = lower(doc_id) THEN 1
 WHEN len(author) >= 3 AND len(title) >= 3 AND contains(lower(text), substr(author, 1, 20)) AND contains(lower(text), substr(title, 1, 20)) AND contains(text, year) THEN 2
 WHEN (len(author) >= 3 AND contains(lower(text), substr(author, 1, 15)))::INT + (len(title) >= 3 AND contains(lower(text), substr(title, 1, 15)))::INT + contains(text, year)::INT >= 2 THEN 3
 WHEN ltrim(regexp_replace(lower(text), '^(doc|text|id)_', ''), '0') = ltrim(regexp_replace(lower(doc_id), '^(doc|text|id)_', ''), '0') THEN 4 END AS strategy FROM texts, rows)
SELECT text, doc_id, strategy FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY strategy, doc_id) AS r FROM s WHERE strategy IS NOT NULL) WHERE r = 1""",
)
def fuzzy_text_match(spark, sf):
    part = A.load(spark, sf, "part")
    padded = F.concat(F.lit("id_"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    author, year = F.split_part("p_name", F.lit(" "), F.lit(1)), (F.lit(1800) + F.col("p_size")).cast("int")
    meta = part.select(padded.alias("doc_id"), author.alias("author"), F.col("p_type").alias("title"), year.alias("year"))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, padded).when(k == 1, F.concat(author, F.lit(": "), "p_type", F.lit(". "), year.cast("string"), F.lit("."))).when(k == 2, F.concat(author, F.lit(" - "), year.cast("string"), F.lit("."))).otherwise(F.concat(F.lit("text_"), F.col("p_partkey").cast("string")))
    return topics.fuzzy_match(part.select(text.alias("text")), meta)


@query("doc_topic_aggregate", f"WITH {DOC_TOPIC}, seg AS (SELECT doc_id AS _id, (doc_id::BIGINT % 50)::VARCHAR AS source_id FROM (SELECT DISTINCT doc_id FROM doc_topic)), n AS (SELECT source_id, count(*) AS n FROM seg GROUP BY source_id) SELECT source_id, topic, round(sum(weight) / any_value(n), 6) AS weight FROM doc_topic JOIN seg ON _id = doc_id JOIN n USING (source_id) GROUP BY source_id, topic")
def doc_topic_aggregate(spark, sf):
    dt = A.doc_topic(spark, sf).withColumnRenamed("doc_id", "_id")
    seg = dt.select("_id").distinct().withColumn("source_id", (F.col("_id").cast("long") % 50).cast("string"))
    return _rounded(C.by_source(dt, seg), "weight")


# --- document-term-topic index ----------------------------------------------------------


def _dtti(spark, sf):
    return A.topic_word(spark, sf), A.termset(spark, sf), matrices.term_sums(A.tfidf2000(spark, sf))


@query("dtti_topic_rank", f"{DTTI}, g AS (SELECT t.topic, count(m.word) AS n_words, round(coalesce(sum(m.tfidf_sum), 0), 6) AS tfidf_sum, coalesce(sum(m.pos), 0)::BIGINT AS pos_sum, round(coalesce(sum(m.score), 0), 6) AS score FROM (SELECT DISTINCT topic FROM topic_word) t LEFT JOIN matches m ON m.topic = t.topic GROUP BY t.topic) SELECT *, rank() OVER (ORDER BY tfidf_sum DESC)::INT AS rank_tfidf, rank() OVER (ORDER BY pos_sum)::INT AS rank_pos, rank() OVER (ORDER BY score DESC)::INT AS rank_score FROM g")
def dtti_topic_rank(spark, sf):
    return dtti.topic_rank(*_dtti(spark, sf))


@query("dtti_word_topic_distribution", f"{DTTI} SELECT w.word, t.topic, pos::INT AS pos FROM (SELECT DISTINCT word FROM termset) w CROSS JOIN (SELECT DISTINCT topic FROM topic_word) t LEFT JOIN topic_word x ON x.word = w.word AND x.topic = t.topic")
def dtti_word_topic_distribution(spark, sf):
    return dtti.word_topics(A.topic_word(spark, sf), A.termset(spark, sf))


@query("dtti_position_score", f"{DTTI} SELECT topic, word, tag, pos::INT AS pos, round(score, 6) AS score FROM matches")
def dtti_position_score(spark, sf):
    return dtti.position_scores(*_dtti(spark, sf))


@query("dtti_tags_per_topic", f"{DTTI}, g AS (SELECT topic, tag, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM matches GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY topic ORDER BY n DESC)::INT AS rank_n, rank() OVER (PARTITION BY topic ORDER BY pos_sum)::INT AS rank_pos FROM g")
def dtti_tags_per_topic(spark, sf):
    return dtti.tags_per_topic(A.topic_word(spark, sf), A.termset(spark, sf))


@query("dtti_tag_relevance", f"{DTTI}, g AS (SELECT tag, count(*) AS n, round(sum(score), 6) AS score FROM matches GROUP BY tag) SELECT tag, n, score, round(score / n * ln(n + 1), 6) AS weighted, round(CASE WHEN stddev_samp(score) OVER () > 0 THEN (score - avg(score) OVER ()) / stddev_samp(score) OVER () ELSE 0 END, 6) AS z, rank() OVER (ORDER BY score DESC)::INT AS rank FROM g")
def dtti_tag_relevance(spark, sf):
    return dtti.tag_relevance(*_dtti(spark, sf))


@query("dtti_word_rank", f"{DTTI}, g AS (SELECT word, round(sum(score), 6) AS score FROM matches GROUP BY word) SELECT *, rank() OVER (ORDER BY score DESC)::INT AS rank FROM g")
def dtti_word_rank(spark, sf):
    return dtti.word_rank(*_dtti(spark, sf))


def _index(spark, sf):
    tf = matrices.dtm(A.corpus(spark, sf), 2000)
    return dtti.index(A.doc_topic(spark, sf), tf, *_dtti(spark, sf))


_INDEX = f"""{DTTI}, {DOC_TOPIC}, f AS (SELECT doc_id, m.topic, sum(tf * m.score) AS f FROM tf JOIN voc USING (term) JOIN matches m ON m.word = term GROUP BY ALL),
r AS (SELECT d.doc_id, d.topic, round(weight, 6) AS weight, round(coalesce(f, 0), 6) AS frequency_score, round(weight * coalesce(f, 0), 6) AS relevance FROM doc_topic d LEFT JOIN f ON f.doc_id = d.doc_id AND f.topic = d.topic),
dtti AS (SELECT *, round(CASE WHEN max(relevance) OVER () > min(relevance) OVER () THEN (relevance - min(relevance) OVER ()) / (max(relevance) OVER () - min(relevance) OVER ()) ELSE 0 END, 6) AS scaled FROM r)"""


@query("dtti_list", f"{_INDEX} SELECT * FROM dtti")
def dtti_list(spark, sf):
    return _index(spark, sf)


@query("dtti_matrix_norm", f"{_INDEX} SELECT doc_id, {', '.join(f'''max(CASE WHEN topic = '{t}' THEN scaled END) AS {t}''' for t in A.TOPICS)} FROM dtti GROUP BY doc_id")
def dtti_matrix_norm(spark, sf):
    return _index(spark, sf).groupBy("doc_id").pivot("topic", A.TOPICS).agg(F.max("scaled"))


@query("dtti_topdocs", f"{_INDEX} SELECT topic, position, doc_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, doc_id)::INT AS position FROM dtti) WHERE position <= 50")
def dtti_topdocs(spark, sf):
    return topics.top_documents(_index(spark, sf).select("doc_id", "topic", F.col("relevance").alias("weight"))).withColumnRenamed("weight", "relevance")


@query("dtti_diagnostics", f"{_INDEX} SELECT count(DISTINCT doc_id) AS documents, (SELECT count(DISTINCT d.doc_id) FROM doc_topic d JOIN tf USING (doc_id)) AS documents_found, count(DISTINCT topic) AS topics, (SELECT count(DISTINCT d.topic) FROM doc_topic d JOIN topic_word USING (topic)) AS topics_found FROM doc_topic")
def dtti_diagnostics(spark, sf):
    # every term counts here, not only those of the capped vocabulary
    tokens = matrices.token_rows(matrices.nonempty(A.corpus(spark, sf)), T.WORD2)
    return dtti.diagnostics(A.doc_topic(spark, sf), tokens, A.topic_word(spark, sf))


@query("tag_topic_bubbles", f"{DTTI}, m AS (SELECT term, round(total / (SELECT count(*) FROM full_corpus), 9) AS mean FROM sums), v AS (SELECT tag, topic, sum(mean) AS v FROM topic_word JOIN termset USING (word) JOIN m ON term = word GROUP BY ALL) SELECT a.tag, b.topic, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT tag FROM termset) a CROSS JOIN (SELECT DISTINCT topic FROM topic_word) b LEFT JOIN v ON v.tag = a.tag AND v.topic = b.topic")
def tag_topic_bubbles(spark, sf):
    n = matrices.nonempty(A.corpus(spark, sf)).agg(F.count("*").alias("n"))
    return dtti.tag_topic_grid(A.topic_word(spark, sf), A.termset(spark, sf), matrices.term_means(A.tfidf2000(spark, sf), n))


_GRID = f"{DTTI}, m AS (SELECT term, round(total / (SELECT count(*) FROM full_corpus), 9) AS mean FROM sums), v AS (SELECT tag, topic, sum(mean) AS v FROM topic_word JOIN termset USING (word) JOIN m ON term = word GROUP BY ALL), grid AS (SELECT a.tag, b.topic, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT tag FROM termset) a CROSS JOIN (SELECT DISTINCT topic FROM topic_word) b LEFT JOIN v ON v.tag = a.tag AND v.topic = b.topic)"


@query("bubble_sizes", f"{_GRID} SELECT tag, topic, value, round(CASE WHEN value = 0 THEN 15 WHEN (SELECT max(value) > min(value) FROM grid) THEN 50 + (value - (SELECT min(value) FROM grid)) / (SELECT max(value) - min(value) FROM grid) * 1950 ELSE 50 END, 6) AS size FROM grid")
def bubble_sizes(spark, sf):
    return dtti.bubble_sizes(tag_topic_bubbles(spark, sf))


# --- word vectors and metrics -----------------------------------------------------------

_VEC = """v AS (SELECT 'w' || vec_id AS word, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
n AS (SELECT word, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n FROM v)"""


def _near(name: str, vec: str, seeds: list[str], k: int, least: float = -2.0, among: str = "") -> str:
    return f"""{name} AS (SELECT word, neighbour, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, neighbour)::INT AS rank FROM
 (SELECT a.word, b.word AS neighbour, round(list_dot_product(a.x, b.x) / (a.n * b.n + 1e-12), 6) AS similarity FROM {vec} a JOIN {vec} b ON a.word <> b.word WHERE a.word IN ({", ".join(repr(s) for s in seeds)}){among}) WHERE similarity >= {least}) WHERE rank <= {k})"""


_SEEDS = ["w1", "w2", "w3", "w10", "w20"]


@query("nearest_neighbors", f"WITH {_VEC}, {_near('near', 'n', _SEEDS, 20)} SELECT * FROM near")
def nearest_neighbors(spark, sf):
    return vectors.neighbours(A.vectors(spark, sf), _SEEDS)


@query("compare_embeddings", f"WITH {_VEC}, {_near('near', 'n', ['w1', 'w8'], 200, 0.05)} SELECT a.neighbour, a.similarity AS similarity_a, b.similarity AS similarity_b FROM near a JOIN near b USING (neighbour) WHERE a.word = 'w1' AND b.word = 'w8'")
def compare_embeddings(spark, sf):
    return vectors.common_neighbours(A.vectors(spark, sf), "w1", "w8", 200, 0.05)


@query("semantic_network_edges", f"WITH {_VEC}, {_near('near', 'n', _SEEDS, 8, 0.1)}, {_near('seeds', 'n', _SEEDS, 5, 0.1, ' AND b.word IN (' + ', '.join(repr(s) for s in _SEEDS) + ')')} SELECT least(word, neighbour) AS src, greatest(word, neighbour) AS dst, max(similarity) AS weight FROM (SELECT word, neighbour, similarity FROM near UNION ALL SELECT word, neighbour, similarity FROM seeds) GROUP BY ALL")
def semantic_network_edges(spark, sf):
    return vectors.network(A.vectors(spark, sf), _SEEDS, 8, 0.1)


@query("vocab_coverage", f"WITH {_VEC}, w AS (SELECT DISTINCT 'w' || (l_orderkey % 900) AS word FROM lineitem) SELECT count(*) AS words, count(n.word) AS found, round(count(n.word) / count(*), 6) AS coverage FROM w LEFT JOIN n USING (word)")
def vocab_coverage(spark, sf):
    words = A.load(spark, sf, "lineitem").select(F.concat(F.lit("w"), (F.col("l_orderkey") % 900).cast("string")).alias("word"))
    return vectors.coverage(A.vectors(spark, sf), words)


@query("out_of_vocabulary", f"WITH {_VEC}, w AS (SELECT DISTINCT 'w' || (l_orderkey % 900) AS word FROM lineitem) SELECT word FROM w ANTI JOIN n USING (word)")
def out_of_vocabulary(spark, sf):
    words = A.load(spark, sf, "lineitem").select(F.concat(F.lit("w"), (F.col("l_orderkey") % 900).cast("string")).alias("word"))
    return vectors.out_of_vocabulary(A.vectors(spark, sf), words)


def _half(name: str, low: int) -> str:
    return f"{name} AS (SELECT word, h AS x, sqrt(list_sum(list_transform(h, lambda e: e * e))) AS n FROM (SELECT word, x[{low}:{low + 31}] AS h FROM v))"


@query("neighbor_stability", f"WITH {_VEC}, {_half('ha', 1)}, {_half('hb', 33)}, {_near('na', 'ha', _SEEDS, 10)}, {_near('nb', 'hb', _SEEDS, 10)} SELECT word, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT word, list(neighbour) AS a FROM na GROUP BY word) JOIN (SELECT word, list(neighbour) AS b FROM nb GROUP BY word) USING (word)")
def neighbor_stability(spark, sf):
    return vectors.stability(A.vectors(spark, sf, 0), A.vectors(spark, sf, 1), _SEEDS)


@query("spearman_pairs", f"WITH {_VEC}, p AS (SELECT 'w' || vec_id AS w1, 'w' || (vec_id + 7) AS w2, (vec_id * 37 % 101)::DOUBLE AS score FROM embeddings), c AS (SELECT score, round(list_dot_product(a.x, b.x) / (a.n * b.n + 1e-12), 9) AS cos FROM p JOIN n a ON a.word = w1 JOIN n b ON b.word = w2), r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs, rank() OVER (ORDER BY cos) + (count(*) OVER (PARTITION BY cos) - 1) / 2 AS rc FROM c) SELECT count(*) AS n, round(corr(rs, rc), 6) AS rho FROM r")
def spearman_pairs(spark, sf):
    i = F.col("vec_id")
    pairs = A.load(spark, sf, "embeddings").select(F.concat(F.lit("w"), i.cast("string")).alias("w1"), F.concat(F.lit("w"), (i + 7).cast("string")).alias("w2"), (i * 37 % 101).cast("double").alias("score"))
    return vectors.rank_correlation(A.vectors(spark, sf), pairs)


@query("semantic_drift")
def semantic_drift(spark, sf):
    return vectors.drift(A.vectors(spark, sf, 0), A.vectors(spark, sf, 1))


@query("model_summary", "SELECT count(*) AS words, max(len(embedding))::INT AS dimensions FROM embeddings")
def model_summary(spark, sf):
    return vectors.summary(A.vectors(spark, sf))


@query("topic_diversity", f"WITH {TFIDF}, {TOPIC_WORD} SELECT round(count(DISTINCT word) / count(*), 6) AS diversity FROM topic_word WHERE pos <= 25")
def topic_diversity(spark, sf):
    return metrics.diversity(A.topic_word(spark, sf))


@query("npmi_coherence", f"""WITH {TFIDF}, {TOPIC_WORD}, top AS (SELECT DISTINCT topic, word FROM topic_word WHERE pos <= 10), here AS (SELECT DISTINCT doc_id, term AS word FROM tf WHERE term IN (SELECT word FROM top)), df AS (SELECT word, count(*) AS df FROM here GROUP BY word),
p AS (SELECT t1.topic, t1.word AS a, t2.word AS b FROM top t1 JOIN top t2 ON t1.topic = t2.topic AND t1.word < t2.word), met AS (SELECT x.word AS a, y.word AS b, count(*) AS n_ab FROM here x JOIN here y ON x.doc_id = y.doc_id AND x.word < y.word GROUP BY ALL), nn AS (SELECT count(DISTINCT doc_id) AS n FROM tf)
SELECT topic, round(avg(CASE WHEN coalesce(n_ab, 0) = 0 THEN -1 ELSE ln((n_ab / n) / ((da.df / n) * (db.df / n)) + 1e-12) / (-ln(n_ab / n + 1e-12)) END), 6) AS npmi FROM p LEFT JOIN met ON met.a = p.a AND met.b = p.b LEFT JOIN df da ON da.word = p.a LEFT JOIN df db ON db.word = p.b, nn GROUP BY topic""")
def npmi_coherence(spark, sf):
    return metrics.npmi(A.topic_word(spark, sf), matrices.term_frequency(A.corpus(spark, sf)))


def _windows_sql(window: int) -> str:
    """Windows that hold each topic word and each pair of them, and their number."""
    return f"""WITH {TFIDF}, {TOPIC_WORD}, top AS (SELECT DISTINCT topic, word FROM topic_word WHERE pos <= 10),
ts AS (SELECT doc_id, regexp_extract_all(content, {W}) AS ts FROM corpus), n AS (SELECT sum(greatest(len(ts) - {window - 1}, 1)) AS n FROM ts),
p AS (SELECT doc_id, unnest(ts) AS word, unnest(range(1, len(ts) + 1)) AS i, len(ts) AS m FROM ts),
here AS MATERIALIZED (SELECT DISTINCT doc_id, word, unnest(range(greatest(i - {window - 1}, 1), least(i, greatest(m - {window - 1}, 1)) + 1)) AS s FROM p WHERE word IN (SELECT word FROM top)),
single AS MATERIALIZED (SELECT word, count(*) AS df FROM here GROUP BY word),
met AS MATERIALIZED (SELECT a.word AS a, b.word AS b, count(*) AS n_ab FROM here a JOIN here b USING (doc_id, s) WHERE (a.word, b.word) IN (SELECT (x.word, y.word) FROM top x JOIN top y USING (topic)) GROUP BY ALL),
pairs AS (SELECT x.topic, x.word AS a, y.word AS b, coalesce(n_ab, 0) / n AS p, sa.df / n * sb.df / n AS apart FROM top x JOIN top y USING (topic) JOIN single sa ON sa.word = x.word JOIN single sb ON sb.word = y.word CROSS JOIN n LEFT JOIN met ON met.a = x.word AND met.b = y.word),
cells AS (SELECT topic, a, b, ln((p + 1e-12) / apart) / -ln(p + 1e-12) AS v FROM pairs)"""


@query("window_coherence", f"{_windows_sql(110)}, sums AS (SELECT *, sum(v) OVER (PARTITION BY topic, b) AS s FROM cells), c AS (SELECT topic, a, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s)) + 1e-12) AS c FROM sums GROUP BY topic, a) SELECT topic, round(avg(c), 6) AS c_v FROM c GROUP BY topic")
def window_coherence(spark, sf):
    docs = A.corpus(spark, sf).select("doc_id", T.tokens(F.col("content")).alias("ts"))
    return metrics.window_coherence(A.topic_word(spark, sf), docs)


@query("window_npmi", f"{_windows_sql(10)} SELECT topic, round(avg(v), 6) AS c_npmi FROM cells WHERE a <> b GROUP BY topic")
def window_npmi(spark, sf):
    docs = A.corpus(spark, sf).select("doc_id", T.tokens(F.col("content")).alias("ts"))
    return metrics.window_coherence(A.topic_word(spark, sf), docs, measure="c_npmi")


@query("cloud_weights", f"WITH {TFIDF}, {SUMS}, {TERMSET}, m AS (SELECT term, round(total / (SELECT count(*) FROM full_corpus), 9) AS mean FROM sums) SELECT word, round(max(mean), 6) AS weight, round(ln(max(mean) + 1), 6) AS size FROM termset JOIN m ON term = word GROUP BY word")
def cloud_weights(spark, sf):
    n = matrices.nonempty(A.corpus(spark, sf)).agg(F.count("*").alias("n"))
    return _rounded(vectors.cloud_weights(A.termset(spark, sf), matrices.term_means(A.tfidf2000(spark, sf), n)), "weight", "size")


from . import index_queries, more_queries  # noqa: E402,F401
