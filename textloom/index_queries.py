"""Queries answered from the positional index, most with the SQL of their counterparts on the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import token_index
from .plans import adapters as A
from .queries import CORPUS, ORACLES, TERMS, TOK, W, query
from .sources.kept import shared_folder

#: Of this session, by application and folder of tables: an index is built by the first question.
_BUILT: dict[tuple[str, str], token_index.TokenIndex] = {}


def index(spark, sf) -> token_index.TokenIndex:
    key = spark.sparkContext.applicationId, sf
    if key not in _BUILT:
        path = f"{shared_folder(spark).rstrip('/')}/textloom-index-{uuid.uuid4().hex}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
        _BUILT[key] = token_index.build(A.corpus(spark, sf), path, ("genre", "year"))
    return _BUILT[key]


@query("index_vocabulary", f"WITH {TOK} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY term")
def index_vocabulary(spark, sf):
    return index(spark, sf).vocabulary


@query("index_offsets", f"WITH {CORPUS}, n AS (SELECT doc_id, len(regexp_extract_all(content, {W})) AS n_tokens FROM corpus) SELECT doc_id, coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n_tokens FROM n")
def index_offsets(spark, sf):
    return index(spark, sf).offsets.select("doc_id", "start", "n_tokens")


@query("index_positions", f"WITH {CORPUS}, ts AS (SELECT doc_id, regexp_extract_all(content, {W}) AS ts FROM corpus), p AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS position FROM ts) SELECT * FROM p WHERE term IN ({', '.join(repr(t) for t in TERMS)})")
def index_positions(spark, sf):
    built = index(spark, sf)
    rows = built.entries(TERMS).join(built.offsets.select("block", "row", "doc_id"), ["block", "row"])
    return rows.select("doc_id", "term", F.explode(F.col("positions").cast("array<long>")).alias("position"))


@query("index_document_frequency", ORACLES["document_frequency"])
def index_document_frequency(spark, sf):
    return index(spark, sf).document_frequency(TERMS)


@query("index_kwic", ORACLES["kwic"])
def index_kwic(spark, sf):
    return index(spark, sf).concordance("the", 20)


@query("index_kwic_capped", ORACLES["kwic_capped"])
def index_kwic_capped(spark, sf):
    return index(spark, sf).first_hits("the", 500, 20)


@query("index_collocations_freq", ORACLES["collocations_freq"])
def index_collocations_freq(spark, sf):
    return index(spark, sf).collocations(["the", "de"])


@query("index_collocations_pmi", ORACLES["collocations_pmi"])
def index_collocations_pmi(spark, sf):
    return index(spark, sf).collocations(["the", "de"], measure="pmi")


@query("index_collocations_bigram_pmi", ORACLES["collocations_bigram_pmi"])
def index_collocations_bigram_pmi(spark, sf):
    return index(spark, sf).collocations(["the", "de"], measure="pmi", ngram=2)


@query("index_collocation_documents", ORACLES["collocation_documents"])
def index_collocation_documents(spark, sf):
    return index(spark, sf).collocation_documents("the", "of")


@query("index_phrases", f"WITH {CORPUS}, ts AS (SELECT doc_id, regexp_extract_all(content, {W}) AS ts FROM corpus), p AS (SELECT doc_id, unnest(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the')) - 1 AS pos FROM ts) SELECT doc_id, count(*) AS count, min(pos)::INT AS first FROM p GROUP BY doc_id")
def index_phrases(spark, sf):
    return index(spark, sf).phrases(["of", "the"])


@query("index_word_trends", ORACLES["word_trends"])
def index_word_trends(spark, sf):
    return index(spark, sf).word_trends(TERMS)
