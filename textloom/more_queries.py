"""Queries of sources, Python-backed functions and models; most have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import explore, matrices, models, topics
from .plans import adapters as A
from .queries import CORPUS, DOC_TOPIC, TOK, query
from .sources import markup, sinks, tables

#: Rules of the query: literal, patterns, one that looks around, two that depend on their order.
RULES = [("th", "d"), (r"(?<=d)e\b", "i"), (r"\d+", ""), ("di", "the"), (r"[.,]$", "")]


@query("replacements")
def replacements(spark, sf):
    return A.corpus(spark, sf).select("doc_id", tables.replace_all(F.col("content"), RULES).alias("content"))


@query("html_extract")
def html_extract(spark, sf):
    pages = A.load(spark, sf, "pages").select("page_id", "url", markup.html_text("html").alias("h"))
    return pages.select("page_id", "url", "h.title", "h.content")


@query("xml_paths")
def xml_paths(spark, sf):
    docs = A.load(spark, sf, "nation").select(F.format_string("<TEI><text n='%d'><body><head>%s</head><p>x</p></body></text></TEI>", "n_nationkey", "n_name").alias("xml"))
    return markup.discover_paths(docs)


_TEI = "<TEI xml:id='d%d'><teiHeader><fileDesc><titleStmt><title>Titel %s</title><author><surname>Muster</surname><forename>Anna von</forename></author></titleStmt></fileDesc><profileDesc><creation><date when='18%02d'/></creation></profileDesc></teiHeader><text><body><head>Kopf</head>Text %s</body></text></TEI>"


@query(
    "tei_metadata",
    "SELECT 'd' || n_nationkey AS doc_id, 'Titel ' || n_name AS title, 'Muster' AS author_surname, 'Anna' AS author_prename, (1800 + n_nationkey)::INT AS year, (1800 + n_nationkey)::INT AS first_publication_year, true AS real_author, 'Text ' || n_name AS content FROM nation",
)
def tei_metadata(spark, sf):
    k = F.col("n_nationkey")
    docs = A.load(spark, sf, "nation").select(k.cast("string").alias("doc_id"), F.format_string(_TEI, k, F.col("n_name"), k, F.col("n_name")).alias("xml"))
    return markup.parse_xml(docs).select("doc_id", "title", "author_surname", "author_prename", "year", "first_publication_year", "real_author", "content")


@query("mallet_parse", f"WITH {DOC_TOPIC} SELECT doc_id, i::INT - 1 AS topic, round(weight, 6) AS weight FROM doc_topic JOIN topic_names USING (topic)")
def mallet_parse(spark, sf):
    dt = A.doc_topic(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic", "weight"))).alias("t"))
    lines = dt.select(F.concat_ws("\t", F.lit("0"), "doc_id", F.array_join(F.transform("t", lambda x: x["weight"].cast("string")), "\t")).alias("value"))
    return tables.mallet_document_topics(lines, len(A.TOPICS)).select("doc_id", "topic", F.round("weight", 6).alias("weight"))


@query("mallet_lines", rf"WITH {CORPUS} SELECT concat_ws(chr(9), doc_id, 'X', trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'))) AS value FROM corpus")
def mallet_lines(spark, sf):
    return sinks.mallet_lines(A.corpus(spark, sf))


@query("wide_topics", f"WITH {DOC_TOPIC} SELECT doc_id, topic, round(weight, 6) AS weight FROM doc_topic")
def wide_topics(spark, sf):
    wide = A.doc_topic(spark, sf).groupBy("doc_id").pivot("topic", A.TOPICS).agg(F.first("weight"))
    return tables.document_topics(wide, "doc_id").select("doc_id", "topic", F.round("weight", 6).alias("weight"))


@query("preprocess_stages")
def preprocess_stages(spark, sf):
    from .plans.pipeline import preprocess

    stop = ["the", "of", "and", "de", "la", "der", "die"]
    return preprocess(A.corpus(spark, sf), RULES, stop, []).select("doc_id", "content_min", "content_lem", "content_stop", "content_gen")


_FIRST = "substr(term, 1, 1)"
_PROPER = f"(upper({_FIRST}) = {_FIRST} AND lower({_FIRST}) <> {_FIRST})"


@query("default_tagger", rf"WITH {TOK}, t AS (SELECT CASE WHEN regexp_full_match(term, '[\p{{N}}_]+') THEN 'NUM' WHEN {_PROPER} THEN 'PROPN' WHEN length(term) <= 3 THEN 'DET' ELSE 'NOUN' END AS pos, CASE WHEN {_PROPER} THEN term ELSE lower(term) END AS lemma FROM tok) SELECT pos, count(*) AS n, count(DISTINCT lemma) AS lemmas FROM t GROUP BY pos")
def default_tagger(spark, sf):
    rows = A.corpus(spark, sf).select("doc_id", F.explode(models.initial_tagger(T.tokens(F.col("content")))).alias("t"))
    return rows.groupBy("t.pos").agg(F.count("*").alias("n"), F.countDistinct("t.lemma").alias("lemmas"))


@query("topic_trend_fit")
def topic_trend_fit(spark, sf):
    means = topics.year_means(topics.with_year(A.doc_topic(spark, sf), A.corpus(spark, sf)))
    return models.polynomial(means, "topic", "year", "mean", 3)


@query("stacked_topics", f"WITH {CORPUS}, {DOC_TOPIC}, m AS (SELECT year, topic, round(avg(weight), 6) AS mean FROM doc_topic JOIN corpus USING (doc_id) GROUP BY ALL) SELECT topic, year, mean, round(avg(mean) OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM m")
def stacked_topics(spark, sf):
    means = topics.year_means(topics.with_year(A.doc_topic(spark, sf), A.corpus(spark, sf)))
    return explore.moving_average(means, "mean", 5, ["topic"]).select("topic", "year", "mean", "smooth")


@query("nmf_topics")
def nmf_topics(spark, sf):
    return models.nmf(matrices.tfidf(A.corpus(spark, sf), 500))[1]


@query("lda_topics")
def lda_topics(spark, sf):
    return models.lda(matrices.dtm(A.corpus(spark, sf), 500))[1]


@query("corpus_topics")
def corpus_topics(spark, sf):
    return models.fit_from_corpus(A.corpus(spark, sf))[1]


@query("word2vec")
def word2vec(spark, sf):
    return models.word2vec(A.corpus(spark, sf))


@query("gibbs_topics")
def gibbs_topics(spark, sf):
    return models.fit_from_corpus(A.corpus(spark, sf), model="gibbs")[1]


@query("pca_projection")
def pca_projection(spark, sf):
    return models.pca(A.vectors(spark, sf))


@query("mds_projection")
def mds_projection(spark, sf):
    return models.mds(A.vectors(spark, sf))


@query("agglomerative_clusters")
def agglomerative_clusters(spark, sf):
    return models.clusters(A.vectors(spark, sf), 10)


@query("dendrogram")
def dendrogram(spark, sf):
    return models.dendrogram(A.vectors(spark, sf))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return models.kmeans(A.vectors(spark, sf), 10)
