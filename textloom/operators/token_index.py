"""Positional token index: built once, asked often.

A folder of four tables. `documents` holds the texts and their tokens in the order of doc_id, in blocks of about
`block_tokens` tokens that are partitions of the folder. `offsets` has a row a document: its
block, its row in it, the number of tokens before it in the corpus and its own, and the metadata
kept. `postings` has rows of a term in a block: delta-coded row numbers, the number of
occurrences in each, and delta-coded positions; it is sorted by term in small row groups, so that
a filter on terms reads few of them. A term's postings are cut wherever a task had read
FLUSH tokens, so no row grows with the corpus, and ranges of (term, block, row) spread
a common term over tasks. `vocabulary` has the occurrences and documents of each term.

Questions are answered from as little as they need: frequencies, phrases and pairs of words from
postings, concordances and collocations from the blocks of `documents` that the postings name.
Each gives what its counterpart in `explore` gives on the corpus.

Rows: a null content has no tokens. Repeated doc_ids are documents each; a null doc_id comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import kept
from . import explore

BLOCK_TOKENS = 8_000_000
#: Tokens after which a task of the build gives its postings away.
FLUSH = 1_000_000
#: Terms or blocks up to which they are literals of a filter, which prunes row groups or folders; beyond, tables to join with.
LITERALS = 1000
#: Documents up to which a table of them is broadcast.
BROADCAST_ROWS = 100_000

_POSTINGS = "term string, block int, first_row int, n long, n_docs long, rows array<int>, counts array<int>, gaps array<int>"


def build(corpus: DataFrame, path: str, keep: tuple[str, ...] = (), block_tokens: int = BLOCK_TOKENS, flush: int = FLUSH) -> TokenIndex:
    """Index of (doc_id, content) in a new folder `path` that all executors see, with the metadata columns `keep`."""
    spark = corpus.sparkSession
    total = corpus.agg(F.sum(T.token_count(F.col("content"), T.WORD)).alias("n")).first().n or 0
    ordered = corpus.select("doc_id", *keep, "content").repartitionByRange(max(1, -(-total // block_tokens)), "doc_id").sortWithinPartitions("doc_id")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int")
    placed = ordered.withColumns({"block": F.spark_partition_id(), "row": row}).sortWithinPartitions("block", "row")
    placed = placed.withColumn("tokens", T.tokens(F.col("content")))
    folders = [] if corpus.isEmpty() else ["block"]  # no folder, no file: an empty table would have no schema
    placed.withColumn("n_tokens", F.size("tokens").cast("long")).write.partitionBy(*folders).parquet(f"{path}/documents")
    index = TokenIndex(spark, path)

    docs = index.documents.select("block", "row", "doc_id", *keep, "n_tokens")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    bases = docs.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    starts = docs.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(bases), "block")
    starts.select("block", "row", "doc_id", *keep, (F.col("base") + F.col("within")).alias("start"), "n_tokens").write.partitionBy(*folders).parquet(f"{path}/offsets")

    lists = index.documents.select("block", "row", "tokens").mapInArrow(_invert(flush), _POSTINGS)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["term", "block", "first_row"]
    lists.repartitionByRange(width, *place).sortWithinPartitions(*place).write.option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    index.postings.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")).repartitionByRange(width, "term").sortWithinPartitions("term").write.parquet(f"{path}/vocabulary")
    return index


def _invert(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= flush:
                yield from _posting_rows(held)
                held, size = [], 0
        if held:
            yield from _posting_rows(held)

    return run


def _posting_rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the documents held, which come in the order of their rows in each block."""
    docs = pa.Table.from_batches(held)
    for block in sorted(set(docs.column(0).to_pylist())):
        part = docs.filter(pa.compute.equal(docs.column(0), block)).sort_by("row").combine_chunks()
        lists = part.column(2).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        words = lists.flatten().dictionary_encode()
        if not len(words):
            continue
        lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        code = words.indices.to_numpy()
        row = np.repeat(part.column(1).to_numpy(), lengths)
        at = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(code, kind="stable")
        code, row, at = code[order], row[order], at[order]
        new_term = np.diff(code, prepend=-1) != 0
        new_doc = new_term | (np.diff(row, prepend=-1) != 0)
        firsts, docs_at = np.flatnonzero(new_term), np.flatnonzero(new_doc)
        gaps = np.where(new_doc, at, np.diff(at, prepend=0))
        doc_rows = row[docs_at]
        steps = np.where(new_term[docs_at], 0, np.diff(doc_rows, prepend=0))
        ends = np.append(firsts, len(code))
        doc_ends = np.searchsorted(docs_at, ends)
        lists_of = [(doc_ends, steps), (doc_ends, np.diff(np.append(docs_at, len(code)))), (ends, gaps)]
        yield pa.RecordBatch.from_arrays(
            [
                words.dictionary.take(pa.array(code[firsts])),
                pa.array(np.full(len(firsts), block), pa.int32()),
                pa.array(row[firsts], pa.int32()),
                pa.array(np.diff(ends), pa.int64()),
                pa.array(np.diff(doc_ends), pa.int64()),
                *[pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int32())) for e, v in lists_of],
            ],
            names=[c.split()[0] for c in _POSTINGS.split(", ")],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, row, positions) of each document in rows of postings."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, counts, gaps = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("rows", "counts", "gaps"))
            ends = np.concatenate([[0], np.cumsum(counts)])
            total = np.cumsum(gaps)
            # a document's first gap is its first position
            positions = total - np.repeat(total[ends[:-1]] - gaps[ends[:-1]], counts)
            same = [pa.array([batch.column(c)[i].as_py()] * len(rows), k) for c, k in (("term", pa.string()), ("block", pa.int32()))]
            row = pa.array(np.cumsum(rows) + batch.column("first_row")[i].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([*same, row, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions, pa.int32()))], names=["term", "block", "row", "positions"])


def _minus(k: int):
    return lambda p: p - k


def _pairs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of positions of b within the window of one of a, itself not counted, for each a."""
        for batch in batches:
            counts = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                own = np.searchsorted(y, x, "right") - np.searchsorted(y, x)
                counts.append(int((np.searchsorted(y, x + window, "right") - np.searchsorted(y, x - window) - own).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("row"), pa.array(counts, pa.int64())], names=["block", "row", "count"])

    return run


class TokenIndex:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def documents(self) -> DataFrame:
        return self._table("documents")

    @property
    def offsets(self) -> DataFrame:
        return self._table("offsets")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def vocabulary(self) -> DataFrame:
        return self._table("vocabulary")

    def _postings_of(self, terms: DataFrame | list[str]) -> DataFrame:
        """Postings of the terms, with further columns of the table `terms`."""
        if isinstance(terms, list):
            return self.postings.filter(F.col("term").isin(terms))
        found = terms.limit(LITERALS + 1).collect()
        if len(found) <= LITERALS:
            few = self.spark.createDataFrame(found, terms.schema)
            return self.postings.filter(F.col("term").isin([r.term for r in found])).join(F.broadcast(few), "term")
        return self.postings.join(terms, "term")

    def entries(self, terms: list[str]) -> DataFrame:
        """(term, block, row, positions) of the documents that hold the terms, positions from 0."""
        return self._postings_of(terms).select("term", "block", "first_row", "rows", "counts", "gaps").mapInArrow(_entries, "term string, block int, row int, positions array<int>")

    def _counts(self, postings: DataFrame, weight: Column) -> DataFrame:
        """(block, row, count): occurrences times weight, added up."""
        weighed = postings.select("block", "first_row", "rows", "counts", weight.cast("long").alias("w"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pa.compute.list_value_length(batch.column("rows")).to_numpy(zero_copy_only=False)
                steps, counts = (batch.column(c).flatten().to_numpy() for c in ("rows", "counts"))
                first = np.cumsum(sizes) - sizes
                total = np.cumsum(steps)
                row = total - np.repeat(total[first], sizes) + np.repeat(batch.column("first_row").to_numpy(), sizes)
                block, w = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("block", "w"))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(row, pa.int32()), pa.array(counts * w, pa.int64())], names=["block", "row", "n"])

        return weighed.mapInArrow(spread, "block int, row int, n long").groupBy("block", "row").agg(F.sum("n").alias("count"))

    def term_counts(self, terms: list[str]) -> DataFrame:
        """(doc_id, term, n) of the documents that hold the terms."""
        found = self.entries(terms).select("term", "block", "row", F.size("positions").cast("long").alias("n"))
        return found.join(self.offsets, ["block", "row"]).select("doc_id", "term", "n")

    def document_frequency(self, terms: list[str], scale: int = 10_000, case_sensitive: bool = False) -> DataFrame:
        """As `explore.document_frequency` for literal terms without regex, each within a word: from vocabulary and postings alone."""
        terms = [t.strip() for t in terms if t.strip()]
        if not terms:
            raise ValueError("no terms")
        if any(not re.fullmatch(r"\w+", t) for t in terms):
            raise ValueError("terms that aren't within one word: use explore.document_frequency")
        weight = T.contains_words(F.col("term"), terms, case_sensitive=case_sensitive)
        words = self.vocabulary.select("term", weight.alias("w")).filter("w > 0")
        counts = self._counts(self._postings_of(words), F.col("w"))
        rows = counts.join(self.offsets.select("block", "row", "doc_id", F.col("n_tokens").alias("length")), ["block", "row"])
        return rows.select("doc_id", "count", "length", F.round(F.col("count") / F.col("length") * scale, 2).alias("density"))

    def _documents_with(self, term: str, ignore_case: bool) -> DataFrame | None:
        """(block, row) of the documents that have each word of the term within a word; None if it has none."""
        found = None
        for word in set(re.findall(r"\w+", term)):
            pattern = ("(?iu)" if ignore_case else "") + T.quote(word)
            words = self.vocabulary.filter(F.rlike("term", F.lit(pattern))).select("term")
            rows = self._counts(self._postings_of(words), F.lit(1)).select("block", "row")
            found = rows if found is None else found.join(rows, ["block", "row"], "left_semi")
        return found

    def _texts(self, places: DataFrame | None) -> DataFrame:
        """The documents of the places: their blocks' folders only, and where they are few no others in them."""
        if places is None:
            return self.documents
        places = kept(places)
        blocks = places.select("block").distinct()
        few = [r.block for r in blocks.limit(LITERALS + 1).collect()]
        docs = self.documents.filter(F.col("block").isin(few)) if len(few) <= LITERALS else self.documents.join(F.broadcast(blocks), "block", "left_semi")
        return docs.join(F.broadcast(places), ["block", "row"], "left_semi") if places.count() <= BROADCAST_ROWS else docs

    def concordance(self, term: str, context: int = 50, keep: tuple[str, ...] = (), whole_word: bool = False, ignore_case: bool = False) -> DataFrame:
        """As `explore.concordance`, reading the texts of documents that hold the term's words."""
        texts = self._texts(self._documents_with(term, ignore_case))
        return explore.concordance(texts, term, context, keep, whole_word=whole_word, ignore_case=ignore_case)

    def first_hits(self, term: str, most: int, context: int = 50, keep: tuple[str, ...] = (), whole_word: bool = False, ignore_case: bool = False) -> DataFrame:
        """The first `most` hits of `concordance` by doc_id: blocks are read in order, ever more at a time, until there are enough."""
        places = self._documents_with(term, ignore_case)
        blocks = sorted(r.block for r in (self.offsets if places is None else places).select("block").distinct().collect())  # a row per block
        parts, left, step = [], most, 1
        while blocks and left > 0:
            some, blocks, step = blocks[:step], blocks[step:], 2 * step
            texts = self.documents.filter(F.col("block").isin(some))
            hits = explore.concordance(texts, term, context, ("block", "row", *keep), whole_word=whole_word, ignore_case=ignore_case)
            parts.append(kept(hits.orderBy("block", "row", "hit").limit(left)))
            left -= parts[-1].count()
        if not parts:
            return explore.concordance(self.documents.limit(0), term, context, keep)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("block", "row")

    def collocations(self, targets: list[str], window: int = 5, min_freq: int = 3, top: int = 100, measure: str = "freq", ngram: int = 1) -> DataFrame:
        """As `explore.collocations`, from the tokens of documents that hold a target; totals come from the vocabulary."""
        places = self.entries(targets).select("block", "row").distinct()
        pairs = explore.windows(self._texts(places), targets, window, ngram=ngram, tokens=F.col("tokens"))
        counts = self.vocabulary.select(F.col("term").alias("collocate"), "n")
        if ngram > 1:
            counts = self.documents.select(F.explode(T.ngrams(F.col("tokens"), ngram)).alias("collocate")).groupBy("collocate").agg(F.count("*").alias("n"))
        of_target = self.vocabulary.filter(F.col("term").isin(targets)).select(F.col("term").alias("target"), F.col("n").alias("n_target"))
        return explore.score_collocations(pairs, counts, of_target, min_freq, top, measure)

    def collocation_documents(self, target: str, collocate: str, window: int = 5) -> DataFrame:
        """As `explore.collocation_documents`, from the positions of both words."""
        a, b = (self.entries([t]).select("block", "row", F.col("positions").alias(c)) for t, c in ((target, "a"), (collocate, "b")))
        counts = a.join(b, ["block", "row"]).mapInArrow(_pairs(window), "block int, row int, count long").filter("count > 0")
        return counts.join(self.offsets, ["block", "row"]).select("doc_id", "count")

    def phrases(self, words: list[str]) -> DataFrame:
        """(doc_id, count, first): occurrences of the words as consecutive tokens, overlapping ones too, and the first one's position."""
        places = {w: self.entries([w]).select("block", "row", F.col("positions").alias(f"p{i}")) for i, w in enumerate(dict.fromkeys(words))}
        names = {w: f"p{i}" for i, w in enumerate(places)}
        rows = places[words[0]]
        for w in list(places)[1:]:
            rows = rows.join(places[w], ["block", "row"])
        start = F.col(names[words[0]])
        for k, w in enumerate(words[1:], 1):
            start = F.array_intersect(start, F.transform(names[w], _minus(k)))
        found = rows.select("block", "row", start.alias("s")).filter(F.size("s") > 0)
        return found.join(self.offsets, ["block", "row"]).select("doc_id", F.size("s").cast("long").alias("count"), F.array_min("s").alias("first"))

    def word_trends(self, terms: list[str], scale: int = 1_000_000) -> DataFrame:
        """As `explore.word_trends`, of an index that keeps `year`: from postings and offsets."""
        dated = self.offsets.filter("year is not null")
        totals = dated.groupBy("year").agg(F.sum("n_tokens").alias("total"))
        counted = self.entries(terms).select("term", "block", "row", F.size("positions").cast("long").alias("n")).join(dated, ["block", "row"]).groupBy("term", "year").agg(F.sum("n").alias("n"))
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        spine = explore.year_spine(dated.select("year")).join(totals, "year", "left").crossJoin(F.broadcast(asked))  # years times terms
        n = F.coalesce("n", F.lit(0))
        rows = spine.join(counted, ["term", "year"], "left")
        return rows.select("term", "year", n.alias("n"), F.when(F.col("total") > 0, F.round(n / F.col("total") * scale, 6)).otherwise(0.0).alias("per_scale"))
