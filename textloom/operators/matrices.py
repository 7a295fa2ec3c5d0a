"""Vocabularies, document-term and TF-IDF matrices in long form, rankings, cosine similarity.

A corpus is a DataFrame with doc_id, content and metadata columns. Matrices are tables
(doc_id, term, value) of their non-zero cells; `wide` pivots one for export.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..sources.kept import forget, kept, numbered

#: Value band of the rank's term selection.
BAND = (0.0, 0.9)


def nonempty(corpus: DataFrame) -> DataFrame:
    """Documents with a letter in their content."""
    return corpus.filter(T.has_letter(F.col("content")))


def token_rows(corpus: DataFrame, pattern: str = T.WORD, lowercase: bool = False, *keep: str) -> DataFrame:
    """One row per token: doc_id, kept columns, term."""
    return corpus.select("doc_id", *keep, F.explode(T.tokens(F.col("content"), pattern, lowercase)).alias("term"))


def term_counts(corpus: DataFrame) -> DataFrame:
    """(term, n), case-sensitive."""
    return token_rows(corpus).groupBy("term").agg(F.count("*").alias("n"))


def top_terms(corpus: DataFrame, n: int) -> DataFrame:
    by = Window.orderBy(F.desc("n"), "term")
    return term_counts(corpus).orderBy(F.desc("n"), "term").limit(n).withColumn("rank", F.row_number().over(by))


def slice_counts(corpus: DataFrame, intervals: list[tuple[int, int]] = ()) -> DataFrame:
    """(kind, slice, term, n): counts of the full corpus, of each textclass, genre (a comma list) and year interval, in one pass."""
    tags = [F.array(F.struct(F.lit("full").alias("kind"), F.lit("full").alias("slice")))]
    tags.append(F.transform(F.filter(F.array("textclass"), lambda x: x.isNotNull()), lambda x: F.struct(F.lit("textclass").alias("kind"), x.alias("slice"))))
    tags.append(F.transform(F.array_distinct(T.tag_list(F.col("genre"))), lambda x: F.struct(F.lit("genre").alias("kind"), x.alias("slice"))))
    for a, b in intervals:
        inside = F.coalesce(F.col("year").between(a, b), F.lit(False))
        tags.append(F.when(inside, F.array(F.struct(F.lit("interval").alias("kind"), F.lit(f"{a}-{b}").alias("slice")))).otherwise(F.array().cast("array<struct<kind:string,slice:string>>")))
    # documents of the same slices are counted together before the slices part
    per_doc = corpus.select(F.concat(*tags).alias("tags"), T.tokens(F.col("content")).alias("ts"))
    rows = per_doc.select("tags", F.explode("ts").alias("term")).groupBy("tags", "term").agg(F.count("*").alias("n"))
    return rows.select(F.explode("tags").alias("tag"), "term", "n").groupBy("tag.kind", "tag.slice", "term").agg(F.sum("n").alias("n"))


def slice_header(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "slice").agg(F.count("*").alias("vocabulary_size"), F.sum("n").alias("total_tokens"))


def term_frequency(corpus: DataFrame, lowercase: bool = False, *keep: str) -> DataFrame:
    """(doc_id, kept columns, term, tf) of tokens of two characters and more."""
    return token_rows(nonempty(corpus), T.WORD2, lowercase, *keep).groupBy("doc_id", *keep, "term").agg(F.count("*").alias("tf"))


def only_terms(rows: DataFrame, terms: list[str], column: str = "term") -> DataFrame:
    """The rows of the searched terms, outer blanks aside; every row if nothing is searched for."""
    wanted = [t.strip() for t in terms if t.strip()]
    return rows.filter(F.col(column).isin(wanted)) if wanted else rows


def aligned(ids: DataFrame, meta: DataFrame) -> DataFrame:
    """A row for each row of ids (doc_id, ...), in whatever order these have, with the columns of its document's metadata; nulls where there is none. meta: one row per doc_id."""
    return ids.join(meta, "doc_id", "left")


def _vocabulary(tf: DataFrame, top: int | None, min_count: int, by: list[str]) -> DataFrame:
    """(by..., term, cf, df) of the commonest terms, ties in the order of the terms."""
    counts = tf.groupBy(*by, "term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).filter(F.col("cf") >= min_count)
    if top is None:
        return counts
    if not by:
        return counts.orderBy(F.desc("cf"), "term").limit(top)
    turn = Window.partitionBy(*by).orderBy(F.desc("cf"), "term")
    return counts.withColumn("__r", F.row_number().over(turn)).filter(F.col("__r") <= top).drop("__r")


def vocabulary(corpus: DataFrame, top: int | None = None, min_count: int = 1) -> DataFrame:
    return _vocabulary(term_frequency(corpus), top, min_count, [])


def _within(tf: DataFrame, n_docs: DataFrame, top: int | None, min_count: int, min_df: int, max_df: float) -> DataFrame:
    """(term, cf, df): the commonest of the terms that stand in min_df documents or more, and in a share of max_df at most. n_docs: one row (n)."""
    if min_df <= 1 and max_df >= 1:
        return _vocabulary(tf, top, min_count, [])
    known = _vocabulary(tf, None, min_count, []).crossJoin(F.broadcast(n_docs)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).drop("n")
    return known.orderBy(F.desc("cf"), "term").limit(top) if top else known


def dtm(corpus: DataFrame, top: int | None = None, min_count: int = 1, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(doc_id, term, tf)."""
    tf = term_frequency(corpus)
    n_docs = nonempty(corpus).agg(F.count("*").alias("n"))
    return tf.join(_within(tf, n_docs, top, min_count, min_df, max_df).select("term"), "term").select("doc_id", "term", "tf")


#: Terms up to which a vocabulary is sent to all tasks.
SENT = 50_000


def _capped(corpus: DataFrame, top: int, lowercase: bool, by: list[str]) -> DataFrame:
    """(by..., doc_id, term, tf) of the commonest terms, `top` for each `by`, stored. Tokens of other terms are left out before documents are dealt, so that these aren't shuffled. At most SENT terms."""
    words = token_rows(nonempty(corpus), T.WORD2, lowercase, *by)
    counts = words.groupBy(*by, "term").agg(F.count("*").alias("tf"))
    chosen = _vocabulary(counts, top, 1, by).select(*by, "term")
    return kept(words.join(F.broadcast(chosen), [*by, "term"]).groupBy("doc_id", *by, "term").agg(F.count("*").alias("tf")))


def _weigh(tf: DataFrame, vocab: DataFrame, n_docs: DataFrame, by: list[str]) -> DataFrame:
    known = tf.join(vocab.select(*by, "term", "df"), [*by, "term"])
    known = known.join(F.broadcast(n_docs), by) if by else known.crossJoin(F.broadcast(n_docs))  # one row, or one per interval
    raw = known.withColumn("v", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*by, "doc_id")))
    return raw.select(*by, "doc_id", "term", (F.col("v") / norm).alias("tfidf"))


def tfidf(corpus: DataFrame, top: int | None = None, lowercase: bool = False, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(doc_id, term, tfidf): smooth idf, rows of length 1."""
    n_docs = nonempty(corpus).agg(F.count("*").alias("n"))
    if top is not None and top <= SENT and min_df <= 1 and max_df >= 1:
        tf = _capped(corpus, top, lowercase, [])
        return _weigh(tf, F.broadcast(_vocabulary(tf, None, 1, [])), n_docs, [])
    tf, n_docs = kept(term_frequency(corpus, lowercase)), kept(n_docs)  # each is read twice, for the vocabulary and for the cells
    return _weigh(tf, _within(tf, n_docs, top, 1, min_df, max_df), n_docs, [])


def in_intervals(corpus: DataFrame, intervals: list[tuple[int, int]]) -> DataFrame:
    """Documents with the label of each inclusive year interval that they fall in; unknown years fall in none."""
    labels = F.filter(F.array(*[F.when(F.col("year").between(a, b), F.lit(f"{a}-{b}")) for a, b in intervals]), lambda x: x.isNotNull())
    return corpus.withColumn("interval", F.explode(labels))


def interval_tfidf(corpus: DataFrame, intervals: list[tuple[int, int]], top: int = 2000, lowercase: bool = True) -> DataFrame:
    """(interval, doc_id, term, tfidf), each interval a corpus of its own."""
    parts = in_intervals(nonempty(corpus), intervals)
    n_docs = parts.groupBy("interval").agg(F.count("*").alias("n"))
    if top * len(intervals) <= SENT:
        tf = _capped(parts, top, lowercase, ["interval"])
        return _weigh(tf, F.broadcast(_vocabulary(tf, None, 1, ["interval"])), n_docs, ["interval"])
    tf = term_frequency(parts, lowercase, "interval")
    return _weigh(tf, _vocabulary(tf, top, 1, ["interval"]), n_docs, ["interval"])


def term_sums(matrix: DataFrame, value: str = "tfidf") -> DataFrame:
    return matrix.groupBy("term").agg(F.sum(value).alias("total"))


def term_means(matrix: DataFrame, n_docs: DataFrame, value: str = "tfidf") -> DataFrame:
    """(term, mean, rank): means over all documents, those without the term count as zeros. n_docs: one row (n)."""
    means = term_sums(matrix, value).crossJoin(F.broadcast(n_docs)).select("term", F.round(F.col("total") / F.col("n"), 9).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "term")))


def selected_terms(matrix: DataFrame, top: int) -> DataFrame:
    """Terms with the highest sums of values within the band."""
    v = F.col("tfidf")
    masked = F.when((v > BAND[0]) & (v < BAND[1]), v).otherwise(0.0)
    return matrix.groupBy("term").agg(F.round(F.sum(masked), 9).alias("s")).orderBy(F.desc("s"), "term").limit(top)


def document_rank(matrix: DataFrame, top: int) -> DataFrame:
    """(doc_id, combined_sum, rank): documents by the sum of all their values of the selected terms, in or out of the band."""
    chosen = matrix.join(selected_terms(matrix, top).select("term"), "term")
    sums = chosen.groupBy("doc_id").agg(F.round(F.sum("tfidf"), 6).alias("combined_sum"))
    return numbered(sums, "rank", F.desc("combined_sum"), F.asc("doc_id")).withColumn("rank", F.col("rank").cast("int"))


def term_matrix(matrix: DataFrame, top: int) -> DataFrame:
    """(term, position, doc_id, tfidf): the selected terms' rows."""
    terms = selected_terms(matrix, top).withColumn("position", F.row_number().over(Window.orderBy(F.desc("s"), "term")))
    return matrix.join(terms.select("term", "position"), "term").select("term", "position", "doc_id", "tfidf")


def wide(matrix: DataFrame, terms: list[str], value: str) -> DataFrame:
    """One column per term, zeros where there is no cell; for export."""
    return matrix.groupBy("doc_id").pivot("term", terms).agg(F.first(value)).na.fill(0)


#: Rows of a block of `cosine_pairs`, about, and columns that are dense at once.
BLOCK, COLUMNS = 1024, 4096
#: Columns, of the terms with the largest sums of squares, by which two blocks are compared at first.
LEADING = 128
#: Pairs that a task of `cosine_pairs` holds and sorts before they leave it, about, and those that leave it at once.
HELD, SLICE = 2_000_000, 50_000


def _pack_rows(schema: pa.Schema):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = np.array([len(x) for x in table.column("idx").to_pylist()], "<i4")
        idx, val = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("idx", "val"))
        columns = [[k.as_py()] for k in key] + [[table.column("doc_id").to_pylist()], [sizes.tobytes()], [idx.astype("<i4").tobytes()], [val.astype("<f8").tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _dense(block: tuple, low: int, width: int, kind: type) -> np.ndarray:
    """`width` columns from low on of a block (sizes, idx, val) of sparse rows."""
    sizes, idx, val = block
    hit = (idx >= low) & (idx < low + width)
    x = np.zeros((len(sizes), width), kind)
    x[np.repeat(np.arange(len(sizes)), sizes)[hit], idx[hit] - low] = val[hit]
    return x


def _some(block: tuple, rows: np.ndarray) -> tuple:
    """The given rows of a block, in its order."""
    sizes, idx, val = block
    chosen = np.zeros(len(sizes), bool)
    chosen[rows] = True
    at = np.repeat(chosen, sizes)
    return sizes[rows], idx[at], val[at]


def _leading(block: tuple) -> np.ndarray:
    """The leading columns of a block and, as one more, the length of the rest of each row: products of such rows are bounds of the cosines."""
    sizes, idx, val = block
    rest = idx >= LEADING
    squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[rest], weights=val[rest] ** 2, minlength=len(sizes))
    return np.hstack([_dense(block, 0, LEADING, np.float32), np.sqrt(squares).astype(np.float32)[:, None]])


def _products(a: tuple, b: tuple, kind: type = np.float64) -> np.ndarray:
    """Dot products of all rows of two blocks, by the columns that both have."""
    out = np.zeros((len(a[0]), len(b[0])), kind)
    if len(a[1]) and len(b[1]):
        end = int(min(a[1].max(), b[1].max())) + 1
        shared = np.flatnonzero((np.bincount(a[1], minlength=end)[:end] > 0) & (np.bincount(b[1], minlength=end)[:end] > 0))
        place = np.full(int(max(a[1].max(), b[1].max())) + 1, -1, np.int32)
        place[shared] = np.arange(len(shared), dtype=np.int32)
        a, b = ((sizes, place[idx], val) for sizes, idx, val in (a, b))  # others fall before the first column
        for low in range(0, len(shared), COLUMNS):
            width = min(COLUMNS, len(shared) - low)
            x = _dense(a, low, width, kind) @ _dense(b, low, width, kind).T
            out = out + x if low else x
    return out


def _alike(a: tuple, b: tuple, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cosine) of the pairs with at least min_cos. Bounds leave the rows that may have some; of these, products in single precision leave the pairs that may be, others can't by the bound of its error; these are computed in double precision."""
    error = 1e-5 + 2e-7 * max(a[0].max(), b[0].max())  # rows of length 1, sums of so many products
    may = _leading(a) @ _leading(b).T >= min_cos - error
    of_a, of_b = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(of_a):
        return of_a, of_b, np.zeros(0)
    a, b = _some(a, of_a), _some(b, of_b)
    x, y = np.nonzero(_products(a, b, np.float32) >= min_cos - error)
    if not len(x):
        return x, y, np.zeros(0)
    left, x_at = np.unique(x, return_inverse=True)
    right, y_at = np.unique(y, return_inverse=True)
    cosine = np.round(_products(_some(a, left), _some(b, right))[x_at, y_at], 6)
    hit = cosine >= min_cos
    return of_a[x[hit]], of_b[y[hit]], cosine[hit]


def _similar(by: list[str], min_cos: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, ids, held, size = {}, {}, [], [], 0  # `first`: where the ids of a block begin

        def given() -> Iterator[pa.RecordBatch]:
            """The pairs held, equal cosines together: then each of their few values is stored once and refers to few places."""
            if not held:
                return
            part, a, b, cosine = (np.concatenate(c) for c in zip(*held, strict=True))
            order, names = np.argsort(part * 4.0 + cosine), pa.array(ids, pa.string())  # cosines lie within 1
            kinds = [pa.array(c, t) for c, t in zip(zip(*parts, strict=True), schema.types, strict=False)]
            for k in range(0, len(order), SLICE):
                at = order[k : k + SLICE]
                columns = [*[c.take(pa.array(part[at])) for c in kinds], *[names.take(pa.array(c[at])) for c in (a, b)], pa.array(cosine[at])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                a, b = ((np.frombuffer(row[f"sizes_{x}"], "<i4"), np.frombuffer(row[f"idx_{x}"], "<i4"), np.frombuffer(row[f"val_{x}"], "<f8")) for x in "ab")
                place = np.unique(np.array(row["ids_a"] + row["ids_b"], object), return_inverse=True)[1]  # order of the ids
                x, y, cosine = _alike(a, b, min_cos)
                z = y + len(a[0])
                if row["i"] == row["j"]:
                    once = place[x] < place[z]
                    x, y, z, cosine = x[once], y[once], z[once], cosine[once]
                if not len(x):
                    continue
                of = tuple(row[c] for c in by)
                part = parts.setdefault(of, len(parts))
                for side, block in (("ids_a", "i"), ("ids_b", "j")):
                    if (of, row[block]) not in first:
                        first[of, row[block]] = len(ids)
                        ids += row[side]
                turned, p, q = place[x] > place[z], first[of, row["i"]] + x, first[of, row["j"]] + y
                held.append((np.full(len(x), part, np.int32), np.where(turned, q, p).astype(np.int32), np.where(turned, p, q).astype(np.int32), cosine))
                size += len(x)
                if size >= HELD:
                    yield from given()
                    parts, first, ids, held, size = {}, {}, [], [], 0
        yield from given()

    return run


def cosine_pairs(matrix: DataFrame, min_cos: float, by: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(by..., doc_a, doc_b, cosine) of pairs doc_a < doc_b with at least min_cos; rows of the matrix have length 1.

    Rows are packed sparsely into blocks in the order of their heaviest terms, and each pair of
    blocks is one product of dense matrices, of those rows that may have a similar one: exact bounds
    from the LEADING columns and the lengths of the rest leave out others, as most of other languages.
    Only similar pairs leave it. Work grows with the square of the documents, as it does for
    the full matrix. Pairs of blocks come from a Cartesian product, which reads the stored
    blocks again for each part of them; so nothing that grows with the square is shuffled or stored.
    Pairs leave a task by their cosine, HELD at a time, and tasks are few for the blocks there are,
    as a result that is written needs less than half the space in this order.
    """
    by = list(by)
    cells = matrix.filter(~F.lower("term").isin([e.lower() for e in exclude])) if exclude else matrix
    if exclude:  # rows without the excluded terms get length 1 again
        cells = cells.withColumn("tfidf", F.col("tfidf") / F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy(*by, "doc_id"))))
    cells = kept(cells)
    squares = F.sum(F.col("tfidf") * F.col("tfidf"))
    terms = kept(cells.groupBy("term").agg(squares.alias("squares")).select("term", (F.row_number().over(Window.orderBy(F.desc("squares"), "term")) - 1).alias("i")))
    heaviest = F.transform(F.slice(F.sort_array(F.transform("c", lambda e: F.struct(e.tfidf, e.i)), False), 1, 3), lambda e: e.i)
    rows = cells.join(F.broadcast(terms) if terms.count() <= SENT else terms, "term").groupBy(*by, "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "tfidf"))).alias("c")).select(*by, "doc_id", F.col("c.i").alias("idx"), F.col("c.tfidf").alias("val"), heaviest.alias("heaviest"))
    placed = numbered(rows, "at", *by, "heaviest", "doc_id").drop("heaviest")
    n = F.count("*")
    sized = cells.groupBy(*by, "doc_id").agg(F.lit(1)).groupBy(*by).agg(n.alias("n"), F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(n * 8 / BLOCK), F.lit(8))).alias("blocks"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if by else F.lit(0)
    sized = sized.select(*by, before.alias("before"), F.ceil(F.col("n") / F.col("blocks")).alias("size"))
    dealt = placed.join(F.broadcast(sized), by) if by else placed.crossJoin(F.broadcast(sized))  # one row, or one per interval
    dealt = dealt.withColumn("block", F.floor((F.col("at") - 1 - F.col("before")) / F.col("size")).cast("int")).drop("at", "before", "size")
    names = [T_.StructField(c, matrix.schema[c].dataType) for c in by]
    packed_type = T_.StructType([*names, T_.StructField("block", T_.IntegerType()), T_.StructField("ids", T_.ArrayType(T_.StringType())), *[T_.StructField(c, T_.BinaryType()) for c in ("sizes", "idx", "val")]])
    width = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = kept(dealt.repartition(width, *by, "block").groupBy(*by, "block").applyInArrow(_pack_rows(to_arrow_schema(packed_type)), packed_type))
    forget(placed)
    forget(cells)
    packed = packed.coalesce(math.ceil(2 * math.sqrt(width)))  # tasks are the square of it
    side = {x: packed.select(*[F.col(c).alias(f"{c}_{x}") for c in (*by, "ids", "sizes", "idx", "val")], F.col("block").alias(n)) for x, n in (("a", "i"), ("b", "j"))}
    on = F.col("i") <= F.col("j")
    for c in by:  # not as an equation, by which all blocks of an interval would be dealt to one task
        on = on & (F.col(f"{c}_a") <= F.col(f"{c}_b")) & (F.col(f"{c}_a") >= F.col(f"{c}_b"))
    both = side["a"].join(side["b"], on).withColumnsRenamed({f"{c}_a": c for c in by})
    result = T_.StructType([*names, T_.StructField("doc_a", T_.StringType()), T_.StructField("doc_b", T_.StringType()), T_.StructField("cosine", T_.DoubleType())])
    return both.mapInArrow(_similar(by, min_cos, to_arrow_schema(result)), result)


def cosine_all(matrix: DataFrame) -> DataFrame:
    """(doc_a, doc_b, cosine) of all pairs that share a term, by a self-join on terms; for small corpora."""
    a, b = matrix.select(F.col("doc_id").alias("doc_a"), "term", F.col("tfidf").alias("x")), matrix.select(F.col("doc_id").alias("doc_b"), "term", F.col("tfidf").alias("y"))
    return a.join(b, "term").filter("doc_a <= doc_b").groupBy("doc_a", "doc_b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))
