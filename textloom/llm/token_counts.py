"""Token counts by count-only Viterbi.

Aho-Corasick enumerates the pieces that end at each character; each position keeps the best
score and the number of ids on its way, with the tie rules of `unigram`, and no path is ever
traced back. Chunks between boundaries that all paths share are looked up when met again.

Rows: a null or empty text has 0 tokens. Every row is counted for itself, repeated ones too;
an empty table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_cache import ChunkCache, byte_slices, held, list_edges
from .common import text_of
from .unigram import model


class _Counts:
    """Counts and scores of chunks, one pair for each."""

    def __init__(self, path: str):
        self.unigram = model(path)
        self.cache = ChunkCache(self._new, dtype=np.dtype([("n", np.int64), ("score", np.float64)]))

    def _new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.unigram.count_chunk(c) for c in chunks], self.cache.flat.dtype), np.ones(len(chunks), np.int64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self.unigram.chunk_lists(texts)
        place, edges = self.cache.looked_up(parts.flatten()), list_edges(parts)
        found = self.cache.flat[self.cache.start[place]]
        totals = [np.concatenate([[0], np.cumsum(found[c])]) for c in ("n", "score")]
        return tuple(t[edges[1:]] - t[edges[:-1]] for t in totals)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held(("counts", path), lambda: _Counts(path))
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                tokens, score = counts.count(batch.column(1).slice(at, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_run(path), "doc_id long, n_tokens long, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
