"""SentencePiece encoding and decoding by streaming Viterbi.

A text goes through `unigram.Unigram`: it is cut where all paths have a boundary, a chunk is
encoded in a window that is bounded by the maximum piece length and the distance to the next
boundary on which all surviving backpointer paths converge, and the ids up to there are
committed. Chunks already met are looked up. Texts are encoded and decoded where they are
read; nothing is shuffled.

Rows: a null or empty text has no ids and decodes to the empty text. A text that itself holds
U+2581 decodes with a blank in its place (as in the library), and so does not come back as it
was; every other text does. Repeated rows are encoded each for itself, other columns (of any
name but `ids` and `decoded`, which are replaced) pass through; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import ChunkCache, byte_slices, give_back, held
from .common import text_of
from .unigram import model


def _cache(path: str) -> ChunkCache:
    unigram = model(path)

    def encode_new(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [unigram.encode_chunk(c) for c in chunks]
        return np.array([i for ids in found for i in ids], np.uint32), np.array(list(map(len, found)), np.int64)

    return held(("pieces", path), lambda: ChunkCache(encode_new))


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts, one after the other, and the number of ids of each."""
    return _cache(path).encode(model(path).chunk_lists(texts))


def encode(df: DataFrame, path: str, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all, if None) and `ids` array<int>. What isn't kept isn't sent to the Python workers."""
    kept = [c for c in (df.columns if keep is None else keep) if c != "ids"]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], text_of(f"`{column}`"))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, n in byte_slices(texts, 2_000_000):
                ids, sizes = encode_texts(path, texts.slice(at, n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns[:-1], lists], names=[*kept, "ids"])
        give_back()

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """df with `decoded` string."""
    kept = [c for c in df.columns if c != "decoded"]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{column}`").cast("array<int>"), F.array().cast("array<int>")))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ids, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = [unigram.decode(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return rows.mapInArrow(run, schema)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(path)
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                part = batch.slice(at, n)
                ids, sizes = encode_texts(path, part.column(1))
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
                same = [unigram.decode(ids[a:b]) == t for a, b, t in zip(edges, edges[1:], part.column(1).to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return run


def document_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip (whether decoding the ids gives the text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
