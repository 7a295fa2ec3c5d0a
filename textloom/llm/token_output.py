"""Token ids as files of Simple-8b words.

A 64-bit word holds a selector (top 4 bits) and as many ids as fit its 60 bits at one
width. Documents are dealt by ranges of doc_id to shards, sorted and encoded; a shard's
ids are stored in blocks of whole documents. A block row holds

- `doc_ids`, `sizes`, `offsets`: for each document its id, its number of token ids and the
  index of its first word (each document starts a new word, so one can be decoded alone),
- `words`: the words as little-endian unsigned 64-bit integers,
- `escapes`: ids of 2**60 and more, as such integers; a word with selector 0 holds an index
  into them,
- `first_id`, `n_ids`: ids of the shard before the block, and ids in it.

The rows are kept as parquet, so that any store that Spark writes to can hold them. All
words of a block are decoded at once, selector by selector.

Rows: a null text counts as empty; each document gets the end id, so that an empty one has
one id. Null doc_ids come first; repeated doc_ids are ordered by text and each has a result
row. An empty table gives no files and an empty result. Columns other than doc_id and text
play no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_cache import ChunkCache, byte_slices, gathered, held, list_edges, release
from .common import scratch_path, shuffle_width, text_of

#: The ids in a word and the bits of each, for selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
#: A block is closed when it has at least so many ids.
BLOCK_IDS = 1 << 16
END_ID = 2

_PAD = max(COUNTS)
_SELECTOR = np.zeros(_PAD + 1, np.uint64)
_SELECTOR[list(COUNTS)] = np.arange(1, len(COUNTS) + 1)


def _window_max(m: np.ndarray, known: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Maximum of m[i:i + width] at each i, from maxima of smaller widths; past the end there are zeros."""
    if width not in known:
        half = 1 << (width - 1).bit_length() - 1
        left = _window_max(m, known, half)
        right = _window_max(m, known, width - half)
        out = left.copy()
        out[: len(m) - half] = np.maximum(out[: len(m) - half], right[half:])
        known[width] = out
    return known[width]


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Place of the narrowest width that holds an id; one more than the last for an escape."""
    if len(ids) > len(_RANKS) and ids.max() < len(_RANKS):
        return _RANKS[ids]
    ids = ids.astype(np.uint64)
    rank = np.zeros(len(ids), np.uint8)
    for bits in BITS:
        rank += (ids >> np.uint64(bits) != 0).astype(np.uint8)
    return rank


_RANKS = np.zeros(0, np.uint8)
_RANKS = _ranks(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, escapes) of documents whose ids stand one after the other in `ids`."""
    sizes = sizes.astype(np.int64)
    # zeros after each document: no word takes ids of the next one
    starts = np.cumsum(sizes + _PAD) - (sizes + _PAD)
    padded = np.zeros(int((sizes + _PAD).sum()), np.uint64)
    rank = np.zeros(len(padded), np.uint8)
    known_ranks, at_id = _ranks(ids), 0
    for i, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        padded[i : i + n] = ids[at_id : at_id + n]
        rank[i : i + n] = known_ranks[at_id : at_id + n]
        at_id += n
    escapes = ids[known_ranks == len(BITS)].astype(np.uint64)
    step = np.ones(len(padded), np.uint8)
    known = {1: rank}
    for k in range(len(COUNTS) - 2, -1, -1):
        if COUNTS[k] > 8 and not (rank <= k).any():
            break
        step[_window_max(rank, known, COUNTS[k]) <= k] = COUNTS[k]
    hops = step.tobytes()
    at: list[int] = []
    add = at.append
    first = np.zeros(len(sizes), np.int64)
    for d, (i, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        first[d] = len(at)
        end = i + n
        while i < end:
            add(i)
            i += hops[i]
    where = np.array(at, np.int64)
    took = step[where]
    words = np.zeros(len(where), np.uint64)
    for count, bits in zip(COUNTS, BITS, strict=True):
        hit = np.flatnonzero(took == count)
        if len(hit):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            values = padded[where[hit][:, None] + np.arange(count)] << shifts
            words[hit] = np.bitwise_or.reduce(values, axis=1) | _SELECTOR[count] << np.uint64(60)
    large = np.flatnonzero(rank[where] == len(BITS))
    words[large] = np.arange(len(large), dtype=np.uint64)
    return words, first, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids that `pack` was given."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *COUNTS])[selector]
    before = np.concatenate([[0], np.cumsum(counts)])
    n_words = np.diff(np.concatenate([offsets, [len(words)]]))
    doc = np.repeat(np.arange(len(sizes)), n_words)
    target = (ends - sizes)[doc] + before[:-1] - before[offsets][doc] if len(words) else np.zeros(0, np.int64)
    limit = ends[doc]
    for k, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        hit = np.flatnonzero(selector == k)
        if len(hit):
            values = words[hit][:, None] >> (np.arange(count) * bits).astype(np.uint64) & np.uint64((1 << bits) - 1)
            to = target[hit][:, None] + np.arange(count)
            inside = to < limit[hit][:, None]
            out[to[inside]] = values[inside]
    hit = np.flatnonzero(selector == ESCAPE)
    if len(hit):
        out[target[hit]] = escapes[(words[hit] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


#: The normaliser and pre-tokenizer under which a word of plain letters is one pre-token, and marks after it another.
_PLAIN_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks that are taken off the end of a piece; an apostrophe begins a pre-token of its own.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "'_")
_MARK_PATTERN = "^(?s:.*?)([" + "".join("\\" + c for c in _MARKS) + "]*)$"
#: Latin-1 letters: NFC leaves them as they are.
_LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for characters from U+0100 on; a blank stays a blank here."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)} | {0x20: " "}


class WordEncoder:
    """A tokenizer file of the tokenizers library, over texts cut at blanks and line feeds.

    Only for tokenizers whose pre-tokenizer never joins characters across white space and
    whose normaliser doesn't look across it; then the ids of the pieces are those of the text.
    New pieces are encoded together, parted by a special token of the tokenizer. If the file
    has the normaliser and pre-tokenizer named above and marks word ends, pieces of Latin-1
    letters (where NFC changes nothing) and marks after them go to the library's BPE as words
    already normalised, which is several times faster and gives the same ids. The pieces of a
    slice of text are made distinct before any of this.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = next((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special)
        self.pieces = ChunkCache(self._encode_any, limit=150_000, chars=4_000_000)
        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("normalizer") or {}).get("normalizers", [])
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = made["model"].get("end_of_word_suffix")
        self.plain = {s["type"] for s in steps} == _PLAIN_NORMALIZERS and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex") == _PLAIN_SPLIT and bool(suffix)
        if self.plain:
            self.bpe = Tokenizer(self.tokenizer.model)
            self.bpe.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self.tokenizer.get_vocab()
            self.is_end = np.zeros(max(vocab.values()) + 1, bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self.letters = _byte_letters()
            self.stems = ChunkCache(self._encode_stems)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [x.ids for x in batch(texts, add_special_tokens=False)]

    def _encode_any(self, new: list[str], together: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.mark.join(new[i : i + together]) for i in range(0, len(new), together)]
        ids = np.array([i for x in self._ids(self.tokenizer, parts) for i in (*x, self.mark_id)], np.uint32)
        ends = np.flatnonzero(ids == self.mark_id)
        if len(ends) != len(new):  # a piece holds the special token itself
            found = self._ids(self.tokenizer, new)
            return np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64)
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def _encode_stems(self, stems: list[str], together: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        words = " ".join(stems).encode().decode("latin-1").translate(self.letters).split(" ")
        found = self._ids(self.bpe, [" ".join(words[i : i + together]) for i in range(0, len(words), together)])
        ids = np.array(list(chain.from_iterable(found)), np.uint32)
        return ids, np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)

    def _encode_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain:
            place = self.pieces.places(pieces.to_pylist())
            ids, ends = gathered(self.pieces.flat, self.pieces.start[place], self.pieces.size[place])
            return ids, self.pieces.size[place]
        bare = pc.utf8_rtrim(pieces, _MARKS)
        easy = pc.match_substring_regex(bare, _LETTERS)
        is_easy = easy.to_numpy(zero_copy_only=False)
        begin, size = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        # a stem of letters and its marks, or a piece of any other kind, each from its own cache
        stem = self.stems.looked_up(pc.utf8_lower(bare.filter(easy)))
        mark = self.pieces.looked_up(pa.concat_arrays([pc.replace_substring_regex(pieces.filter(easy), _MARK_PATTERN, r"\1"), pieces.filter(pc.invert(easy))]))
        mark, other = mark[: len(stem)], mark[len(stem) :]
        begin[is_easy, 0], size[is_easy, 0] = self.stems.start[stem], self.stems.size[stem]
        used = self.stems.used
        begin[is_easy, 1], size[is_easy, 1] = used + self.pieces.start[mark], self.pieces.size[mark]
        begin[~is_easy, 0], size[~is_easy, 0] = used + self.pieces.start[other], self.pieces.size[other]
        ids, _ = gathered(np.concatenate([self.stems.flat[:used], self.pieces.flat[: self.pieces.used]]), begin.ravel(), size.ravel())
        return ids, size.sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and the number of ids of each."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        flat, sizes = self._encode_distinct(coded.dictionary)
        place = coded.indices.to_numpy(zero_copy_only=False)
        ids, ends = gathered(flat, (np.cumsum(sizes) - sizes)[place], sizes[place])
        return ids, np.diff(np.concatenate([[0], ends])[list_edges(lists)])


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "sizes", "offsets", "words", "escapes")], ("null_ids", pa.int64())])
_BLOCK_DDL = "shard int, block int, first_id long, n_ids long, doc_ids binary, sizes binary, offsets binary, words binary, escapes binary, null_ids long"


def _with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", path), lambda: WordEncoder(path))
        shard, block, first = None, 0, 0  # of a task's documents the first one's shard; they are in the order of the shards
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_waiting = 0

        def close() -> pa.RecordBatch:
            nonlocal block, first, n_waiting
            docs = [d for part, _, _ in waiting for d in part]
            ids, sizes = np.concatenate([x for _, x, _ in waiting]), np.concatenate([x for _, _, x in waiting])
            words, offsets, escapes = pack(ids, sizes)
            nulls = sum(d is None for d in docs)  # they come first
            row = [shard, block, first, len(ids), np.array([d or 0 for d in docs], "<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), nulls]
            block, first, n_waiting = block + 1, first + len(ids), 0
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            if shard is None and batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for at, n in byte_slices(batch.column(1)):
                ids, sizes = _with_end(*encoder.encode(batch.column(1).slice(at, n)), end_id)
                waiting.append((doc_ids[at : at + n], ids, sizes))
                n_waiting += len(ids)
                if n_waiting >= BLOCK_IDS:
                    yield close()
        if waiting:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the ids of docs (doc_id, text) to `path`, in ascending order of doc_id over the shards."""
    n = shuffle_width(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    # the ranges come from the ids alone; a range exchange would read all texts for its sample
    ends = docs.select(doc_id.alias("d")).agg(F.percentile_approx("d", [k / n for k in range(1, n)] or [1.0], 10_000).alias("ends")).first().ends or []
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in sorted(set(ends))]), lambda e: e < F.col("doc_id"))) if n > 1 and ends else F.lit(0)
    ordered = docs.select(doc_id.alias("doc_id"), text_of().alias("text")).withColumn("shard", F.coalesce(F.when(F.col("doc_id").isNull(), 0).otherwise(shard), F.lit(0)).cast("int"))
    ordered = ordered.repartitionById(n, "shard").sortWithinPartitions("shard", "doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer, end_id), _BLOCK_DDL).write.option("compression", "zstd").parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    """The block rows of `path` with `start`: ids of all documents before the block."""
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row per shard, of which there are as many as write_tokens made partitions
    return blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first_id")).drop("before")


def decode_block(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a block row."""
    doc_ids: list = np.frombuffer(row["doc_ids"], "<i8").tolist()
    doc_ids[: row["null_ids"]] = [None] * row["null_ids"]
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    offsets = np.frombuffer(row["offsets"], "<u4").astype(np.int64)
    return doc_ids, sizes, unpack(np.frombuffer(row["words"], "<u8"), offsets, sizes, np.frombuffer(row["escapes"], "<u8"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            doc_ids, sizes, ids = decode_block(row)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
            starts = ends - sizes
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    return read_blocks(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path)
    return document_digests(spark, path)
