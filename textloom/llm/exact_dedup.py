"""Exact dedup by a cuckoo-filter index of content digests.

An index holds one live entry per distinct content: its SHA-256 digest and its group
record, in flat arrays. The only way to an entry is a cuckoo filter (buckets of four
slots, two candidate buckets per digest), whose slots hold a 16-bit fingerprint and the
number of the entry. A lookup without a matching fingerprint is "absent" at once; a hit
is verified against the whole digest that its slot points to. Entries can be deleted;
when an insertion finds no free slot, the filter is rebuilt at twice the size from the
stored digests, so nothing is lost.

The rows of one text are combined twice, both times by such an index: first within
each input partition (so that a text with a third of all rows sends one record from
each partition), then in the shard that the digest hashes to. A shard's records come
in the order of their content buckets (the first bytes of the digest), and an index that
has grown to its bound goes out at the end of a bucket, so no task holds a whole shard.

Rows: every input row gets one result row. A null text counts as empty. Among equal
texts the row with the largest doc_id stays; a null doc_id ranks below every other;
of repeated rows with the same doc_id and text the one that is read last stays. An
empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk_cache import release
from .common import cut, join_hot, shuffle_width, tagged, text_of

SLOTS = 4
MAX_KICKS = 256
LOAD = 0.9
#: Bytes of a digest, and of those the ones that name its content bucket.
WIDTH, BUCKET_BYTES = 32, 3
#: Entries of an index from which it is sent on.
FLUSH = 200_000


class CuckooIndex:
    """Digest -> group record (count, largest id, its row tag) behind a cuckoo filter."""

    def __init__(self, capacity: int = 1024):
        self.content = bytearray()
        self.count, self.known, self.ids, self.tags = array("q"), array("b"), array("q"), array("q")
        self.lookups = self.false_hits = self.resizes = 0
        self._allot(capacity)

    def _allot(self, capacity: int) -> None:
        buckets = 1
        while buckets * SLOTS * LOAD < capacity:
            buckets *= 2
        self.mask = buckets - 1
        self.marks, self.entry = array("H", bytes(2 * buckets * SLOTS)), array("I", bytes(4 * buckets * SLOTS))

    def __len__(self) -> int:
        return len(self.count)

    @staticmethod
    def _print(digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0, which marks a free slot) and hash of the first bucket."""
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[2:8], "little")

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _digest(self, entry: int) -> bytes:
        return bytes(self.content[entry * WIDTH : entry * WIDTH + WIDTH])

    def _slots(self, digest: bytes) -> Iterator[int]:
        """The slots that hold the digest's fingerprint."""
        mark, bucket = self._print(digest)
        bucket &= self.mask
        for at in (bucket, self._other(bucket, mark)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.marks[slot] == mark:
                    yield slot

    def may_contain(self, digest: bytes) -> bool:
        return any(True for _ in self._slots(digest))

    def _find(self, digest: bytes) -> int:
        """The slot of a live digest, else -1."""
        self.lookups += 1
        for slot in self._slots(digest):
            if self._digest(self.entry[slot]) == digest:
                return slot
            self.false_hits += 1
        return -1

    def _place(self, entry: int) -> bool:
        mark, bucket = self._print(self._digest(entry))
        bucket &= self.mask
        marks, entries = self.marks, self.entry
        for at in (bucket, self._other(bucket, mark)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not marks[slot]:
                    marks[slot], entries[slot] = mark, entry
                    return True
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            marks[slot], mark = mark, marks[slot]
            entries[slot], entry = entry, entries[slot]
            bucket = self._other(bucket, mark)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not marks[free]:
                    marks[free], entries[free] = mark, entry
                    return True
        return False

    def _resize(self) -> None:
        """Rebuild from the stored digests, larger until every one has a slot; the one that had been kicked out comes back too."""
        room = (self.mask + 1) * SLOTS
        while True:
            self.resizes += 1
            room *= 2
            self._allot(int(room * LOAD))
            if all(map(self._place, range(len(self)))):
                return

    def insert(self, digest: bytes, count: int, doc_id: int | None, tag: int) -> bool:
        """Adds a row or a record of rows; True if its content is new here."""
        slot = self._find(digest)
        if slot >= 0:
            e = self.entry[slot]
            self.count[e] += count
            if (doc_id is not None, doc_id or 0, tag) > (bool(self.known[e]), self.ids[e], self.tags[e]):
                self.known[e], self.ids[e], self.tags[e] = doc_id is not None, doc_id or 0, tag
            return False
        self.content += digest
        for column, value in ((self.count, count), (self.known, doc_id is not None), (self.ids, doc_id or 0), (self.tags, tag)):
            column.append(value)
        if len(self) > (self.mask + 1) * SLOTS * LOAD or not self._place(len(self) - 1):
            self._resize()
        return True

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest and its slot; False if it isn't live. The last entry takes its place."""
        slot = self._find(digest)
        if slot < 0:
            return False
        e, last = self.entry[slot], len(self) - 1
        if e != last:
            moved = self._digest(last)
            self.entry[self._find(moved)] = e
            self.content[e * WIDTH : e * WIDTH + WIDTH] = moved
        for column in (self.count, self.known, self.ids, self.tags):
            column[e] = column[last]
            column.pop()
        del self.content[last * WIDTH :]
        self.marks[slot] = 0
        return True

    def get(self, digest: bytes) -> tuple[int, int | None, int] | None:
        """(count, largest id, its tag) of a live digest."""
        slot = self._find(digest)
        if slot < 0:
            return None
        e = self.entry[slot]
        return self.count[e], self.ids[e] if self.known[e] else None, self.tags[e]

    def digests(self) -> list[bytes]:
        return [self._digest(e) for e in range(len(self))]


_RECORD = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("keep_tag", pa.int64())])
_RECORD_DDL = "digest binary, n long, keep_id long, keep_tag long"


def _records(index: CuckooIndex, chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(index), chunk):
        n = min(chunk, len(index) - i)
        edges = pa.py_buffer(np.arange(0, (n + 1) * WIDTH, WIDTH, dtype=np.int32))
        content = pa.Array.from_buffers(pa.binary(), n, [None, edges, pa.py_buffer(bytes(index.content[i * WIDTH : (i + n) * WIDTH]))])
        count, ids, tags = (np.array(c[i : i + n], np.int64) for c in (index.count, index.ids, index.tags))
        yield pa.RecordBatch.from_arrays([content, pa.array(count), pa.array(ids, mask=np.array(index.known[i : i + n]) == 0), pa.array(tags)], schema=_RECORD)


def _combine(flush_at: int, buckets: bool = False):
    """Combines the records of a partition; an index of flush_at entries goes out, with `buckets` (records in the order of their buckets) at the end of a bucket only. An `op` of 1 after the record deletes its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        index, last = CuckooIndex(), None
        for batch in batches:
            for digest, n, doc_id, tag, *op in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(index) >= flush_at and not (buckets and last == digest[:BUCKET_BYTES]):
                    yield from _records(index)
                    index = CuckooIndex()
                last = digest[:BUCKET_BYTES]
                if op == [1]:
                    index.delete(digest)
                else:
                    index.insert(digest, n, doc_id, tag)
        yield from _records(index)

    return run


def digests(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """(doc_id, digest, tag) of every row; tag (by default a new one) tells repeated rows apart."""
    tag = F.monotonically_increasing_id() if tag is None else tag
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(), 256)).alias("digest"), tag.alias("tag"))


def _local(keys: DataFrame) -> DataFrame:
    """Records of the rows of each input partition."""
    return keys.select("digest", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag")).mapInArrow(_combine(FLUSH), _RECORD_DDL)


def _sharded(records: DataFrame, *within: str) -> DataFrame:
    """Records by shard, within it by content bucket and then by the columns `within`."""
    return records.repartition(shuffle_width(records.sparkSession), "digest").sortWithinPartitions(F.substring("digest", 1, BUCKET_BYTES), *within).mapInArrow(_combine(FLUSH, True), _RECORD_DDL)


def build_index(keys: DataFrame) -> DataFrame:
    """The live index: one record (digest, n, keep_id, keep_tag) per distinct content, sharded by digest."""
    return _sharded(_local(keys))


def apply_changes(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """A later state of an index: digests of `deleted` (a column digest) leave it, then the rows of `inserted` (from `digests`) enter it."""
    gone = deleted.select("digest").dropDuplicates().select("digest", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("keep_tag"), F.lit(1).alias("op"))
    every = index.withColumn("op", F.lit(0)).unionByName(gone).unionByName(_local(inserted).withColumn("op", F.lit(2)))
    return _sharded(every, "op")


def exact_dedup(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and tag (see `digests`)."""
    keys = cut(digests(docs, tag))
    groups = cut(build_index(keys))
    return join_hot(keys, groups, "digest", ["n", "keep_id", "keep_tag"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("keep_tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "tag",
    )


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).drop("tag")


def keep_first_class(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, tag = tagged(docs)
    gone = exact_dedup(rows, F.col(f"`{tag}`")).filter(~F.col("kept")).select(F.col("tag").alias(tag))
    return rows.join(gone, tag, "left_anti").drop(tag)


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
