import hashlib
import random

from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm import exact_dedup as E


def test_index_inserts_deletes_and_resizes():
    rng, index, truth = random.Random(1), E.CuckooIndex(8), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for _ in range(30_000):
        key = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(key) == (truth.pop(key, None) is not None)
        else:
            assert index.insert(key, 1, 7, 0) == (key not in truth)
            truth[key] = truth.get(key, 0) + 1
    assert {k: index.get(k)[0] for k in index.digests()} == truth and len(index) == len(truth)
    assert all(index.may_contain(k) for k in truth) and index.resizes > 0
    assert sum(index.may_contain(hashlib.sha256(f"no{i}".encode()).digest()) for i in range(5000)) < 50


def test_equal_fingerprints_are_told_apart():
    index = E.CuckooIndex()
    a, b = b"\x01\x02" + b"\x00" * 30, b"\x01\x02" + b"\x00" * 29 + b"\x01"
    assert index.insert(a, 1, 1, 0) and index.insert(b, 1, 2, 0)
    assert index.false_hits == 1 and index.delete(a) and index.get(b)[0] == 1 and index.get(a) is None


def test_full_buckets_overflow_into_a_resize():
    index = E.CuckooIndex()
    keys = [b"\x05\x00" + bytes(6) + i.to_bytes(4, "big") + bytes(20) for i in range(3)]
    for k in keys:
        index.insert(k, 1, 1, 0)
    assert all(index.get(k) for k in keys)


def test_rows(docs):
    rows = E.exact_dedup(docs).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(rows) == len(texts)
    by = {}
    for i, t in texts:
        by.setdefault(t, []).append(i)
    for r in rows:
        ids = next(v for t, v in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(by)


def test_stage_keeps_columns_and_one_row_of_each(docs, empty):
    out = E.keep_first_class(docs)
    assert out.columns == docs.columns and out.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert E.exact_dedup(empty).count() == 0 and E.keep_first_class(empty).count() == 0


def test_small_indexes(docs, monkeypatch):
    want = sorted(map(str, E.exact_dedup(docs).drop("tag").collect()))
    monkeypatch.setattr(E, "FLUSH", 1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, E.exact_dedup(docs).drop("tag").collect())) == want


def test_changes_to_an_index(docs):
    index = E.build_index(E.digests(docs))
    gone = docs.filter("text = 'one two'").select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    new = docs.filter("doc_id = 1")
    out = {r.digest.hex(): r for r in E.apply_changes(index, E.digests(new), gone).collect()}
    assert hashlib.sha256(b"one two").hexdigest() not in out
    assert out[hashlib.sha256(new.first().text.encode()).hexdigest()].n == 3
