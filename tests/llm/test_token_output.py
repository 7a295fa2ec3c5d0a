import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import token_output as O
from textloom.llm.chunk_cache import ChunkCache

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), O.WordEncoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 70), st.integers(0, 2**64 - 1)), max_size=90), max_size=6))
def test_pack_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint64)
    sizes = np.array([len(d) for d in docs], np.int64)
    words, offsets, escapes = O.pack(ids, sizes)
    assert O.unpack(words, offsets, sizes, escapes).tolist() == ids.tolist()
    for k in range(len(docs)):  # each document alone
        end = offsets[k + 1] if k + 1 < len(docs) else len(words)
        assert O.unpack(words[offsets[k] : end], np.zeros(1, np.int64), sizes[k : k + 1], escapes).tolist() == docs[k]


def test_words_hold_as_many_ids_as_fit():
    assert len(O.pack(np.ones(60), np.array([60]))[0]) == 1
    assert len(O.pack(np.full(8, 1000), np.array([8]))[0]) == 2
    assert len(O.pack(np.array([1, 2**59]), np.array([2]))[0]) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcde,.'  \n")), max_size=30), min_size=1, max_size=8))
def test_ids_are_the_librarys(texts):
    texts = [*texts, "<|endoftext|> don't <|x"]
    ids, sizes = ENCODER.encode(pa.array(texts))
    want = [x.ids for x in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_cache_forgets(monkeypatch):
    cache = ChunkCache(lambda new: (np.array([len(c) for c in new], np.uint32), np.ones(len(new), np.int64)), limit=3)
    for parts in ([["a", "bb"]], [["ccc", "dddd", "a"]], [["bb"], [], ["a", "a"]]):
        ids, sizes = cache.encode(pa.array(parts, pa.list_(pa.string())))
        assert ids.tolist() == [len(c) for p in parts for c in p] and sizes.tolist() == list(map(len, parts))


def test_files(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_IDS", 50)
    O.write_tokens(docs, PATH, str(tmp_path / "t"))
    found = sorted(map(tuple, O.document_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    start = 0
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (doc_id, text), got in zip(rows, found, strict=True):
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2]
        assert got == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    O.write_tokens(empty, PATH, str(tmp_path / "e"))
    assert O.document_digests(spark, str(tmp_path / "e")).count() == 0


def test_cache_grows_and_keeps_what_is_used():
    made = []
    cache = ChunkCache(lambda new: (made.extend(new), (np.array([int(c) for c in new for _ in range(int(c) % 3)], np.uint32), np.array([int(c) % 3 for c in new], np.int64)))[1], limit=5_000)
    for step in range(12):
        texts = [[str(i) for i in [*range(100), *range(step * 4000, step * 4000 + 4000)]], []]
        ids, sizes = cache.encode(pa.array(texts, pa.list_(pa.string())))
        assert ids.tolist() == [int(c) for c in texts[0] for _ in range(int(c) % 3)] and sizes.tolist() == [len(ids), 0]
    assert made.count("7") == 1 and len(cache.index) <= 9_100
