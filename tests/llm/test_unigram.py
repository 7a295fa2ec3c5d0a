import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from sentencepiece import sentencepiece_model_pb2 as proto  # noqa: E402

from textloom.llm import sentencepiece_codec, token_counts, unigram  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return unigram.Unigram(PATH)


@pytest.fixture(scope="module")
def library():
    """The library's own unigram model of the pieces. Scores of -1e9 (runs of blanks) would swamp its float32 sums; -5e5 is as far out of reach."""
    m = proto.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -500000.0
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts(n=600):
    rng = random.Random(4)
    words = ["the", "and", "thindst", "ering", "über", "él", "日本", "x1.", "hello,", "😀", "ab" * 20]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(n)]
    made += ["".join(rng.choice("abcde fgth\nÄé😀in") for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [*made, "", " ", "  a  b ", "\n\n", "x"]


def test_ids_and_counts_are_the_librarys(model, library):
    for t in texts():
        ids = [i for c in model.chunks(t) for i in model.encode_chunk(c)]
        assert ids == library.encode(t)
        assert sum(model.count_chunk(c)[0] for c in model.chunks(t)) == len(ids)
        assert model.decode(np.array(ids, np.int64)) == t


def test_chunks_of_columns_are_those_of_texts(model):
    made = [*texts(), "a  b\n \nc", "▁x ▁▁y", " \x00 cut\x01 ", "  "]
    for part in (made, made[:50]):
        assert [[c for c in cs if c] for cs in model.chunk_lists(pa.array(part)).to_pylist()] == [model.chunks(t) for t in part]


def test_other_normalisation_is_refused(tmp_path):
    for change in ("charsmap", "symbol"):
        m = proto.ModelProto.FromString(open(PATH, "rb").read())
        if change == "charsmap":
            m.normalizer_spec.remove_extra_whitespaces = True
        else:
            m.pieces[500].type = proto.ModelProto.SentencePiece.USER_DEFINED
        (tmp_path / change).write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            unigram.Unigram(str(tmp_path / change))


def test_stream_commits_early_and_finds_the_same(model, monkeypatch):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(6000))
    parts = list(model.stream(t))
    monkeypatch.setattr(unigram, "LOOK", 10**9)
    assert len(parts) > 5 and [i for p in parts for i in p] == model.encode_chunk(t)
    n, score = model.count_chunk(t)
    assert n == len(model.encode_chunk(t)) and score < 0


def test_queries_on_edge_rows(spark, docs, empty, model):
    want = sorted(((r.doc_id, [i for c in model.chunks(r.text or "") for i in model.encode_chunk(c)]) for r in docs.collect()), key=str)
    rows = sentencepiece_codec.document_digests(docs, PATH).collect()
    assert all(r.round_trip for r in rows)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect()), key=str) == sorted(((d, len(i)) for d, i in want), key=str)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PATH), PATH)
    assert both.columns == [*docs.columns, "ids", "decoded"]
    assert all((r.text or "") == r.decoded for r in both.collect())
    for f in (sentencepiece_codec.document_digests, token_counts.token_counts, sentencepiece_codec.encode):
        assert f(empty, PATH).count() == 0
