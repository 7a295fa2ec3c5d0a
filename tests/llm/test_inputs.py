"""Clashing column names, frames that aren't scans, very long texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import common, exact_dedup, mixing, near_dup, pii, sentencepiece_codec, token_counts, token_output, toxicity, unigram

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
NAMES = ["row_tag", "spans", "__text", "__ids", "mix_domain", "mix_domain_of", "mix_epochs", "__tag", "domain", "tokens", "h", "part", "class_id", "kept", "digest"]


@pytest.fixture(scope="module")
def clashing(docs):
    df = docs.select(*docs.columns[:5])
    for k, n in enumerate(NAMES):
        df = df.withColumn(n, F.lit(k))
    # a shuffle below: splits and order may differ each time it runs
    return df.repartition(5)


@pytest.mark.parametrize("stage", [exact_dedup.keep_first_class, near_dup.keep_one_of_each, pii.sanitised, mixing.keep_selected, lambda d: toxicity.keep_clean(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int"))])
def test_clashing_names_come_through(clashing, stage):
    out = stage(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)


def test_encode_beside_clashing_names(clashing):
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(clashing, PIECES), PIECES)
    assert out.columns == [*clashing.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") and r.__getitem__("__ids") == 3 for r in out.collect())


def test_own_folder_on_one_machine_only(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:  # noqa: N801
            @staticmethod
            def isDefined():  # noqa: N802
                return False

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(9)
    words = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 10))) for _ in range(200_000))
    unbroken = "".join(rng.choice("etaoinshrß") for _ in range(1_100_000))
    return [(1, words), (2, words + " end"), (3, unbroken), (4, unbroken), (5, "x"), (6, " " * 1_000_000)]


def test_long_texts(spark, long_rows, tmp_path):
    assert len(long_rows[0][1]) > 1_000_000
    path = str(tmp_path / "d")
    spark.createDataFrame(long_rows, "doc_id long, text string").coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    links = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect()}
    assert links == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 0)}
    token_output.write_tokens(docs, WORDS, str(tmp_path / "t"))
    tokenizer = Tokenizer.from_file(WORDS)
    digests = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.document_digests(spark, str(tmp_path / "t")).collect()}
    for i, text in long_rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert digests[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
    model = unigram.model(PIECES)
    sizes = {i: sum(len(model.encode_chunk(c)) for c in model.chunks(t)) for i, t in long_rows}
    rows = sentencepiece_codec.document_digests(docs, PIECES).collect()
    assert all(r.round_trip for r in rows) and {r.doc_id: r.n_tokens for r in rows} == sizes
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECES).collect()} == sizes
    assert len(toxicity.score_texts(docs, toxicity.Model({"toe": 1.0})).collect()) == len(long_rows)
