"""Byte-level BPE against the tiktoken library."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from momentloom.llm import bpe  # noqa: E402
from momentloom.llm.queries import QUERIES, RANKS  # noqa: E402

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "a", "the the  the\n\n\tthe", "<|endoftext|> x", "é" * 700, "a" * 5000, " x y \U0001f600́",
         "'s 'S it's 12345 ½ ٣٤", "\x00\x1c\x1f\x85", "ab" * 3000 + " zz"]


def test_texts_like_the_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        want = library.encode_ordinary(r.text or "")
        assert struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)) == tuple(want)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_pieces_like_the_library(ranks, library):
    pieces = [bytes(range(k, k + n)) for k in range(0, 200, 7) for n in (1, 2, 3, 17, 33)] + [b"th" * 40, b"\xff\xfe\xff"]
    for piece, ids in zip(pieces, bpe.PieceEncoder(ranks).encode(pieces)):
        want = library._core_bpe.encode_single_piece(piece)
        assert struct.pack(f"<{len(want)}I", *want) == ids


def test_long_pieces_like_short_ones_and_in_time(ranks, monkeypatch):
    import random
    import time

    rand = random.Random(4)
    encoder = bpe.PieceEncoder(ranks)
    pieces = [bytes(rand.choice(b"etaoin") for _ in range(n)) for n in (2_049, 4_095, 9_000)] + [b"a" * 6_000, bytes(range(256)) * 20]
    alone = encoder.encode(pieces)
    monkeypatch.setattr(bpe, "ALONE", 1 << 40)
    assert alone == encoder.encode(pieces)
    monkeypatch.undo()
    began = time.time()
    ids = np.frombuffer(encoder.encode([bytes(rand.choice(b"etaoinshrdlu") for _ in range(1 << 20))])[0], dtype="<u4")
    assert 2**18 < len(ids) < 2**20 and time.time() - began < 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_query_over_all_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    out = QUERIES["op8_byte_bpe"](spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
