import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lumenspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  ", "\n", "a", " a", "'s", "''s", " 's", "\n's", "it's 're're 'll'l 'lll 'd've 'r 'v", "!'s x'T", "a  b\t\tc \n d  ", "12３٤ ½x", "x  y　 z", "\x1c\x1d a\x85b", "naïve ÇA été 日本語 한글 😀👍🏽 é", "\x00\x00'm\x00", "don't", "   'll   ", "'", "a'", "'re"]


def test_pieces_equal_library(ranks, library):
    rng = random.Random(1)
    chars = "ab sS'tredvlm  \n\t.,!1２é日  😀\x1c"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 700))) for _ in range(600)] + ["a" * 3000, "ab" * 2000, " " * 5000, "é" * 999]
    encoder = bpe.Encoder(ranks)
    ids, start, bounds = bpe.encode_batch(texts, encoder)
    for i, text in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert own == library.encode_ordinary(text), text
        parts = [library.decode_single_token_bytes(x) for x in own]
        assert start[bounds[i] : bounds[i + 1]].tolist() == np.cumsum([0, *map(len, parts)])[: len(parts)].tolist()


def test_classes_equal_library_on_every_code_point(ranks, library):
    found = bpe.classes()
    text = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    sample = text[:0x3100] + text[0x3100::37]
    # "a" + x joins if x is a letter; "1" + x if it's a number; x + "  " tells white space
    encoder = bpe.Encoder(ranks)
    lines = [f"a{x}a1{x}1!{x}! {x}" for x in sample]
    ids, _, bounds = bpe.encode_batch(lines, encoder)
    bad = [hex(ord(x)) for i, x in enumerate(sample) if ids[bounds[i] : bounds[i + 1]].tolist() != library.encode_ordinary(lines[i])]
    assert not bad and len(found) == 0x110000


def test_query_equals_library(spark, ranks, library):
    import hashlib

    from lumenspark.llm.queries_b import op10_bpe

    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_bpe(spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "x y", 8), (3, "", 9)], "doc_id bigint, text string, ids int")
    made = bpe.encode(docs, PATH, keep=["doc_id"])
    back = bpe.decode(made, PATH, keep=["doc_id"])
    assert sorted([(r.doc_id, bytes(r.decoded)) for r in back.collect()], key=str) == sorted([(1, b""), (1, b""), (None, b"x y"), (3, b"")], key=str)
    assert bpe.encode(docs.where("false"), PATH, keep=["doc_id"]).count() == 0
