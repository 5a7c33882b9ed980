import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_tiktoken(own, text):
    import numpy as np

    c = byte_bpe.coder(PATH, public_tokenizers.PATTERN)
    ids = c.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(2000)]
    h = byte_bpe.PerfectHash(keys, list(range(2000)))
    assert h.find(keys) == list(range(2000)) and sorted(h.values) == list(range(2000))
    assert h.find([b"x", b""]) == [-1, -1]
    assert byte_bpe.PerfectHash([], []).find([b"a"]) == [-1]


def test_table(spark, own):
    long = "thonandes " * 30000 + "aaaa" * 5000
    rows = [(1, "Hello  world's 123\n\n x", 7), (2, None, 7), (3, "", None), (None, "ü€😀", 1), (1, "Hello  world's 123\n\n x", 7), (6, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 6
    for (i, text, _), r in zip(rows, got, strict=True):
        assert r.doc_id == i and r.ids == own.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    d = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, digests=True).collect()
    assert d[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[1].n_tokens == 0
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
