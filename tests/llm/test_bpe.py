"""Byte-level BPE against the library that the ranks are made for, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspark.llm import bpe
from cellspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def known():
    ranks = bpe.read_ranks(bpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SHORT = st.text(st.sampled_from("ab'sT 1\t\n\r\x0b\x1c\x85 　 é한🙂<|>_,\x00"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), SHORT))
def test_any_text(known, text):
    ids = bpe.codec(bpe.default_vocabulary()).encode(text)
    assert ids == known.encode_ordinary(text)


def test_all_letters(known):
    """Letters of every kind, each beside letters, digits, spaces and marks."""
    rng, codec = random.Random(1), bpe.codec(bpe.default_vocabulary())
    places = [*range(0x3000), *rng.sample([c for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000], 5000)]
    text = ["a{0}1{0}{0} {0}b!{0}?".format(chr(c)) for c in places]
    assert [codec.encode(t) for t in text] == [known.encode_ordinary(t) for t in text]


def test_documents(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = known.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want


def test_odd_rows(spark, known):
    """Null, empty and very long texts, repeated rows, a null id, special strings, names that the operator uses inside."""
    texts = [None, "", " \n\t ", "<|endoftext|> <unk>", "x" * 300_000, "word " * 400_000, "　wide　" * 1000, "tie", "tie", "é" * 50_000 + " a"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x"), (7, "tie", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, decoded string")
    encoded = bpe.encode_texts(docs)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.ids, bytes(r.decoded)) for r in bpe.decode_ids(encoded).collect()), key=str)
    want = sorted(((i if i is not None else -1, known.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=str)
    assert got == want
    assert bpe.op13_rows(docs.where("false")).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bytes(bpe.decode_ids(none).first().decoded) == b""


def test_unreachable_tokens(tmp_path):
    """A token that no merges lead to is still one where it is a whole pre-token."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"bcd", b"abcd", b"xyz"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(str(path)), special_tokens={})
    codec = bpe.Codec(str(path))
    for text in ("abcd", "xyz", "xyzz", "abc abcd", "bcd xyz", "abab"):
        assert codec.encode(text) == own.encode_ordinary(text)
