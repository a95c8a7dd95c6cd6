"""Encoding against the tiktoken library, and the length histogram against plain counts."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import TABLES
from hypothesis import given, settings
from hypothesis import strategies as st
from rinsewell.llm import bpe, queries, token_counts

RANKS = bpe.read_ranks(P.path(queries.TOKENIZER))
LIBRARY = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={}
)
ENCODER = bpe.Encoder(RANKS, P.PATTERN)
ODD = ["", " ", "  a", "a  b", "a \n b", "a\n", "\n\n a", "it's IT'S 's", "a" * 3000, "é漢字🙂 ٣٤", "x y 　z", "\x1c\x1d a\x85b", "<|endoftext|>", "a\tb \tc"]


def ids(text):
    return np.frombuffer(b"".join(ENCODER.parts(text)), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'sStaeéß0٣.,!🙂 　"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(b"".join(ENCODER.parts(text))) == text.encode()


def test_caches_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_TEXTS", 3)
    random.seed(1)
    for _ in range(200):
        text = " ".join("".join(random.choices("abtheion ", k=6)) for _ in range(9))
        assert ids(text) == LIBRARY.encode_ordinary(text)


def rows(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a b", "y"), (2, "a b", "y"), (None, "the end. " * 3000, None)], "doc_id long, text string, ids string")


def test_frames(spark):
    done = bpe.decode(bpe.encode(rows(spark), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert [(r.doc_id, r.text) for r in done] == [(r.doc_id, r.text) for r in rows(spark).collect()]
    for r in done:
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(rows(spark).limit(0), RANKS, P.PATTERN).count() == 0


def test_query(spark):
    found = {r.doc_id: r for r in queries.op3_byte_bpe(spark, TABLES).collect()}
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        expected = LIBRARY.encode_ordinary(d.text or "")
        assert found[d.doc_id].n_tokens == len(expected)
        assert found[d.doc_id].ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert found[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def expected_sums(lengths):
    n, total = len(lengths), sum(lengths)
    out = set()
    for size, times in Counter(lengths).items():
        over = [x for x in lengths if x >= size]
        below = [x for x in lengths if x < size]
        cut = sum(min(x, size) for x in lengths)
        out.add((size, times, len(over), sum(over), len(below), sum(below), cut, (len(below) + times) / n, total))
    return out


def test_length_histogram(spark):
    found = queries.op1_token_counts(spark, TABLES).collect()
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    assert {tuple(r) for r in found} == expected_sums([len(LIBRARY.encode_ordinary(d.text or "")) for d in docs])


def test_limits(spark):
    histogram = token_counts.length_histogram(rows(spark), RANKS, P.PATTERN)
    lengths = [len(LIBRARY.encode_ordinary(r.text or "")) for r in rows(spark).collect()]
    sums = token_counts.suffix_sums(histogram)
    assert {tuple(r) for r in sums.collect()} == expected_sums(lengths)
    limits = [0, 1, 2, 5000, 10**6]
    expected = {(n, sum(lengths), sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in limits}
    assert {tuple(r) for r in token_counts.at_limits(sums, limits).collect()} == expected
    empty = token_counts.suffix_sums(token_counts.length_histogram(rows(spark).limit(0), RANKS, P.PATTERN))
    assert empty.count() == 0
    assert {tuple(r) for r in token_counts.at_limits(empty, [7]).collect()} == {(7, 0, 0, 0)}
