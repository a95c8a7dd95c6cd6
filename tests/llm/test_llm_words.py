"""Words, hashes and slices against plain Python."""

import numpy as np
import pyarrow as pa
from rinsewell.llm import words as W

TEXTS = ["", None, " ", "a", " a\tb\x0bc d\n", "é 漢字\r\nx", "x" * 5000, "no-break space", "\x00 \x1c"]


def test_words_are_those_of_bytes_split():
    found = W.words(pa.array(TEXTS))
    own = [bytes(found.data[a:b]) for a, b in zip(found.starts, found.ends, strict=True)]
    expected = [(t or "").encode().split() for t in TEXTS]
    assert [own[a:b] for a, b in zip(found.first, found.first[1:], strict=False)] == expected
    assert found.doc.tolist() == [i for i, w in enumerate(expected) for _ in w]


def test_hashes_depend_on_the_word_alone(monkeypatch):
    monkeypatch.setattr(W, "SLICE", 16)
    texts = ["one two three two one", "ONE tWo", "eno owt", "one", None, "x" * 100 + " one"]
    found = W.words(pa.array(texts))
    h = found.hashes()
    assert h[0] == h[4] and h[1] == h[3] and len({int(x) for x in h}) == len({w for t in texts for w in (t or "").split()})
    lower = found.hashes(lower=True)
    assert lower[5] == lower[0] and lower[6] == lower[1] and lower[7] != lower[0]


def test_slices_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(W, "SLICE", 10)
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(TEXTS))), "t": TEXTS}).slice(1)
    parts = list(W.slices(batch, "t"))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(1, len(TEXTS)))


def test_grams_compare_content():
    h = W.words(pa.array(["a b c a b c a"])).hashes()
    three = W.grams(h, 3)
    assert three[0] == three[3] and three[1] == three[4] and three[0] != three[1]
    assert len(W.grams(h, 8)) == 0 and W.ranges(h, np.array([0]), np.array([3]))[0] == three[0]
