"""Fill-in-the-middle against plain string cutting."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rinsewell.llm import fill_in_middle as fim

TEXTS = ["", "one", "one\n", "\n", "\n\n", "a\nb\nc", "é漢\n🙂 ٣\n\r\nx\x0b\n", "has <P> in it\nx", "a <M>", "<S>", "<P\n>\n<\nS><\n<", "line\n" * 500, None]


def plain(key, text, fim_percent=100, spm_percent=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_percent:
        return len(lines), "plain", None, None, text
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(part) for part in (lines[:low], lines[low:high], lines[high:]))
    spm = h4 % 100 < spm_percent
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(lines), "spm" if spm else "psm", len(prefix), len(middle), output


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("fim_percent", "spm_percent", "seed"), [(100, 50, 7), (60, 0, 1), (0, 50, 7), (100, 100, 3)])
def test_against_plain_cutting(spark, fim_percent, spm_percent, seed):
    rows = [(i * 31, text) for i in range(4) for text in TEXTS] + [(None, "a\nb"), (None, None), (1, "a\nb"), (1, "a\nb")]
    docs = spark.createDataFrame([(*row, "mine", 1) for row in rows], "doc_id long, text string, form string, restored int")
    found = fim.restore(fim.transform(docs, fim_percent=fim_percent, spm_percent=spm_percent, seed=seed))
    expected = []
    for key, text in rows:
        n, form, prefix, middle, output = plain(key, text, fim_percent, spm_percent, seed)
        expected.append((key, text, n, form, prefix, middle, output, sha(output), text or "", sha(text or "")))
    assert sorted(map(str, map(tuple, found.drop("pieces").collect()))) == sorted(map(str, expected))


def test_pieces_render_the_output(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    marks = b"".join(fim.SENTINELS)
    for r in fim.transform(docs).collect():
        text = (r.text or "").encode()
        assert b"".join((marks if p.buffer else text)[p.start : p.stop] for p in r.pieces).decode() == r.output
        assert {p.buffer for p in r.pieces} == ({0} if r.form == "plain" else {0, 1})


def test_no_rows_long_texts_and_wrong_outputs(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + "\n" + "x" * 5_000_000 + "\ny")], "doc_id long, text string")
    row = fim.restore(fim.transform(docs)).first()
    assert (row.n, row.restored) == (3, row.text) and row.output == plain(1, row.text)[-1]
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0
    assert fim.restore(spark.createDataFrame([(None, None)], "output string, form string")).first().restored == ""
    for output in ("<P>a<M>b<S>c", "<P>a", "x"):
        with pytest.raises(ValueError, match="psm"):
            fim.restored(memoryview(output.encode()), "psm")


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40).filter(lambda b: not re.search(rb"<[PSM]>", b)), st.integers(0, 40), st.integers(0, 40), st.sampled_from(sorted(fim.FORMS)))
def test_any_cut_comes_back(text, a, b, form):
    low, high = sorted((min(a, len(text)), min(b, len(text))))
    output = fim.PieceTable(memoryview(text)).cut(low, high).arranged(fim.FORMS[form], marked=True)
    assert output.digest() == hashlib.sha256(output.rendered()).hexdigest()
    back = fim.restored(memoryview(output.rendered()), form)
    assert back.rendered() == text and back.digest() == hashlib.sha256(text).hexdigest()
