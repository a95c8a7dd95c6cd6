"""Line de-duplication against brute force."""

import random
import re
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from rinsewell.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, min_chars, min_docs):
    """For each (doc_id, text): lines, lines dropped, kept text."""

    def key(line):
        return re.sub(r"\A[\x20\x09-\x0d]+|[\x20\x09-\x0d]+\Z", "", line).translate(LOWER)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")

        def stays(line):
            docs = holders[key(line)]
            return len(key(line)) < min_chars or len(docs) < min_docs or doc == max(docs, key=lambda d: (d is not None, d or 0))

        kept = [line for line in lines if stays(line)]
        out.append((doc, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_texts(seed):
    random.seed(seed)
    lines = ["", " ", "short", "Some Line", " some line\t", "ÄÖ line", "äö line", "\x0bSOME LINE\x0c", "　wide line", "some line\x1c", "a\rb line", "🙂🙂🙂🙂 x"]
    lines += [f"line number {i}" for i in range(6)]
    return ["\n".join(random.choices(lines, k=random.randint(0, 9))) for _ in range(60)]


@pytest.mark.parametrize(("seed", "min_chars", "min_docs"), [(1, 6, 5), (2, 9, 2), (3, 1, 1), (4, 8, 40)])
def test_against_brute_force(spark, seed, min_chars, min_docs):
    rows = [(random.randint(0, 45), text) for text in some_texts(seed)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (3, None), (4, ""), (5, "\n"), *rows[:4], (900, "\n".join(t for _, t in rows))]
    docs = spark.createDataFrame([(*row, "mine") for row in rows], "id long, body string, n_lines string").withColumn("place", F.lit(1)).repartition(5)
    found = line_dedup.remove_repeated_lines(docs, "id", "body", min_chars, min_docs)
    assert found.columns == ["id", "body", "place", "n_lines", "n_dropped", "kept_text"]
    assert sorted(map(str, map(tuple, found.drop("place").collect()))) == sorted(map(str, plain(rows, min_chars, min_docs)))


def test_no_rows_and_nulls_only(spark):
    docs = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.remove_repeated_lines(docs).collect()] == [(None, None, 1, 0, "")]
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_one_very_long_text(spark):
    common = "x" * 40
    rows = [(1, "\n".join([common, "own line"] * 100_000))] + [(i, common) for i in range(2, 7)]
    found = {r.doc_id: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_lines, found[1].n_dropped) == (200_000, 100_000) and found[1].kept_text == "\n".join(["own line"] * 100_000)
    assert (found[6].n_dropped, found[6].kept_text) == (0, common)


def test_counts_are_dealt_by_line_and_document(spark):
    """A line of very many documents is counted by many tasks."""
    docs = spark.range(10).selectExpr("id AS doc_id", "'x' AS text")
    plan = line_dedup.repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(h1#\d+L, h2#\d+L, struct\(doc, doc#\d+L\)#\d+, \d+\)", plan) or re.search(r"hashpartitioning\(h1#\d+L, h2#\d+L, \w+#\d+", plan)
    assert "Python" not in plan and "InArrow" not in plan
