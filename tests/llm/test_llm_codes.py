"""Vector codes against plain Lloyd rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rinsewell.llm import vector_codes


def plain_codes(vectors, keys, parts, entries, rounds):
    """Codebooks, codes and errors by comparing every part with every entry, in Python integers."""
    width = max(1, -(-max(map(len, vectors)) // parts)) * parts
    step = width // parts
    vectors = [list(v) + [0] * (width - len(v)) for v in vectors]
    first = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, vectors[i]))[:entries]
    codes, errors, books = [""] * len(vectors), [0] * len(vectors), []
    for p in range(parts):
        own = [v[p * step : (p + 1) * step] for v in vectors]
        book = [own[i] for i in first]

        def nearest(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            members = [[] for _ in book]
            for x in own:
                members[nearest(x)[1]].append(x)
            book = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(book, members, strict=True)]
        for i, x in enumerate(own):
            distance, j = nearest(x)
            codes[i] += f"{j:02x}"
            errors[i] += distance
        books.append(book)
    return codes, errors, books


def clustered(seed, n, dims, spread):
    random.seed(seed)
    centres = [[random.randint(-900, 900) for _ in range(dims)] for _ in range(12)]
    return [[c + random.randint(-spread, spread) for c in random.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize(("seed", "spread", "leaf", "block", "entries"), [(1, 3, 4, 64, 20), (2, 300, 8, 1000, 33), (3, 0, 2, 50, 40), (4, 2, 128, 4096, 256), (5, 1, 1, 37, 1)])
def test_against_plain_rounds(spark, monkeypatch, seed, spread, leaf, block, entries):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    vectors = clustered(seed, 300, 8, spread) + [[5] * 8] * 40 + [[-(1 << 23)] * 8]
    keys = [random.randint(0, 250) for _ in vectors]
    rows = spark.createDataFrame([(k, [x / 1024 for x in v], "old", i) for i, (k, v) in enumerate(zip(keys, vectors, strict=True))], "id long, v array<double>, code string, row int")
    coded, books = vector_codes.compress(rows.repartition(3), "id", "v", parts=4, entries=entries, rounds=3)
    codes, errors, expected = plain_codes(vectors, keys, 4, entries, 3)
    assert [b.tolist() for b in books] == expected
    assert coded.columns == ["id", "row", "code", "error"]
    assert {r.row: (r.id, r.code, r.error) for r in coded.collect()} == {i: (keys[i], codes[i], errors[i]) for i in range(len(keys))}


def test_wide_numbers_stay_exact():
    a = np.array([[(1 << 24) - 1] * 600, [1 - (1 << 24)] * 600])
    assert vector_codes.squares(a, a[1:]).tolist() == [[sum((2 * (1 << 24) - 2) ** 2 for _ in range(600))], [0]]


def test_balls_are_owned_and_hold_their_points():
    points = np.array(clustered(7, 2000, 6, 1))
    tree = vector_codes.Tree.unpacked(vector_codes.Tree.of(points).packed())
    assert (tree.points == points[tree.place]).all() and sorted(tree.place) == list(range(2000))
    for ball in range(len(tree.radius)):
        inside = tree.points[tree.first[ball] : tree.last[ball]]
        assert (inside.sum(axis=0) == tree.total[ball]).all()
        assert np.sqrt(vector_codes.squares(inside, tree.centre[ball][None]).max()) <= tree.radius[ball]
    owner = vector_codes.anchors(points, 12)
    book = vector_codes.Book(np.array([points[owner == k][0] for k in range(12)]))
    codes, owned = tree.assign(book)
    assert sum(tree.last[b] - tree.first[b] for b, _ in owned) > 1000  # whole balls, not points
    for ball, entry in owned:
        codes[tree.first[ball] : tree.last[ball]] = entry
    assert (codes == vector_codes.squares(tree.points, book.entries).argmin(axis=1)).all()


def test_odd_rows(spark):
    rows = [(1, [0.1, None], "x"), (2, None, "x"), (3, [float("nan"), 1.0], None), (4, [float("inf")], None)]
    rows += [(5, [0.5, -0.25, 0.001], None), (5, [0.5, -0.25, 0.001], None), (None, [], "y"), (7, [-0.0001], "x")]
    table = spark.createDataFrame(rows, "id long, v array<double>, label string").withColumn("error", F.lit("mine"))
    coded, books = vector_codes.compress(table, "id", "v", parts=2, rounds=1)
    vectors = [[512, -256, 1], [512, -256, 1], [], [-1]]
    codes, errors, expected = plain_codes(vectors, [5, 5, None, 7], 2, 256, 1)
    assert [b.tolist() for b in books] == expected
    found = vector_codes.label_errors(coded).collect()
    expected_rows = list(zip([5, 5, None, 7], [None, None, "y", "x"], codes, errors, [errors[0] * 2, errors[0] * 2, errors[2], errors[3]], strict=True))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected_rows))
    assert vector_codes.digest(books) == vector_codes.digest([np.array(b) for b in expected])


def test_no_rows_and_large_components(spark):
    table = spark.createDataFrame([(1, [20000.0], None)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="16384"):
        vector_codes.compress(table)
    for empty in (table.limit(0), table.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "label")):
        coded, books = vector_codes.compress(empty)
        assert books == [] and vector_codes.label_errors(coded).count() == 0
