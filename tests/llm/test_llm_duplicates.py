"""Substring de-duplication and SimHash groups against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import TABLES
from pyspark.sql import functions as F
from rinsewell.llm import queries, simhash, substring_dedup
from rinsewell.llm.components import components


def kept_words(texts, width):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def passages(seed, n=120):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [random.choices(vocabulary, k=k) for k in (5, 9, 14, 30)]
    texts = []
    for _ in range(n):
        parts = random.choices(vocabulary, k=random.randint(0, 40))
        for _ in range(random.randint(0, 2)):
            at = random.randint(0, len(parts))
            parts[at:at] = random.choice(shared)
        texts.append(random.choice(["  ", " ", "\n"]).join(parts))
    return [*texts, *texts[:5], None, "", "z " * 200, "z " * 60, "y", "y"]


@pytest.mark.parametrize(("seed", "width", "hot", "shard"), [(1, 6, 10**6, 50_000), (2, 6, 3, 50), (3, 1, 5, 50), (4, 12, 2, 10)])
def test_repeated_words(spark, monkeypatch, seed, width, hot, shard):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    texts = passages(seed)
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").coalesce(3)
    found = substring_dedup.remove_repeated(docs, width)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    assert got == Counter((i % 50, t, *k) for i, (t, k) in enumerate(zip(texts, kept_words(texts, width), strict=True)))


def test_no_rows_and_one_long_text(spark):
    docs = spark.createDataFrame([(None, " ".join(map(str, range(200_000))))], "doc_id long, text string")
    row = substring_dedup.remove_repeated(docs, 35).first()
    assert (row.n_words, row.n_removed) == (200_000, 0)
    assert substring_dedup.remove_repeated(docs.limit(0), 35).count() == 0


def test_substring_query(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    expected = {(d.doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, kept_words([d.text for d in docs], 35), strict=True)}
    assert {tuple(r) for r in queries.op5_substring_dedup(spark, TABLES).collect()} == expected


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(codes, distance):
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("text", [None, "", "A b", "a b c d", "a b c d e", "The the THE the the", "é É ß x y z", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode(), 4) == plain_fingerprint(text, 4)


def test_hash_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c é"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c é".encode(), 42)).astype(np.int64)


@pytest.mark.parametrize(("n", "distance", "searches"), [(2, 4, 64), (17, 4, 64), (300, 4, 5), (2000, 3, 64), (600, 1, 64)])
def test_gray_index(monkeypatch, n, distance, searches):
    monkeypatch.setattr(simhash, "SEARCHES", searches)
    random.seed(n)
    centres = [random.getrandbits(64) for _ in range(max(1, n // 30))]
    codes = set()
    while len(codes) < n:
        code = random.choice(centres)
        for _ in range(random.randint(0, 5)):
            code ^= 1 << random.randrange(64)
        codes.add(code)
    a, b = simhash.GrayIndex(np.array(sorted(codes), np.uint64)).forest(distance)
    joined = {c: {c} for c in codes}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        both = joined[x] | joined[y]
        for c in both:
            joined[c] = both
    expected = roots(codes, distance)
    assert len(a) < n
    assert {c: min(own) for c, own in joined.items()} == expected


@pytest.mark.parametrize("block", [20_000, 2])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    random.seed(5)
    texts = [" ".join(random.choices([f"w{i}" for i in range(3000)], k=random.randint(1, 80))) for _ in range(40)]
    texts += [t + " " + e for t in texts[:20] for e in ("x", "y z")] + texts[:4] + [None, "", " ", "solo", "SOLO"]
    ids = [*range(100, 100 + len(texts) - 2), None, 7]
    docs = spark.createDataFrame([(i, t, "f") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string")
    found = simhash.groups(docs, 4, 4).collect()
    own = [plain_fingerprint(t, 4) for t in texts]
    root = roots(own, 4)
    least = {}
    for i, c in zip(ids, own, strict=True):
        if i is not None:
            least[root[c]] = min(i, least.get(root[c], i))
    expected = Counter((i, c, least.get(root[c])) for i, c in zip(ids, own, strict=True))
    assert Counter((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in found) == expected
    kept = simhash.one_of_each(docs.unionByName(docs), 4, 4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_id_many_texts(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "quite another text"), (None, "no id"), (None, "no id")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(docs).collect()) == ["no id", "one two three", "quite another text"]


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    own = {d.doc_id: plain_fingerprint(d.text, 4) for d in docs}
    root = roots(own.values(), 4)
    least = {}
    for i, c in sorted(own.items()):
        least.setdefault(root[c], i)
    expected = {(i, f"{c:016x}", least[root[c]]) for i, c in own.items()}
    assert {tuple(r) for r in queries.op8_simhash(spark, TABLES).collect()} == expected


def test_components(spark):
    random.seed(3)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    edges = path + star + [(5, 5), (3, 4)] + [(random.randint(2000, 2200), random.randint(2000, 2200)) for _ in range(150)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert found[node] == min(seen)
    assert len(found) == len(near)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
