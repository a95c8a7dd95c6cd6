"""The quality classifier and the suffix tree against plain models, and decontamination against plain alignment."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import TABLES
from pyspark.sql import functions as F
from rinsewell.llm import decontaminate, quality, queries, sequences, suffix_tree_lm
from rinsewell.llm.tables import keep

# --- quality classifier


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order 3, with the discounts of the operator."""
    three = Counter()
    for t in texts:
        w = ["<", "<", *t.split(), ">"]
        three.update(zip(w, w[1:], w[2:], strict=False))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def order(counts):
        n = Counter(counts.values())
        y = n[1] / max(1, n[1] + 2 * n[2])
        d = [min(max(k - (k + 1) * y * n[k + 1] / max(1, n[k]), 0.1), k - 0.1) for k in (1, 2, 3)]
        total, weight = Counter(), defaultdict(float)
        for key, c in counts.items():
            total[key[:-1]] += c
            weight[key[:-1]] += d[min(c, 3) - 1]
        return d, total, weight

    unigrams = Counter({(w,): c for w, c in one.items()})
    models = [(counts, *order(counts)) for counts in (unigrams, two, three)]

    def chance(key):
        counts, d, total, weight = models[len(key) - 1]
        lower = 1 / (len(one) + 1) if len(key) == 1 else chance(key[1:])
        context = key[:-1]
        if not total[context]:
            return lower
        c = counts[key]
        return (c - d[min(c, 3) - 1] if c else 0) / total[context] + weight[context] / total[context] * lower

    def perplexity(text):
        w = ["<", "<", *(text or "").split(), ">"]
        n = len(w) - 2
        return 10 ** (-sum(math.log10(chance(k)) for k in zip(w, w[1:], w[2:], strict=False)) / n), n

    return perplexity


def test_perplexities(spark):
    random.seed(2)
    texts = [" ".join(random.choices("a b c d e f the of".split(), k=random.randint(1, 30))) for _ in range(60)]
    model = quality.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    asked = [*texts[:5], "a b zz zz the", "", None, "zz " * 3000]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate(asked)], "doc_id long, text string, lang string, perplexity double")
    plain = kneser_ney(texts)
    for r in quality.perplexities(docs, model, ["en"]).collect():
        expected, n = plain(asked[r.doc_id])
        assert r.n_tokens == n and r.perplexity == pytest.approx(expected, rel=1e-4)


def junk(words):
    return " ".join(f"{w}!!" for w in words).upper()


def corpus(spark):
    random.seed(4)
    vocabulary = {"en": "the of and to in is that for it was on be with as by at".split(), "fr": "le la de et les des un une du que pour dans".split()}
    rows, labels = [], []
    for i in range(400):
        lang = random.choice(["en", "fr"])
        words = random.choices(vocabulary[lang], k=random.randint(20, 60))
        bad = i % 10 == 0
        rows.append((i, junk(words) if bad else " ".join(words), lang))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0 if i % 7 else None))
    rows += [(400, None, "en"), (401, "the of", None), (None, "the of and", "xx"), (3, rows[3][1], rows[3][2])]
    labels += [(None, 1, None), (5, None, None), labels[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_keeps_good_texts(spark):
    docs, labels = corpus(spark)
    found = quality.classify(docs, labels, quantile=1.0).collect()
    assert len(found) == docs.count()
    kept = {r.doc_id: r.keep for r in found if r.doc_id is not None and r.doc_id < 400}
    assert not any(kept[i] for i in range(0, 400, 10))
    assert sum(kept[i] for i in kept if i % 10) > 0.97 * 360
    assert all(r.keep for r in found if r.lang not in ("en", "fr"))


def test_classifier_without_rows(spark):
    docs, labels = corpus(spark)
    assert quality.classify(docs.limit(0), labels).count() == 0
    found = quality.classify(docs, labels.limit(0)).collect()
    assert len(found) == docs.count() and all(r.keep and r.threshold is None for r in found)


def test_classifier_with_long_trusted_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 2_000)
    random.seed(5)
    words = "the of and to in is that for it was on be with as by at".split()
    good = [" ".join(random.choices(words, k=2_000)) for _ in range(12)]  # each longer than the bound
    bad = [junk(g.split()[:40]) for g in good]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(good))], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs, labels, quantile=1.0).collect()}
    assert [found[i].keep for i in range(24)] == [True] * 12 + [False] * 12


def test_sample_is_pruned_before_texts_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 20_000)
    rows = spark.range(40_000).select(F.lit("en").alias("lang"), F.xxhash64("id").alias("h"), F.lit(100).cast("long").alias("size"))
    rows = rows.withColumn("late", F.when(F.pmod("h", F.lit(100)) == 0, F.lit(3_000)).otherwise(F.lit(0)))
    reached = quality._reached(rows)
    assert 200 <= reached.where("late = 0").count() < 300 and reached.where("late > 0").count() == 10
    first = [r.h for r in rows.where("late = 0").orderBy("h").limit(200).collect()]
    assert set(first) <= {r.h for r in reached.collect()}


def test_thresholds_cover_all_held_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 3_000)
    docs, labels = corpus(spark)
    docs = docs.where("doc_id is not null and lang is not null")
    trained = quality._sample(docs, labels)
    model = quality.train(trained.select("lang", "text"))
    sizes = {r.lang: r.size for r in trained.groupBy("lang").agg(F.sum(F.greatest(F.length("text"), F.lit(100))).alias("size")).collect()}
    assert set(sizes) == {"en", "fr"} and all(0 < s <= 3_000 for s in sizes.values())
    known = {(r.lang, r.text) for r in trained.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    table = quality.perplexities(quality._hashed(docs), model, ["en", "fr"])
    scored = {(r.lang, r.text or ""): r.perplexity for r in table.collect() if r.doc_id in good}
    for r in quality._thresholds(table, labels, trained, 0.9).collect():
        held = sorted(p for (lang, text), p in scored.items() if lang == r.lang and (lang, text) not in known)
        assert len(held) > 50 and r.threshold == pytest.approx(held[math.ceil(0.9 * len(held)) - 1], rel=2 / quality.BINS)


def test_bound_and_quantile_are_not_lowered():
    assert quality.TRAIN_CHARS >= 3_000_000 and quality.QUANTILE == 0.99


def test_all_trusted_texts_count(spark):
    texts = [f"w{i} " * 4_000_00 + f"x{i}" for i in range(12)]  # together more than any bound that a model would fit
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    even = {r.text for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("odd")).collect() if not r.odd}
    assert sum(map(len, even)) > 3_000_000
    assert {r.text for r in quality._sample(docs, labels).collect()} == even


def test_quality_query(spark):
    found = queries.op7_quality(spark, TABLES)
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    share = {r.quality: r.share for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("share")).collect()}
    assert found.count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert share[1] > 0.9 and share[0] < 0.5


def test_model_is_packed_once_and_not_exchanged_again(spark, monkeypatch):
    monkeypatch.setattr(sequences, "SHARD_BYTES", 500)
    random.seed(2)
    texts = [" ".join(random.choices("a b c d e f the of".split(), k=random.randint(1, 30))) for _ in range(300)]
    model = quality.train(spark.createDataFrame([(x, t) for t in texts for x in ("en", "fr")], "lang string, text string"))
    assert model.bits > 5
    assert model.rows.groupBy("kind", "shard", "lang").count().where("count > 1").count() == 0
    asks = spark.range(9).selectExpr("id as shard", "id as block", "cast('' as binary) as codes").repartition(3)
    plan = sequences.looked_up(asks, model.rows, quality._read, quality._NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(shard") == 1


def test_packed_rows_are_small():
    codes = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 200_000, np.uint64, endpoint=False))
    rows = sequences.dealt(2, 1, codes, [codes[::-1].copy()], 1)
    assert max(len(x) for k in ("codes", "data") for x in rows.column(k).to_pylist()) < 1 << 18
    assert all(np.array_equal(a, b) for a, b in zip(sequences.gathered(rows, 2, 1), [codes, codes[::-1]], strict=True))


def test_sets_are_sorted_not_hashed():
    values = np.random.default_rng(3).integers(0, 1 << 64, 1 << 20, np.uint64, endpoint=False)
    assert np.array_equal(sequences.distinct(values), np.sort(np.array(list(set(values.tolist())), np.uint64)))
    held = [[(1, values[i::4], np.arange(len(values[i::4])) % 3 == 0)] for i in range(4)]
    held += [[(1, values[:1000], np.ones(1000, bool))]]
    rows = sequences.merged(5, held, 4)
    assert np.array_equal(np.concatenate([sequences.unpack_codes(x) for x in rows.column("codes").to_pylist()]), sequences.distinct(values))
    assert sum(sequences.unpack(x).sum() for x in rows.column("n").to_pylist()) == sum(counts.sum() for [(_, _, counts)] in held)


def folders(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir")) / spark.sparkContext.applicationId
    return {p for p in root.iterdir() if any(p.rglob("*.parquet"))} if root.exists() else set()


def test_classifier_over_many_blocks_leaves_only_its_result(spark, monkeypatch):
    for module in (quality, sequences):
        monkeypatch.setattr(module, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(sequences, "SHARD_BYTES", 500)
    monkeypatch.setattr("rinsewell.llm.words.SLICE", 300)
    docs, labels = corpus(spark)
    docs = docs.where("doc_id is not null and lang is not null")
    texts = {(r.lang, r.text) for r in quality._sample(docs, labels).collect()}
    plain = {lang: kneser_ney([t for own, t in texts if own == lang]) for lang in ("en", "fr")}
    before = folders(spark)
    found = quality.classify(docs, labels)
    for r in found.collect():
        expected, n = plain[r.lang](r.text)
        assert r.n_tokens == n and r.perplexity == pytest.approx(expected, rel=1e-9)
    read = {Path(f.removeprefix("file:")).parent for f in found.inputFiles()}
    assert len(read) == quality.RANGES + 1  # what the ranges scored, and the thresholds
    assert folders(spark) - before == read


# --- suffix tree


def plain_base(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)))
        for i, t in rows
    ]


def plain_scores(training, asked):
    """log10 probabilities of texts by a suffix tree of dictionaries: contexts of up to three words and the tokens after
    them that were seen twice, kept by divergence, discounted, and smoothed by their suffix."""
    split = lambda t: [*(t or "").encode().lower().split(), None]
    counts = [Counter() for _ in range(suffix_tree_lm.DEPTH + 2)]
    for t in training:
        w = split(t)
        for size in range(1, suffix_tree_lm.DEPTH + 2):
            counts[size].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    total, distinct = sum(counts[1].values()), len(counts[1])
    chance = {k: (c + 0.1) / (total + 0.1 * (distinct + 1)) for k, c in counts[1].items()}
    left, own = {}, dict(chance)
    for size in range(2, suffix_tree_lm.DEPTH + 2):
        after = defaultdict(dict)
        for k, c in counts[size].items():
            if c >= suffix_tree_lm.LEAST:
                after[k[:-1]][k] = c
        for context, seen in after.items():
            n = counts[size - 1][context]
            below = {k: chance[k[1:]] for k in seen}
            rest, rest_below = 1 - sum(seen.values()) / n, 1 - sum(below.values())
            apart = sum(c / n * math.log(c / n / below[k]) for k, c in seen.items())
            if rest > 1e-12 and rest_below > 1e-12:
                apart += rest * math.log(rest / rest_below)
            kept = n * apart >= suffix_tree_lm.GAIN
            if kept:
                left[context] = 1 - sum(c - suffix_tree_lm.DISCOUNT for c in seen.values()) / n
            for k, c in seen.items():
                chance[k] = (c - suffix_tree_lm.DISCOUNT) / n + left[context] * below[k] if kept else below[k]
                if kept:
                    own[k] = chance[k]
    found = []
    for t in asked:
        w, score = split(t), 0.0
        for i in range(len(w)):
            p = own.get((w[i],), 0.1 / (total + 0.1 * (distinct + 1)))
            for size in range(1, min(i, suffix_tree_lm.DEPTH) + 1):
                context = tuple(w[i - size : i])
                if context in left:
                    p = own[(*context, w[i])] if (*context, w[i]) in own else p * left[context]
            score += math.log10(p)
        found.append(score)
    return found, left


def test_scores(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    expected = {r[0]: r for r in plain_base([(d.doc_id, d.text) for d in docs])}
    found = queries.op6_suffix_tree_lm(spark, TABLES).collect()
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[:5] == expected[r.doc_id][:5]
        assert r.base_score == pytest.approx(expected[r.doc_id][5], rel=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 1
    scores, left = plain_scores([d.text for d in docs if zlib.crc32(str(d.doc_id).encode()) % 10], [d.text for d in docs])
    assert {len(k) for k in left} == {1, 2, 3}
    by_id = {r.doc_id: r.score for r in found}
    for d, score in zip(docs, scores, strict=True):
        assert by_id[d.doc_id] == pytest.approx(score, rel=1e-6)


def grown(spark):
    random.seed(8)
    texts = []
    for _ in range(300):
        w = ["a"]
        for _ in range(random.randint(1, 40)):
            w.append(random.choice({"aa": "bbbc", "ab": "cc", "bc": "aaab", "ca": "dab"}.get("".join(w[-2:]), "abcd")))
        texts.append(" ".join(w))
    return spark.createDataFrame([(t,) for t in texts], "text string"), texts


def test_scores_by_all_sequences_that_repeat(spark):
    docs, texts = grown(spark)
    asked = [*texts[:50], "a b zz c", "", "a " * 40]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    expected, left = plain_scores(texts, asked)
    assert left
    for r in suffix_tree_lm.score(rows, docs).collect():
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-9)


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a"), (3, "A a"), (None, "b"), (4, "c " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    found = suffix_tree_lm.score(docs, docs.where("doc_id <> 2 or doc_id is null"))
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in found.collect()) == [(0, 2, 2), (1, 1, 1), (2, 1, 1), (3, 3, 3), (3, 3, 3), (4, 30_001, 30_001)]
    assert suffix_tree_lm.score(docs.limit(0), docs).count() == 0
    alone = suffix_tree_lm.score(docs, docs.limit(0)).collect()
    assert all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0, 0) for r in alone)


def test_scores_over_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(sequences, "SHARD_BYTES", 500)
    monkeypatch.setattr("rinsewell.llm.words.SLICE", 300)
    _, texts = grown(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected, left = plain_scores([t for i, t in enumerate(texts) if i % 3], texts)
    assert left
    for r in suffix_tree_lm.score(rows, F.col("doc_id") % 3 != 0).collect():
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-9)


def test_scores_leave_only_the_result(spark):
    _, texts = grown(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = folders(spark)
    found = suffix_tree_lm.score(rows, F.col("doc_id") % 3 != 0)
    assert found.count() == len(texts)
    read = {Path(f.removeprefix("file:")).parent for f in found.inputFiles()}
    assert folders(spark) - before == read and len(read) <= suffix_tree_lm.RANGES


def test_packed_columns_come_back():
    values = [np.array(x, np.uint64) for x in ([0, 0, 0], [1, 255, 256], [0, 1, (1 << 64) - 1])]
    data = b"".join(map(sequences.pack, values))
    assert len(data) == 3 * (1 + 2 + 8) + 3
    assert all(np.array_equal(a, b) for a, b in zip(values, sequences.unpack_columns(data, 3, 3), strict=True))
    assert [len(x) for x in sequences.unpack_columns(sequences.pack(values[0][:0]) * 2, 2, 0)] == [0, 0]


def test_sequences_are_asked_about_in_seven_bytes_each():
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1 << 20, np.uint64, endpoint=False))
    rows = sequences.asked(1, 2, codes, np.ones(len(codes), np.uint64), 6)
    assert rows.num_rows == 64
    assert np.array_equal(np.concatenate([sequences.unpack_codes(x) for x in rows.column("codes").to_pylist()]), codes)
    size = sum(len(pa.compress(x, "lz4", asbytes=True)) for k in ("codes", "n") for x in rows.column(k).to_pylist())
    assert size < 7 * len(codes)


def test_kept_tables_are_read_in_small_groups(spark):
    """A reader takes a group of rows whole: of packed ones a few thousand are a hundred megabytes and more."""
    rows = spark.range(0, 4_000, 1, 1).select(F.concat(*(F.sha2(F.concat("id", F.lit(i)).cast("string"), 512) for i in range(200))).cast("binary").alias("codes"))
    files = [Path(f.removeprefix("file:")) for f in keep(rows, 1).inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in map(pq.read_metadata, files) for i in range(m.num_row_groups)]
    assert len(sizes) > 3 and max(sizes) < 40 << 20


def test_kept_tables_leave_no_exchanges(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    exchanged = lambda: {f for f in map(str, disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = exchanged()
    assert len(keep(spark.range(1000).groupBy(F.col("id") % 7).count()).collect()) == 7
    for _ in range(100):
        if not exchanged() - before:
            return
        time.sleep(0.1)
    raise AssertionError(exchanged() - before)


# --- decontamination


def plain_alignment(passage, item):
    row, best = [0] * (len(item) + 1), 0
    for p in passage:
        new = [0]
        for j, t in enumerate(item, 1):
            new.append(max(0, row[j - 1] + (2 if p == t else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    random.seed(seed)
    some = lambda k: np.array(random.choices(range(1, 7), k=k), np.uint64)
    passages, items = [some(random.randint(1, 30)) for _ in range(20)], [some(random.randint(3, 12)) for _ in range(20)]
    for (score, low, high), p, t in zip(decontaminate.align(passages, items), passages, items, strict=True):
        best = plain_alignment(p.tolist(), t.tolist())
        assert score == pytest.approx(best / (2 * len(t)))
        assert best == 0 or plain_alignment(p[low:high].tolist(), t.tolist()) == best


def leaks(spark, monkeypatch=None):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    items = [[word() for _ in range(random.randint(12, 30))] for _ in range(12)]
    docs, expected = [], set()
    for i in range(200):
        words = [word() for _ in range(random.randint(0, 80))]
        if i % 4 == 0:
            k = random.randrange(12)
            copy = list(items[k])
            for j in range(0, len(copy), 7):
                copy[j] = random.choice([copy[j].upper() + ",", word(), ""])
            at = random.randint(0, len(words))
            words[at:at] = copy
            expected.add((i, k))
        elif i % 9 == 0:
            words += items[3][:4]
        docs.append((i, " ".join(words), "s"))
    docs += [(200, None, "s"), (201, "", "s"), (None, " ".join(items[0]), "s"), (0, docs[0][1], "s")]
    tests = [(k, " ".join(t), 1) for k, t in enumerate(items)] + [(50, None, 1), (51, "", 1), (52, "two words", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(tests, "item_id long, text string, score int"), expected


@pytest.mark.parametrize("block", [20_000_000, 300])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs, tests, expected = leaks(spark)
    found = decontaminate.find_leaks(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected | {(None, 0)}
    assert sum(r.doc_id == 0 for r in found) == 2 and all(r.score >= decontaminate.THRESHOLD for r in found)
    left = decontaminate.without_leaks(docs, tests)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({*range(202)} - {i for i, _ in expected})


def test_leaks_without_rows(spark):
    docs, tests, _ = leaks(spark)
    assert decontaminate.find_leaks(docs.limit(0), tests).count() == 0
    assert decontaminate.find_leaks(docs, tests.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, tests.limit(0)).count() == docs.count()


def test_leaks_of_one_edited_passage_in_many_documents(spark):
    item = [f"w{i}" for i in range(25)]
    edited = " ".join("odd" if i % 5 == 4 else w for i, w in enumerate(item))  # most of its n-grams occur nowhere
    docs = spark.createDataFrame([(i, f"x{i} {edited} y{i} z" + f" q{i} {edited}" * (i == 7)) for i in range(60)] + [(60, "w1 w2 w3 only")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontaminate.find_leaks(docs, tests).collect()
    assert sorted(r.doc_id for r in found) == sorted([*range(60), 7])


def edited(words, every, how, word):
    """Every so manieth word replaced, left out, or followed by a new one."""
    out = []
    for j, w in enumerate(words):
        change = j % every == every - 1
        out += [word()] if change and how == "other" else [] if change and how == "none" else [w, word()] if change else [w]
    return out


@pytest.mark.parametrize(("threshold", "vocabulary"), [(0.4, 2000), (0.5, 12), (0.8, 5)])
def test_no_alignment_at_the_threshold_is_missed(spark, threshold, vocabulary):
    """Every pair of document and item whose plain alignment reaches the threshold is found, and no other, among copies of
    which every second, third and fourth word was changed and texts of few words that share much by chance."""
    random.seed(vocabulary)
    word = lambda: f"w{random.randrange(vocabulary)}"
    items = [[word() for _ in range(random.choice([3, 5, 9, 20, 30]))] for _ in range(20)]
    texts = [[word() for _ in range(random.randint(0, 60))] for _ in range(40)]
    for k, item in enumerate(items):
        for every in (1, 2, 3, 4):
            for how in ("other", "none", "new"):
                texts.append([word() for _ in range(k)] + edited(item, every, how, word) + [word() for _ in range(10)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, tests, threshold).collect()}
    expected = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if plain_alignment(t, item) >= threshold * 2 * len(item)}
    assert found == expected and len(expected) > 60


def test_frequent_seeds_are_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_HITS", 50)
    tests = spark.createDataFrame([(k, f"of the a{k} of the b{k}") for k in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "of the " * 200), (2, "x of the a7 of the b7 y")], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, tests, 0.9).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in found] == [(2, 7, 1.0)]


def test_normal_words():
    found, hashes = decontaminate._normal(pa.array(["The, the THE*** (the) ... .", None, "***"]))
    assert len(set(hashes[:4].tolist())) == 1 and len(hashes) == 7


def test_leak_query(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    tests = spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, TABLES).collect()}
    plain = {(d.doc_id, t.item_id) for d in docs for t in tests if t.text in (d.text or "")}
    assert plain <= found
    # All pairs of a document and an item, aligned whole.
    words = lambda rows: [decontaminate._normal(pa.array([r.text or ""]))[1] for r in rows]
    own, expected = words(tests), set()
    for d, passage in zip(docs, words(docs), strict=True):
        if len(passage):
            scores = [s for i in range(0, len(own), 16) for s, _, _ in decontaminate.align([passage] * len(own[i : i + 16]), own[i : i + 16])]
            expected |= {(d.doc_id, t.item_id) for t, s in zip(tests, scores, strict=True) if s >= decontaminate.THRESHOLD}
    assert found == expected
